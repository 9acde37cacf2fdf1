"""Functions paired with their documentation, for those whose documentation says something.

Files are parsed by the grammars of :mod:`doc_grammar`; the declarations found there carry their
documentation and offsets.  A function's documentation is its ``description``, or else what its source
says; both pass the same test of informativeness.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import doc_grammar as G
from graphloom.llm.common import file_rows, filled, spread

# Lines and tags that document nothing.
DIRECTIVE = re.compile(
    r"\b(?:eslint-\w+|tslint:|noqa\b|nolint\b|pylint:|prettier-ignore|@?ts-(?:ignore|expect-error|nocheck)|NOSONAR|istanbul\s+ignore|c8\s+ignore|type:\s*ignore|biome-ignore|golangci)"
    r"|^\W*(?:eslint|tslint|jshint|flake8|mypy|checkstyle|clippy|rustfmt|fmt:\s*(?:off|on|skip)|isort:|pragma\b|go:\w+|nosec|yapf|ruff|coverage:|spotless:|spell-?checker|cspell|codespell|"
    r"sonar\b|suppress(?:warnings|lint)?\b|(?:end)?region\s*:?\s*\w*$|lint:)",
    re.I,
)
RULE_LINE = re.compile(r"^[\W_]*$")
WORK = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|WIP|BUG|OPTIMIZE|REVIEW)\b[^\n]*|^\s*(?:todo|fixme|xxx|hack|tbd|wip)\b[^\n]*", re.M)
DROPPED_TAG = re.compile(
    r"^\s*(?:@|:|\\)(?:author|since|version|date|copyright|license|see|link|todo|inheritdoc|internal|ignore|hidden|override|private|public|protected|static|async|api|beta|alpha|experimental|"
    r"generated|module|class|constructor|function|method|name|memberof|kind|category|group|package|file|id)\b[^\n]*|\{@inheritDoc\}|^\s*(?:since|author|authors|version|created(?:\s+(?:by|on))?|last\s+modified|date|copyright|license|spdx[\w-]*)\b\s*:?\s*v?[\d.@\w ,()-]{0,40}\.?\s*$",
    re.I | re.M,
)
PARAM_TAG = re.compile(r"^\s*(?:@|:|\\)(?:param|parameter|arg|argument|tparam|typeparam|prop|property)\b:?\s*(?:\{[^}]*\}\s*)?(?:\w+\s+(?=\w+:))?\[?([\w$.]*)\]?\s*[:\-–]*\s*", re.I | re.M)
OTHER_TAG = re.compile(r"^\s*(?:@|:|\\)\w+:?\s*", re.M)
SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|throws|yields|notes?|examples?|attributes|errors|panics|safety|# \w+)\s*:?\s*$", re.I | re.M)
FIELD = re.compile(r"^\s{0,12}\*{0,2}`?(\w+)`?\s*(?:\([^)]*\))?\s*:\s+", re.M)
_CODE_HEAD = re.compile(r"^(?:const|let|var|return|if|for|while|import|from|def|fn|func|pub|use|package|public|private|await|throw|raise|break|continue|else|try|except|catch|print|with|match|switch)\b[^.]*[=({;:\[]|^@\w+\(|^#\[")
_CODE_WHOLE = re.compile(r"^[\w$.&*!:\[\]\"'`<>]+\(.*\)[;,)\]}?]*$|^[\w.$\[\]\"', *&:()+-]+?\s*(?:[+\-*/|&]?=|:=)(?!=)\s*\S.*[^.]$|^[})\]]+[;,]?$|^\S+\s*(?:[+\-*/|&]=|:=)\s*\S+$|^(?:while|for|if|elif|else|try|with|def|class|except|match|case)\b.*:$")
_CODE_END = re.compile(r"(?:[{};]|=>|\|\||&&|\\)$")
_PROSE_RUN = re.compile(r"(?:\b[A-Za-z][a-z']*,? ){4}")


def is_code(line: str) -> bool:
    """Whether a comment line holds disabled code."""
    ln = line.strip()
    if not ln:
        return False
    if _CODE_END.search(ln) and not (ln.endswith(";") and _PROSE_RUN.search(ln)):
        return True
    if _CODE_WHOLE.match(ln):
        return not _PROSE_RUN.match(ln)
    return bool(_CODE_HEAD.match(ln)) and not _PROSE_RUN.match(ln) and not ln.endswith(".")


# Stand-ins, and words that say nothing by themselves.
STAND_INS = frozenset(
    "n/a|na|none|null|undefined|nil|nan|tbd|todo|xxx|-|--|...|?|description|no description|no description provided|enter description here|placeholder docstring|placeholder|"
    "see above|see below|same as above|as above|ditto|self explanatory|self-explanatory|undocumented|documentation missing|documentation pending|missing documentation|test|test me|foo|bar|asdf|lorem ipsum|"
    "auto-generated method stub|autogenerated|generated|stub|helper|helper function|function|method|docstring|doc|docs|add docs|add description|describe me|fix me|fixme|change me|your description here|insert description here|no docs|"
    "not documented|to be documented|to do|empty|blank|default|internal|deprecated|keine beschreibung|sin descripción|pas de description".split("|")
)
EMPTY_WORDS = frozenset(
    "a an and are as at be been being by can do does doing done for from had has have here how i if in into is it its itself me my of off on one or our out own so some such than that the their them then there these they this "
    "those to too up us use used uses using via was we were what where which who will with you your just simply basically also etc eg ie "
    "function functions method methods procedure routine constructor getter setter helper helpers utility util utils stub member callback handler wrapper implementation impl func fn def "
    "get gets getting set sets setting return returns returned returning result results output outputs value values param params parameter parameters arg args argument arguments input inputs given specified provided passed "
    "object objects instance data item items thing things stuff class struct type variable field property "
    "perform performs performing execute executes executing run runs running handle handles handling process processes processing make makes call calls called invoke invokes implement implements responsible main new "
    "description describe describes documentation document documented docstring docs doc comment comments summary brief details note notes placeholder missing pending todo tbd fixme xxx hack none null undefined nil nan na "
    "see above below auto generated automatically enter insert add text write fill code test foo bar todo undocumented internal deprecated inheritdoc override overrides private public static async void string int number boolean bool float "
    "der die das ein eine und oder von zu für mit wird gibt zurück setzt el la los las un una de del y o para con devuelve le les des du et ou pour avec retourne renvoie".split()
)

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\W]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LEAD = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!\*)|//[/!]?|#+!?|--|\"\"\"|''')?[ \t]?", re.M)


_MARKERS = re.compile(r"TODO|FIXME|XXX|HACK|TBD|WIP|BUG|OPTIMIZE|REVIEW|^\s*(?:todo|fixme|xxx|hack|tbd|wip)\b", re.M)
_TAGGED = re.compile(r"[@\\{]|^\s*:|^\s*(?:since|author|version|created|last|date|copyright|license|spdx)", re.I | re.M)


def parts_of(identifier: str | None) -> list[str]:
    return [p.lower() for p in _CAMEL.split(identifier or "") if p]


def stem(w: str) -> str:
    for end, to in (("ies", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("zes", "z"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: len(w) - len(end)] + to
            break
    return w.rstrip("e")


def bare(doc: str) -> str:
    """The text without comment marks, banners, tool directives and disabled code."""
    s = doc.replace("\r\n", "\n").strip()
    s = re.sub(r"\*+/\s*$", "", s)
    s = _LEAD.sub("", s)
    s = re.sub(r"(?:\*/|\"\"\"|''')\s*$", "", s.strip(), flags=re.M)
    kept = []
    for ln in s.split("\n"):
        if RULE_LINE.match(ln) or DIRECTIVE.search(ln):
            continue
        if is_code(ln):
            continue
        kept.append(ln)
    return "\n".join(kept)


def says(doc: str | None, name: str | None, signature: str | None) -> Iterator[str]:
    """The words of a documentation that tell anything beyond names, tags and stand-ins."""
    if not doc:
        return
    s = bare(doc)
    if _MARKERS.search(s):
        s = WORK.sub(" ", s)
    if _TAGGED.search(s):
        s = DROPPED_TAG.sub(" ", s)
    if len(s) < 60 and re.sub(r"[\s.!:]+", " ", s).strip().lower() in STAND_INS:
        return
    known = {stem(p) for p in parts_of(name)} | {stem(p) for p in parts_of(signature)}
    glued = (name or "").replace("_", "").lower()
    for ln in s.split("\n"):
        own: set[str] = set()
        if "@" in ln or ":" in ln or "\\" in ln or len(ln) < 24:
            if SECTION.match(ln):
                continue
            m = PARAM_TAG.match(ln) or FIELD.match(ln)
            if m and (PARAM_TAG.match(ln) or stem(m[1].lower()) in known):
                own = {stem(p) for p in parts_of(m[1])}
                ln = ln[m.end():]
            else:
                ln = OTHER_TAG.sub("", ln)
        for w in _WORD.findall(ln):
            bits = parts_of(w)
            for b in bits:
                if len(b) < 2 and not (len(b) == 1 and ord(b) > 0x2E80):
                    continue
                if b.isdigit() or re.fullmatch(r"v?\d+(?:\.\d+)*", b) or b in EMPTY_WORDS:
                    continue
                if stem(b) in known or stem(b) in own or b in glued or stem(b) in glued and len(stem(b)) > 3:
                    continue
                yield b


def has_substance(doc: str | None, name: str | None, signature: str | None) -> bool:
    return next(says(doc, name, signature), None) is not None


def _told(doc: str, name: str, signature: str) -> Column:
    @F.pandas_udf("boolean")
    def told(docs: pd.Series, names: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series([
            isinstance(d, str) and has_substance(d, n if isinstance(n, str) else None, s if isinstance(s, str) else None)
            for d, n, s in zip(docs, names, signatures)
        ], dtype=bool)

    return told(doc, name, signature)


_FOUND = "array<struct<name:string,owner:string,arity:int,line:int,last:int,told:boolean,doc:string,code:string>>"


def _last_line(lines: list[str], d: G.Declared, python: bool) -> int:
    first = lines[d.line - 1]
    indent = len(first) - len(first.lstrip())
    last = d.line
    for i in range(d.line, len(lines)):
        ln = lines[i]
        if not ln.strip():
            continue
        at = len(ln) - len(ln.lstrip())
        if at < indent or (at == indent and (python or not re.match(r"\s*[})\]]", ln))):
            # a signature over several lines goes on at any depth until it closes
            if "(" in first and i < d.line + d.params.count("\n") + 1:
                last = i + 1
                continue
            break
        last = i + 1
        if at == indent and not python:
            break
    return last


def _parsed(files: DataFrame, with_code: bool) -> DataFrame:
    """Declarations per file delivery, parsed where the file lies: the texts enter no exchange."""

    @F.pandas_udf(_FOUND)
    def declared(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for p, c in zip(paths, contents):
            rows = []
            if isinstance(c, str) and isinstance(p, str):
                python = G.extension(p) in ("py", "pyi")
                lines = c.replace("\r\n", "\n").split("\n") if with_code else []
                found = G.parse(p, c)
                names = Counter(d.name for d in found)
                for d in found:
                    told = has_substance(d.doc, d.name, d.params)
                    if not (told or with_code or names[d.name] > 1):
                        continue  # nothing to tell, and no namesake that it could be taken for
                    last = _last_line(lines, d, python) if with_code else None
                    rows.append({
                        "name": d.name, "owner": d.owner, "arity": d.arity, "line": d.line, "last": last, "told": told,
                        "doc": bare(d.doc).strip() if with_code and told else None,
                        "code": "\n".join(lines[d.line - 1:last]) if with_code else None,
                    })
            out.append(rows)
        return pd.Series(out)

    found = files.where(F.col("content").isNotNull() & F.col("file_path").isNotNull()).select(
        "id", "file_path", "rank", declared("file_path", "content").alias("d")
    )
    return found


def functions(nodes: DataFrame) -> DataFrame:
    """Function and Method nodes merged by id, with ``told``: whether the description has substance.

    The row with more non-null fields counts.  Descriptions are judged per delivery, where they are read.
    """
    every = [c for c in nodes.columns if c != "id"]
    cols = ["name", "file_path", "start_line", "end_line", "signature", "description"]
    ours = nodes.where(F.col("kind").isin("Function", "Method") & F.col("id").isNotNull())
    rank = F.struct(filled(every).alias("n"), F.xxhash64(*[F.col(f"`{c}`") for c in every]).alias("h"))
    ours = spread(ours.select("id", *cols, rank.alias("rank"))).withColumn("told", _told("description", "name", "signature"))
    return ours.groupBy("id").agg(F.max_by(F.struct(*cols, "told"), "rank").alias("b")).select("id", "b.*")


def _by_source(funcs: DataFrame, nodes: DataFrame, with_code: bool) -> DataFrame:
    """Each function with the declaration in its file: same name, and same line where the node has one.

    A node without lines is matched by owner and arity from its id, then by name alone.
    """
    files = _parsed(spread(file_rows(nodes)), with_code)
    decls = files.select("id", "file_path", "rank", F.explode("d").alias("x")).select(
        F.col("id").alias("file_id"), "file_path", "rank", "x.*"
    )
    qualified = F.element_at(F.split("id", ":"), -1)
    f = funcs.withColumn("arity_id", F.regexp_extract(qualified, r"#(\d+)$", 1)).withColumn(
        "owner_id", F.regexp_extract(qualified, r"(?:^|\.)([^.#]+)\.[^.#]+(?:#\d+)?$", 1)
    )
    x = decls.select(F.col("file_path").alias("fp"), F.col("name").alias("fn"), *[c for c in decls.columns if c not in ("file_path", "name")])
    joined = f.join(x, (f["file_path"] == x["fp"]) & (f["name"] == x["fn"]))
    same_line = F.col("start_line") == F.col("line")
    fit = (
        F.when(same_line, 100).otherwise(0)
        + F.when(F.coalesce("owner", F.lit("")) == F.col("owner_id"), 2).otherwise(0)
        + F.when(F.col("arity").cast("string") == F.col("arity_id"), 1).otherwise(0)
    )
    usable = joined.where(F.col("start_line").isNull() | same_line)
    best = F.struct(F.col("rank"), fit.alias("fit"), (-F.col("line")).alias("l"))
    return usable.groupBy(f["id"]).agg(
        F.max_by(F.struct("told", "doc", "code", "line", "last"), best).alias("s")
    ).select(F.col("id"), "s.*")


def documented(nodes: DataFrame) -> DataFrame:
    """``node_id`` of each Function or Method with documentation of substance in description or source.

    Nulls in any column are no documentation; nodes without a File row, or in a language without a
    grammar, are judged by ``description`` alone.  Of repeated ids the row with more non-null fields
    counts.
    """
    funcs = functions(nodes)
    rest = funcs.where("not told").select("id", "name", "file_path", "start_line")
    by_source = _by_source(rest, nodes, with_code=False).where("told").select("id")
    return funcs.where("told").select("id").unionByName(by_source).select(F.col("id").alias("node_id"))


def pairs(nodes: DataFrame) -> DataFrame:
    """``node_id, signature, code, documentation, doc_from``: the pairs whose documentation has substance.

    ``code`` is null for a node without a File row or without a match in its file.
    """
    funcs = functions(nodes)
    src = _by_source(funcs.select("id", "name", "file_path", "start_line"), nodes, with_code=True).withColumnRenamed("told", "src_told")
    both = funcs.join(src, "id", "left")

    @F.pandas_udf("string")
    def clean(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: bare(d).strip() if isinstance(d, str) else None)

    return both.where(F.col("told") | F.col("src_told")).select(
        F.col("id").alias("node_id"),
        "signature",
        "code",
        F.when(F.col("told"), clean("description")).otherwise(F.col("doc")).alias("documentation"),
        F.when(F.col("told"), F.lit("description")).otherwise(F.lit("source")).alias("doc_from"),
    )
