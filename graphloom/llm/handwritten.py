"""Source files that were not written by hand: generated, minified, vendored, data kept as code.

Notices are found by one multi-pattern automaton over the comments that open and close a file, however
long they are; each hit names the kind of notice it may belong to, and only the sentence around it is
read for that kind, which tells a notice ("code generated by x") from a mention ("helpers that find
@generated files").  Path rules know vendored directories,
lockfiles and the suffixes of generators and minifiers.  The shape of the whole text tells minified
code and data kept as code.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import file_rows, spread

# Fragments that every notice contains one of, by the kind of notice; the automaton looks for these.
TRIGGERS = """
[generated]
@generated
generated by
generated from
generated with
generated using
generated file
generated code
generated automatically
automatically generated
auto-generated
autogenerated
auto generated
machine generated
machine-generated
machine-made
machine made
code generated
[no edit]
do not edit
do not modify
don't edit
dont edit
not edit
not modify
manual changes
changes will be lost
changes are lost
will be overwritten
are overwritten
overwritten on
overwritten by
[generated]
output of
produced from
produced by
emitted by
emitted from
rendered by
rendered from
compiled from
compiled by
transpiled
created by
built by
written by
rebuilt by
wrote this
made this
built this
created this
generated this
produced this
emitted this
regenerated
parser tables
.proto
automatisch erzeugt
automatisch generiert
automatisch erstellt
erzeugt von
erzeugt durch
erzeugt aus
generiert von
generiert durch
generiert aus
erstellt von
erstellt durch
erstellt aus
generado por
generado autom
creado por
creado autom
producido por
producido autom
emitido por
emitido autom
généré
genere par
produit par
produite par
créé par
créée par
émis par
bundled by
bundled from
bundled with
rendered with
rendered using
compiled with
compiled using
produced with
created with
created from
built with
built from
emitted with
written from
source:
[copied]
copied verbatim
copied from
copied unmodified
verbatim copy
verbatim from
taken unmodified
taken verbatim
unmodified copy
unmodified from
vendored from
vendored copy
imported unmodified
imported verbatim
mirrored from
upstream
kopiert aus
kopiert von
übernommen aus
übernommen von
copiado de
copiado literalmente
copié de
copié tel
copied as
copied unchanged
taken unchanged
taken from
taken as
lifted from
imported from
imported unchanged
imported as
mirrored unchanged
mirrored verbatim
mirrored unmodified
mirrored out
vendored unmodified
vendored verbatim
vendored unchanged
copied out
taken out
lifted out
vendored out
verbatim copy of
[rights]
(c)
©
released under
licensed under
all rights reserved
copyright
""".strip().split("\n")

_VERSIONED = r"[\w@./-]+ v?\d+(?:\.\d+)+"

# Sentences that state that this very file comes from a tool.
GENERATED = re.compile(
    r"""
    ^\W*@generated\b (?! \s+(?:files?|code|sources?|markers?|tags?|regions?)\b)
  | \bcode\s+generated\s+(?:by|from)\b
  | ^\W*(?:this|the)\s+(?:file|module|class|code|header|client|source)\s+(?:is|was|has\s+been)\s+(?:(?:auto(?:matically)?|machine)[\s-]*)?(?:generated|produced|created|emitted|rendered|compiled)\s+(?:automatically\s+)?(?:by|from|with|using|out\s+of)\b
  | ^\W*(?:this|the)\s+(?:file|module|class|code|header|client|source)\s+(?:is|was|has\s+been)\s+(?:auto(?:matically)?|machine)[\s-]*generated\b
  | ^\W*(?:auto(?:matically)?|machine)[\s-]?(?:generated|made|written|produced|created)\b (?! \s+(?:method|function|constructor|catch)\b)
  | ^\W*(?:generated|regenerated|rendered|emitted|compiled|transpiled|bundled|produced|built|created)\s+(?:automatically\s+|code\s+)?(?:by|from|with|using|out\s+of)\b
  | ^\W*[\w@./-]+\s+v?\d[\w.]*\s+(?:wrote|made|generated|produced|emitted|created|rendered|built)\s+this\s+(?:file|module|class|code|source)
  | ^\W*output\s+of\s+\S+
  | ^\W*(?:parser|lexer|state|lookup)\s+tables\s+(?:for|of|from)\s+\S+\.\w+
  | ^\W*source:\s*\S+\.(?:proto|thrift|avsc|fbs|graphql|idl|g4|gk|xsd|wsdl)\b
  | ^\W*end\s+of\s+\w+:\s+(?:emitted|generated|produced)\s+by\b
  | \b(?:emitted|generated|produced|rendered|written)\s+by\s+\S+\s+(?:v?\d\S*\s+)?(?:from|out\s+of)\s+\S+
  | \bautomatisch\s+(?:erzeugt|generiert|erstellt)\b
  | \b(?:erzeugt|generiert|erstellt)\s+(?:von|durch|aus)\s+\S+.*\bnicht\s+(?:bearbeiten|ändern)\b
  | \b(?:generado|creado|producido|emitido)\s+(?:autom\S+\s+)?por\s+\S+
  | \b(?:généré|produit|créé|émis)e?\s+(?:automatiquement\s+)?par\s+\S+
    """,
    re.I | re.X | re.S,
)
#: A plain ban on editing counts only if it speaks of this file.
NO_EDIT = re.compile(
    r"^\W*(?:do\s+not|don'?t|never)\s+(?:edit|modify|change)(?:\s+(?:this\s+file|by\s+hand|manually|it)\b|\s*[.!;,-]|\W*$)"
    r"|\bDO\s+NOT\s+(?:EDIT|MODIFY)\b(?!\s+files)|^\W*(?:manual|hand|local)\s+(?:changes|edits)\s+(?:will\s+be|are|get)\s+(?:lost|overwritten)"
    r"|\bchanges\s+(?:are|will\s+be|get)\s+(?:overwritten|lost)\b",
    re.I,
)
# What turns a notice into its opposite or into a mention.
DENIED = re.compile(
    r"\b(?:not|never|no\s+longer|isn'?t|wasn'?t|once|formerly|originally|previously|used\s+to\s+be|initially|first)\s+(?:auto(?:matically)?[\s-]*|machine[\s-]*)?(?:generated|vendored|copied|produced|emitted|created|rendered)"
    r"|\bmaintained\s+by\s+hand|\bedit\s+freely|\bhand[\s-]?(?:written|maintained|edited)\b|\bwritten\s+(?:by\s+hand|for\s+this\s+(?:package|repository|project))"
    r"|\breplaces\s+the\s+(?:vendored|generated|copied|bundled)|\bnicht\s+(?:generiert|erzeugt)|\bno\s+(?:fue\s+|está\s+)?generado|\bpas\s+(?:été\s+)?généré"
    r"|\bthis\s+(?:script|tool|command|module|helper|job)\s+(?:re)?(?:builds|generates|writes|creates|makes|emits)",
    re.I,
)
# Sentences that state that this file is somebody else's.
COPIED = re.compile(
    r"""
    \bcopied\s+(?:verbatim|unmodified|unchanged|as\s+is)\b
  | ^\W*(?:copied|taken|imported|mirrored|vendored|lifted)\s+(?:verbatim\s+|unmodified\s+|unchanged\s+|as\s+is\s+)?(?:from|out\s+of)\s+(?:the\s+)?[\w@./-]+\s+v?\d
  | ^\W*(?:taken|imported|mirrored|vendored)\s+(?:verbatim|unmodified|unchanged)\b
  | ^\W*(?:verbatim|unmodified|vendored)\s+copy\s+of\b
  | \breport\s+(?:bugs|issues)\s+(?:to\s+)?upstream\b | ^\W*upstream:\s*\S+
  | ^\W*(?:unverändert\s+)?(?:kopiert|übernommen)\s+(?:aus|von)\b | ^\W*copiado\s+(?:literalmente\s+)?de\b | ^\W*copié\s+(?:tel\s+quel\s+)?de\b
    """,
    re.I | re.X,
)
OWN_RIGHTS = re.compile(r"maintainers\s+of\s+this\s+repository|\bthis\s+(?:repository|project)\b", re.I)
RIGHTS = re.compile(r"\bcopyright\b|\(c\)|©|\breleased\s+under\b|\blicensed\s+under\b|\ball\s+rights\s+reserved\b", re.I)
BANNER = re.compile(rf"^\W*{_VERSIONED}\b", re.I)

# Path rules.
VENDOR_DIRS = frozenset(
    "vendor third_party third-party thirdparty 3rdparty 3rd_party node_modules bower_components jspm_packages godeps extern external externals "
    "deps _vendor _vendored vendored pods carthage site-packages dist-packages .cargo .bundle elm-stuff".split()
)
ALWAYS_VENDOR_DIRS = frozenset("node_modules bower_components jspm_packages godeps site-packages dist-packages pods carthage".split())
LOCKFILE = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|composer\.lock|gemfile\.lock|cargo\.lock|poetry\.lock|"
    r"pipfile\.lock|pdm\.lock|uv\.lock|go\.sum|gradle\.lockfile|packages\.lock\.json|mix\.lock|pubspec\.lock|flake\.lock|podfile\.lock|deno\.lock|"
    r"[\w-]+\.lock\.json|[\w-]+-lock\.(?:json|ya?ml))$",
    re.I,
)
SUFFIX = re.compile(
    r"(?:[.-](?:min|bundle|pack)\.(?:js|mjs|cjs|css)|\.(?:js|css)\.map|[._](?:gen|generated|g)\.(?:ts|tsx|js|go|py|java|rs|dart|cs)|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h|ts)|"
    r"_grpc_pb\.(?:ts|js|d\.ts)|_pb\.(?:ts|js|d\.ts)|\.snap|\.designer\.cs)$",
    re.I,
)
GENERATED_DIRS = frozenset("__generated__ __snapshots__".split())
CODE = frozenset("ts tsx js jsx mjs cjs py java go rs css c h cc cpp hpp cs rb php kt swift scala sh sql less scss vue".split())

_COMMENT = re.compile(r"^\s*(?://[/!]?|#!?|/\*[*!]?|\*/?|--|;+|%+|<!--|\"\"\"|'''|\{-|REM\b)\s?", re.I)
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`')
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]+-----.*?-----END [A-Z0-9 ]+-----", re.S)
_DATA = re.compile(
    r"""[A-Za-z0-9+/=_-]{64,}                                     # one long encoded run
      | ^\s*["'][A-Za-z0-9+/=]{40,}["'][,+)\s\\]*$                   # a line of an encoded text
      | (?:(?:0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*[,;]\s*){6,}   # numbers in a row
      | (?:\\x[0-9a-fA-F]{2}.*){2,}                                 # escaped bytes
      | (?:\{\s*"[\w-]+"\s*:\s*[^{}]*\}\s*,?\s*){1,}                # rows of records
      | ^\s*INSERT\s+INTO\b.*\bVALUES\b
      | ^\s*\(?(?:\s*(?:-?\d[\d.]*|'[^']*'|"[^"]*"|null|true|false)\s*,){4,}""",
    re.I | re.X,
)
#: A file is data, or minified, if this part of its text is.
SHARE = 0.5
#: A line longer than this without its string literals is no line of hand-written code.
LONG_LINE = 240


def _automaton() -> ahocorasick.Automaton:
    """All triggers; what a hit yields is the length and the kind of notice."""
    a = ahocorasick.Automaton()
    kind = ""
    for t in TRIGGERS:
        if t.startswith("["):
            kind = t.strip("[]")
        elif t.strip():
            a.add_word(t.strip(), (len(t.strip()), kind))
    a.make_automaton()
    return a


_PREAMBLE = re.compile(r"\s*(?:package\b|import\b|from\s+\S+\s+import\b|use\s|using\s|require\b|extern\s+crate\b|#include\b|#!|<\?xml|<!doctype|[\"']use\s)", re.I)
_OPENS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "{-": "-}"}
_OPEN = re.compile(r"\s*[rRuUbB]?(/\*|<!--|\"\"\"|'''|\{-)")


def _areas(content: str) -> tuple[list[str], list[str]]:
    """The comment lines that open a file, above and among what it imports, and those that close it."""
    lines = content.replace("\r\n", "\n").split("\n")
    head: list[str] = []
    closing = None
    i = 0
    while i < len(lines):
        ln = lines[i]
        if closing:
            head.append(ln)
            if closing in ln:
                closing = None
        elif not ln.strip():
            pass
        elif m := _OPEN.match(ln):
            head.append(ln)
            if _OPENS[m[1]] not in ln[m.end():]:
                closing = _OPENS[m[1]]
        elif _COMMENT.match(ln):
            head.append(ln)
        elif not _PREAMBLE.match(ln):
            break
        i += 1
    foot: list[str] = []
    k = len(lines) - 1
    while k >= i and (not lines[k].strip() or _COMMENT.match(lines[k])):
        if lines[k].strip():
            foot.append(lines[k])
        k -= 1
    return head, foot[::-1]


def comment_sentences(lines: list[str]) -> list[str]:
    """The text of the comment lines, without their marks."""
    out = []
    for ln in lines:
        m = _COMMENT.match(ln)
        body = (ln[m.end():] if m else ln).strip().rstrip("*/-> ").strip()
        if body:
            out.append(body)
    return out


def path_reason(path: str) -> str | None:
    """``vendored``, ``lockfile`` or ``suffix`` where the path alone tells; else None."""
    parts = path.split("/")
    low = [p.lower() for p in parts[:-1]]
    for i, p in enumerate(low):
        # a package's own folder lies below a vendor folder; a file straight in it may be about vendors
        if p in VENDOR_DIRS and (p in ALWAYS_VENDOR_DIRS or i + 1 < len(low)):
            return "vendored"
    if LOCKFILE.search(path):
        return "lockfile"
    if SUFFIX.search(path) or GENERATED_DIRS & set(low):
        return "suffix"
    return None


def notice_reason(content: str, automaton: ahocorasick.Automaton) -> str | None:
    """``generated`` or ``copied`` where a notice in the opening or closing comments says so; else None."""
    head, foot = _areas(content)
    block = comment_sentences(head)
    said = block + comment_sentences(foot)
    text = "\n".join(said).lower()
    if len(text) != sum(map(len, said)) + max(0, len(said) - 1):  # lower case may be longer in rare scripts
        said = text.split("\n")
    ends = list(accumulate(len(s) + 1 for s in said))
    kinds: dict[int, set[str]] = {}
    for end, (_, kind) in automaton.iter(text):
        kinds.setdefault(bisect_right(ends, end), set()).add(kind)
    if not kinds or DENIED.search(" ".join(said)):
        return None
    for k in sorted(kinds):
        if ("generated" in kinds[k] and GENERATED.search(said[k])) or ("no edit" in kinds[k] and NO_EDIT.search(said[k])):
            return "generated"
        if "copied" in kinds[k] and COPIED.search(said[k]):
            return "copied"
    if any("rights" in v for v in kinds.values()):
        top = " ".join(block)
        if RIGHTS.search(top) and not OWN_RIGHTS.search(top) and any(BANNER.search(s) for s in block):
            return "copied"
    return None


def shape_reason(path: str, content: str) -> str | None:
    """``data`` or ``minified`` where the greater part of the text is; else None.  Code files only."""
    ext = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if ext not in CODE:
        return None
    body = _PEM.sub("", content.replace("\r\n", "\n"))
    total = data = dense = 0
    for ln in body.split("\n"):
        n = len(ln.strip())
        total += n
        if _DATA.search(ln):
            data += n
        if n > LONG_LINE:
            bare = _STRING.sub('""', ln)
            if len(bare) > LONG_LINE and sum(c.isspace() for c in bare) < 0.13 * len(bare):
                dense += n
    if total and dense > SHARE * total:
        return "minified"
    if data > SHARE * total:
        return "data"
    return None


def reason(path: str | None, content: str, automaton: ahocorasick.Automaton) -> str | None:
    p = path or ""
    return path_reason(p) or notice_reason(content, automaton) or shape_reason(p, content)


def classify_files(nodes: DataFrame) -> DataFrame:
    """``node_id, file_path, reason`` per File node with content; ``reason`` is null for hand-written files.

    Reasons: ``vendored``, ``lockfile``, ``suffix`` (path rules), ``generated``, ``copied`` (notices),
    ``minified``, ``data`` (shape of the whole text).  Of repeated ids the row with more non-null
    fields counts.  A null path leaves the notices and nothing else; empty content is hand-written.
    Nodes without an id, of other kinds or without content give no row.
    """
    rows = spread(file_rows(nodes))
    done = _classified(rows)
    best = done.groupBy("id").agg(F.max_by(F.struct("file_path", "has", "reason"), F.struct("n", "h")).alias("b"))
    return best.where("b.has").select(F.col("id").alias("node_id"), "b.file_path", "b.reason")


def _classified(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def why(paths, contents):
        a = _cached()
        return pd.Series([
            (reason(p if isinstance(p, str) else "", c, a) if isinstance(c, str) else None) for p, c in zip(paths, contents)
        ], dtype=object)

    return rows.select(
        "id", "file_path", F.col("content").isNotNull().alias("has"), F.col("rank.n").alias("n"), F.col("rank.h").alias("h"),
        why("file_path", "content").alias("reason"),
    )


_CACHE: list = []


def _cached() -> ahocorasick.Automaton:
    if not _CACHE:
        _CACHE.append(_automaton())
    return _CACHE[0]


def not_handwritten(nodes: DataFrame) -> DataFrame:
    """``node_id`` of each File node that was not written by hand."""
    return classify_files(nodes).where("reason is not null").select("node_id")
