"""Grammars of declarations with their documentation, one per language family.

A file is a row of items: a documented declaration, a type that owns declarations, or a stretch that
is neither.  Documentation is the comment block that ends on the line just above the declaration,
with only decorators, annotations or attributes between, or the string that opens a Python body.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from graphloom.llm.peg import Expr, Result, Rule, Run, action, cut, first, many, maybe, seq, term


@dataclass
class Declared:
    """A function or method, with offsets into its file."""

    name: str
    owner: str | None
    arity: int
    line: int
    start: int
    doc: str | None
    params: str


_SPACE = r"[ \t]*"
_EOL = r"[ \t]*\r?\n"


def _balanced(open_: str, close: str) -> Rule:
    """Text between brackets, which may hold strings, comments and brackets, nested to any depth.

    A counter takes the place of recursion, so that the depth of a text never is that of the parser.
    """
    piece = re.compile(
        rf"[^{re.escape(open_ + close)}\"'`/]+"
        r'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'
        r"|//[^\n]*|/\*.*?\*/|.",
        re.S,
    ).match

    def expr(run: Run, pos: int) -> Result:
        text = run.text
        if not text.startswith(open_, pos):
            return None
        depth, at = 0, pos
        while m := piece(text, at):
            at = m.end()
            if m[0] == open_:
                depth += 1
            elif m[0] == close:
                depth -= 1
                if not depth:
                    return at, None
        return None

    return Rule().set(expr)


_PARENS, _SQUARE = _balanced("(", ")"), _balanced("[", "]")


def _arity(params: str) -> int:
    inner = params.strip()[1:-1]
    depth, n, any_ = 0, 0, False
    for c in inner:
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == "," and depth <= 0:
            n += any_
            any_ = False
            continue
        any_ = any_ or not c.isspace()
    return n + any_


def _mark(lead: str, bracket: Rule | None) -> Expr:
    """A decorator, annotation or attribute on lines of its own."""
    return seq(term(_SPACE + lead), maybe(bracket) if bracket else term(""), term(r"[^\n]*\n"))


def _comments(line: str, block: bool) -> Expr:
    one = term(rf"{_SPACE}{line}[^\n]*\n")
    parts = [term(rf"{_SPACE}/\*.*?\*/{_EOL}", re.S)] if block else []
    return many(first(*parts, one), 1)


@dataclass
class Language:
    comment: str
    block: bool
    marks: Expr
    head: str
    owner: str
    receiver: bool = False
    python: bool = False


_NOT_CALLS = r"(?!(?:if|for|while|switch|catch|return|new|throw|await|else|do|try|function|typeof|delete|in|of|case|super|with|yield|assert|print)\b)"
_TS_MODS = r"(?:(?:public|private|protected|static|async|override|readonly|abstract|declare|get|set|export|default)\s+)*"

LANGUAGES: dict[str, Language] = {
    "py": Language(
        r"#", False, _mark(r"@[\w.]+", _PARENS),
        r"(?P<indent>[ \t]*+)(?:async\s+)?def\s+(?P<name>\w+)\s*(?=\()", r"(?P<indent>[ \t]*+)class\s+(?P<name>\w+)", python=True,
    ),
    "ts": Language(
        r"//", True, _mark(r"@[\w.]+", _PARENS),
        rf"(?P<indent>[ \t]*+){_TS_MODS}(?:function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^(\n]*>)?(?=\()"
        rf"|(?:const|let|var)\s+(?P<name2>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\s*\*?\s*[\w$]*\s*)?(?:<[^(\n]*>)?(?=\()"
        rf"|\*?[ \t]*{_NOT_CALLS}(?P<name3>[\w$#]+)\s*(?:<[^(\n]*>)?(?=\())",
        r"(?P<indent>[ \t]*+)(?:(?:export|default|abstract|declare)\s+)*(?:class|interface|namespace|enum)\s+(?P<name>[\w$]+)",
    ),
    "java": Language(
        r"//", True, _mark(r"@(?!interface\b)[\w.]+", _PARENS),
        rf"(?P<indent>[ \t]*+)(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^(\n]*?>\s*)?{_NOT_CALLS}(?:[\w.]+(?:<[^(\n]*>)?(?:\[\])*\s+)?{_NOT_CALLS}(?P<name>[\w$]+)\s*(?=\()",
        r"(?P<indent>[ \t]*+)(?:(?:public|private|protected|static|final|abstract|sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+(?P<name>\w+)",
    ),
    "rs": Language(
        r"//", True, _mark(r"#!?", _SQUARE),
        r"(?P<indent>[ \t]*+)(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+)\s*(?:<[^(\n]*>)?\s*(?=\()",
        r"(?P<indent>[ \t]*+)(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:impl(?:<[^{\n]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?|(?:struct|trait|enum)\s+)(?P<name>\w+)",
    ),
    "go": Language(
        r"//", True, _mark(r"//go:\w+", None),
        r"(?P<indent>[ \t]*+)func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<receiver>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]\n]*\])?\s*(?=\()",
        r"(?P<indent>[ \t]*+)type\s+(?P<name>\w+)", receiver=True,
    ),
}
for _a, _b in (("js", "ts"), ("tsx", "ts"), ("jsx", "ts"), ("mjs", "ts"), ("cjs", "ts"), ("mts", "ts"), ("kt", "java"), ("cs", "java"), ("pyi", "py")):
    LANGUAGES[_a] = LANGUAGES[_b]

_BODY_C = term(r"[^\n{;=]*(?:\{|=>|;|\n)", 0)
_DOCSTRING = term(
    r"[^\n]*?:[ \t]*(?:#[^\n]*)?\r?\n(?:[ \t]*\r?\n)*[ \t]+[rRuUbBfF]{0,2}(?P<q>\"\"\"|'''|\"|')(?P<doc>(?:\\.|(?!(?P=q)).)*)(?P=q)", re.S
)
# the signature of a Python def may close on a later line, but the docstring follows its colon directly
_PY_TAIL = term(r"[ \t]*(?:->[^:\n]+(?:\[[^\n]*?\])?[^:\n]*)?:[ \t]*(?:#[^\n]*)?\r?\n")
_PY_STRING = term(r"[ \t]+[rRuUbBfF]{0,2}(?P<q>\"\"\"|'''|\"|')(?P<doc>(?:\\.|(?!(?P=q)).)*)(?P=q)", re.S)


def _grammar(lang: Language) -> Expr:
    line, block = lang.comment, lang.block
    head = term(lang.head)
    tail: Expr
    if lang.python:
        tail = maybe(seq(_PY_TAIL, maybe(_PY_STRING)))
    else:
        # a body, an arrow or a return type follows; a call would end in a semicolon or go on
        tail = term(r"(?:\s*(?::|->|throws\b|where\b)[^;{]*?|[ \t]*[^;{}()=\n]*|[ \t]*\([^()\n]*\)[ \t]*)\s*(?:\{|=>)|[ \t]*(?::[^;{}\n]*|throws[^;{\n]*)?;?[ \t]*\r?$", re.M)

    def declared(text: str, at: int, end: int, v: list) -> tuple:
        comments, marks, m, params = v[0], v[1], v[2], v[3]
        doc = text[comments[0]:comments[1]] if comments else None
        if lang.python and v[4] and v[4][1] is not None:
            s = v[4][1].group("doc")
            doc = f"{doc}\n{s}" if doc else s
        return ("fn", m, text[params[0]:params[1]], doc)

    span = lambda text, a, b, v: (a, b)
    comment_block = Rule().set(action(_comments(line, block), span))
    fn = Rule().set(
        action(seq(maybe(comment_block), many(lang.marks), head, action(_PARENS, span), tail), declared)
    )
    owner = action(seq(maybe(comment_block), many(lang.marks), term(lang.owner), term(r"[^\n]*\n?")), lambda t, a, b, v: ("owner", v[2]))
    skipped: list[Expr] = [comment_block]
    if lang.python:
        skipped.append(term(r"[^\n\"'#]*[rRuUbBfF]{0,2}(?P<q>\"\"\"|''')(?:\\.|(?!(?P=q)).)*(?P=q)[^\n]*\n?", re.S))
    else:
        skipped.append(term(r"[^\n`\"'/]*`(?:[^`\\]|\\.)*`[^\n]*\n?"))
        skipped.append(term(r"[^\n\"'`/]*/\*.*?\*/[^\n]*\n?", re.S))
    skipped.append(term(r"[^\n]*\n|[^\n]+\Z"))
    return many(cut(first(fn, owner, *[action(s, lambda t, a, b, v: None) for s in skipped])))


_GRAMMARS: dict[str, Expr] = {}


def extension(path: str | None) -> str:
    return (path or "").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def parse(path: str | None, content: str) -> list[Declared]:
    """The declarations of a file in the order of the text; none for languages without a grammar."""
    ext = extension(path)
    lang = LANGUAGES.get(ext)
    if lang is None:
        return []
    if ext not in _GRAMMARS:
        _GRAMMARS[ext] = _grammar(lang)
    text = content.replace("\r\n", "\n")
    run = Run(text)
    end, items = _GRAMMARS[ext](run, 0)
    breaks = [m.start() for m in re.finditer("\n", text)]
    out: list[Declared] = []
    owners: list[tuple[int, str]] = []
    for it in items:
        if it is None:
            continue
        m = it[1]
        indent = len(m.group("indent").expandtabs(4))
        while owners and owners[-1][0] >= indent:
            owners.pop()
        if it[0] == "owner":
            owners.append((indent, m.group("name")))
            continue
        groups = m.groupdict()
        name = groups.get("name") or groups.get("name2") or groups.get("name3")
        receiver = groups.get("receiver")
        start = m.start() + len(m.group("indent"))
        own = receiver or (owners[-1][1] if owners else None)
        out.append(Declared(name, own, _arity(it[2]), bisect_right(breaks, start - 1) + 1, start, it[3], it[2]))
    return out
