"""Splitting oversized chunks at natural boundaries by packing the tree of their structure.

A chunk's text is parsed into a tree: headings over paragraphs, list items and fences over lines in
prose, elements by their tags in markup, blocks over statements by indentation in code.  Subtrees of siblings are merged bottom-up as long as
they fit; only a node that does not fit is opened.  A single line that does not fit is cut at its
statements, then at blanks, and only then between characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import file_rows

#: Bytes a piece may have, and bytes it may repeat of the piece before.
LIMIT = 4096
OVERLAP = 256

_HEADING = re.compile(rb"(#{1,6})\s")
_FENCE = re.compile(rb"\s*(```|~~~)")
_STATEMENT = re.compile(rb"[;}\]](?=[^;}\],.)])|[.!?](?=\s)|\},|\],|,(?=\{)")
_CLOSER = re.compile(rb"[\])}]|end\b|</")
_ITEM = re.compile(rb"[ \t]*(?:[-*+]|\xe2\x80\xa2|\d{1,4}[.)]|[A-Za-z][.)])[ \t]")
_ELEMENT = re.compile(rb"<(/)?([A-Za-z][\w:.-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(/)?>")
_VOID = frozenset((b"area", b"base", b"br", b"col", b"embed", b"hr", b"img", b"input", b"link", b"meta", b"source", b"track", b"wbr"))
_PROSE = frozenset(("md", "markdown", "txt", "rst", "adoc"))
_MARKUP = frozenset(("html", "htm", "xhtml", "xml", "svg", "vue", "xsd", "xsl", "wsdl", "plist", "csproj"))


class Node:
    """A stretch ``[start, end)`` with its own line first, then its children."""

    __slots__ = ("children", "depth", "end", "head", "start")

    def __init__(self, depth: int, start: int, head: int) -> None:
        self.depth, self.start, self.head, self.end = depth, start, head, head
        self.children: list[Node] = []


def tree_of(data: bytes, kind: str) -> Node:
    """The structure of a text as a tree of lines; blank lines belong to what stands before them.

    ``kind`` is ``prose``, ``markup`` or ``code``: each line gets a depth, and is a child of the nearest
    line before it that is less deep.
    """
    root = Node(-1, 0, 0)
    stack = [root]
    at = 0
    depth_of = {"prose": _prose_depths, "markup": _markup_depths}.get(kind, _code_depths)(data)
    for line in data.splitlines(keepends=True):
        end = at + len(line)
        depth = next(depth_of)
        if depth is None:
            for n in stack:
                n.end = end
            if not stack[-1].children and stack[-1] is not root:
                stack[-1].head = end
        else:
            while stack[-1].depth >= depth and stack[-1] is not root:
                stack.pop()
            node = Node(depth, at, end)
            stack[-1].children.append(node)
            stack.append(node)
            for n in stack:
                n.end = end
        at = end
    root.end = len(data)
    return root


def _indent(line: bytes) -> int:
    return len(line) - len(line.lstrip(b" \t"))


def _code_depths(data: bytes) -> Iterator[int | None]:
    """By indentation; what closes a block belongs to it."""
    for line in data.splitlines(keepends=True):
        bare = line.strip()
        yield _indent(line) + (1 if _CLOSER.match(bare) else 0) if bare else None


def _prose_depths(data: bytes) -> Iterator[int | None]:
    """Headings 1 to 6; paragraphs, list items and fences below them; their lines below these."""
    fenced, open_paragraph = False, False
    for line in data.splitlines(keepends=True):
        bare, indent = line.strip(), _indent(line)
        if not bare:
            open_paragraph = open_paragraph and fenced
            yield None
        elif _FENCE.match(line):
            fenced = not fenced
            open_paragraph = not fenced
            yield 20 + indent if fenced else 41 + indent
        elif fenced:
            yield 42 + indent
        elif m := _HEADING.match(line):
            open_paragraph = False
            yield len(m[1])
        elif _ITEM.match(line):
            open_paragraph = True
            yield 12 + indent
        elif open_paragraph:
            yield 10_000 + indent
        else:
            open_paragraph = True
            yield 10 if not indent else 13 + indent


def _markup_depths(data: bytes) -> Iterator[int | None]:
    """By the elements that are open where a line begins; what closes an element belongs to it."""
    open_ = 0
    for line in data.splitlines(keepends=True):
        if not line.strip():
            yield None
            continue
        steps = [(-1 if t[1] else 0 if t[4] or t[2].lower() in _VOID else 1) for t in _ELEMENT.finditer(line)]
        lead = 0
        for x in steps:  # tags that close before the line opens any
            if x >= 0:
                break
            lead += 1
        yield 2 * max(0, open_ - lead) + (1 if lead else 0)
        open_ = max(0, open_ + sum(steps))


def _cut_line(data: bytes, start: int, end: int, room: int) -> list[tuple[int, int]]:
    """A single oversized line in pieces: at statements, else at blanks, else between characters."""
    out = []
    while end - start > room:
        window = data[start:start + room]
        at = 0
        for m in _STATEMENT.finditer(window):
            at = m.end()
        if not at:
            at = max(window.rfind(b" "), window.rfind(b"\t")) + 1
        if not at:
            at = room
            while at > 1 and (data[start + at] & 0xC0) == 0x80:
                at -= 1
        out.append((start, start + at))
        start += at
    out.append((start, end))
    return out


def _merge(parts: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in parts:
        if out and e - out[-1][0] <= room:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def pack(data: bytes, root: Node, room: int) -> list[tuple[int, int]]:
    """Stretches of at most ``room`` bytes that cover the tree, bottom-up without recursion."""
    done: dict[int, list[tuple[int, int]]] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if node.end - node.start <= room:
            done[id(node)] = [(node.start, node.end)]
        elif not ready:
            todo.append((node, True))
            todo.extend((c, False) for c in node.children)
        else:
            parts = _cut_line(data, node.start, node.head, room) if node.head > node.start else []
            for c in node.children:
                parts.extend(done.pop(id(c)))
            done[id(node)] = _merge(parts, room)
    return [p for p in done[id(root)] if p[1] > p[0]]


def _overlap_start(data: bytes, low: int, end: int, overlap: int) -> int:
    """Where the next piece starts: a line within the last ``overlap`` bytes, else a statement, blank or character."""
    at = max(end - overlap, low + 1)
    window = data[at:end - 1]
    line = window.find(b"\n")
    if line >= 0:
        return at + line + 1
    m = _STATEMENT.search(window)
    if m and at + m.end() < end:
        return at + m.end()
    blank = window.find(b" ")
    if blank >= 0 and at + blank + 1 < end:
        return at + blank + 1
    while at < end and (data[at] & 0xC0) == 0x80:
        at += 1
    if at >= end:  # one long character: repeat it whole
        at = end - 1
        while at > low and (data[at] & 0xC0) == 0x80:
            at -= 1
    return at


def split_text(data: bytes, kind: str = "code", limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces ``[start, end)`` of a text: one if it fits, else several that overlap.

    Each piece has at most ``limit`` bytes, begins and ends between characters, and each later one
    repeats between 1 and ``overlap`` bytes of the one before.
    """
    if len(data) <= limit:
        return [(0, len(data))]
    if not 4 <= overlap < limit - 8:
        raise ValueError("the overlap must leave room for text")
    ends = [e for _, e in pack(data, tree_of(data, kind), limit - overlap)]
    out, before = [], 0
    for i, e in enumerate(ends):
        s = 0 if i == 0 else _overlap_start(data, out[-1][0], before, overlap)
        out.append((s, e))
        before = e
    return out


def kind_of(path: str | None) -> str:
    """``prose``, ``markup`` or ``code``, by the ending of the path."""
    ext = (path or "").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    return "prose" if ext in _PROSE else "markup" if ext in _MARKUP else "code"


_CHUNKS = "array<struct<start_byte:bigint,end_byte:bigint,pieces:array<struct<piece:int,piece_start:bigint,piece_end:bigint,text:string>>>>"


def oversized_pieces(chunks: DataFrame, nodes: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """``path, start_byte, end_byte, piece, piece_start, piece_end, text``: the pieces of each oversized chunk.

    Offsets count UTF-8 bytes of the file after CRLF became LF; ``end_byte`` is where the existing
    text ends.  A null ``end_byte`` and one past the end both mean the end of the file; a null
    ``start_byte`` means 0; a negative one is 0; a chunk that starts at or after the end has no text.
    Repeated chunks count once.  Chunks of up to ``limit`` bytes, of null or unknown paths and of
    files without content give no rows.  Only chunks and files that can be oversized leave the scan.
    """
    spans = (
        chunks.where(F.col("path").isNotNull())
        .select("path", F.greatest(F.coalesce("start_byte", F.lit(0)), F.lit(0)).cast("long").alias("s"), F.col("end_byte").cast("long").alias("e"))
        .where(F.col("e").isNull() | (F.col("e") - F.col("s") > limit))
        .groupBy("path")
        .agg(F.collect_set(F.struct("s", F.coalesce("e", F.lit(2**62)).alias("e"))).alias("spans"))
    )
    files = file_rows(nodes).where((F.octet_length("content") > limit) & F.col("file_path").isNotNull()).select(
        F.col("file_path").alias("path"), "content", "rank"
    )

    @F.pandas_udf(_CHUNKS)
    def cut(paths: pd.Series, contents: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for p, c, spans_ in zip(paths, contents, wanted):
            data = c.replace("\r\n", "\n").encode("utf-8", "surrogatepass")
            rows, seen = [], set()
            for w in spans_:
                s, e = int(w["s"]), min(int(w["e"]), len(data))
                if e - s <= limit or (s, e) in seen:
                    continue
                seen.add((s, e))
                found = split_text(data[s:e], kind_of(p), limit, overlap)
                rows.append({
                    "start_byte": s, "end_byte": e,
                    "pieces": [
                        {"piece": i, "piece_start": s + a, "piece_end": s + b, "text": data[s + a:s + b].decode("utf-8", "replace") if with_text else None}
                        for i, (a, b) in enumerate(found)
                    ],
                })
            out.append(rows)
        return pd.Series(out)

    joined = files.join(spans, "path").select("path", "rank", cut("path", "content", "spans").alias("c"))
    best = joined.groupBy("path").agg(F.max_by("c", "rank").alias("c"))
    return best.select("path", F.explode("c").alias("c")).select("path", "c.start_byte", "c.end_byte", F.explode("c.pieces").alias("x")).select(
        "path", "start_byte", "end_byte", "x.*"
    )


def oversized(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, start_byte`` of each chunk that had to be cut into more than one piece."""
    return oversized_pieces(chunks, nodes, with_text=False).where("piece = 1").select("path", "start_byte").distinct()


def coverage(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``path, start_byte, end_byte, covered, within, overlapping``: whether the pieces of each chunk keep what is asked of them.

    ``covered``: from the first byte to the last without a gap; ``within``: none above the limit;
    ``overlapping``: each later piece repeats some, but no more than ``overlap``, bytes of the one before.
    """
    w = Window.partitionBy("path", "start_byte", "end_byte").orderBy("piece")
    before = F.lag("piece_end").over(w)
    own = pieces.select("path", "start_byte", "end_byte", "piece_start", "piece_end", before.alias("b"), F.octet_length("text").alias("n"))
    repeated = F.col("b") - F.col("piece_start")
    return own.groupBy("path", "start_byte", "end_byte").agg(
        ((F.min("piece_start") == F.col("start_byte")) & (F.max("piece_end") == F.col("end_byte")) & F.bool_and(F.coalesce(repeated >= 0, F.lit(True)))).alias("covered"),
        F.bool_and((F.col("n") <= limit) & (F.col("n") == F.col("piece_end") - F.col("piece_start"))).alias("within"),
        F.bool_and(F.coalesce((repeated > 0) & (repeated <= overlap), F.lit(True))).alias("overlapping"),
    )
