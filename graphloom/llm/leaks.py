"""Evaluation texts leaking into training text.

Both sides become rows of normalised words.  Windows of the size of an item (at most 20 words) slide
over the documents.  A window that can match must hold nearly only words of the items, which a running
count tells exactly; what stays goes through the CGK random walk, which maps edit distance to Hamming
distance, and repeated bit sampling of its output, looked up in tables of the items' own windows.
Every candidate is verified by its word edit distance.

The items are a stated query set: they are sent to the executors in blocks of bounded size, and the
documents never leave the task that reads them.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import spread

#: Successive words that make a passage; a shorter item counts whole.
WORDS = 20
#: Words of which one may be replaced.
PER_EDIT = 10
#: Items sent to the executors at once; more are handled in further blocks over the same documents.
BLOCK = 20_000
#: Characters of text searched at once.
LOT_CHARS = 2_000_000
#: Independent random walks, samplings of each, and sampled positions per sampling.
WALKS, SAMPLINGS, POSITIONS = 4, 5, 4
#: Items that must open alike for the opening to be a standard instruction, and its least words.
SHARED_OPENING, OPENING_WORDS = 3, 5
#: Words of its own that a window with part of the instruction must hold.  Fewer are the stock openings of other
#: questions after the same instruction, not a passage of this item.
OWN_WORDS = 8

_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_SPACED = re.compile(r"\\[nrt]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_TAGS = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>")
_LEADS = re.compile(
    r"^[ \t]*(?:(?:[>|*+#•·–-]+|//+|--|;+|%+|\d{1,4}[.):|](?=\s)|L?\d{1,5}:(?=\s)|\[?\(?\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\)?\]?|\[\d{1,4}\]|\[[ xX]\]|[A-Za-z][.)](?=\s))[ \t]*)+", re.M
)
_SPLIT = re.compile(r"[\s|]+")
_JUNK = re.compile(r"[\W_]+")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")


def words_of(text: str) -> list[str]:
    """The words of a text regardless of case, spacing, punctuation, line marks and escapes."""
    s = text
    if "&" in s:
        s = html.unescape(html.unescape(s))
    if "\\" in s:
        s = _ESCAPES.sub(lambda m: chr(int(m[1] or m[2], 16)), s)
        s = _SPACED.sub(" ", s)
    if "%" in s and len(_PERCENT.findall(s)) > 2:
        s = unquote(s)
    s = _HIDDEN.sub("", s)
    if "<" in s:
        s = _TAGS.sub(" ", s)
    s = _LEADS.sub(" ", s)
    return [w for w in (_JUNK.sub("", t) for t in _SPLIT.split(s.casefold())) if w]


def _hashes(words: list[str], memo: dict[str, int]) -> np.ndarray:
    out = np.empty(len(words), dtype=np.uint64)
    for i, w in enumerate(words):
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixer: each symbol's random bits for one walk."""
    with np.errstate(over="ignore"):
        z = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def sampled(n: int) -> np.ndarray:
    """The sampled positions of the walk's output, ``[walk, sampling, position]``, for windows of n words."""
    rng = np.random.default_rng(20_000 + n)
    # the walk moves on every second step: later outputs are mostly padding
    return np.stack([np.stack([np.sort(rng.choice(2 * n, POSITIONS, replace=False)) for _ in range(SAMPLINGS)]) for _ in range(WALKS)])


def embed_keys(symbols: np.ndarray, starts: np.ndarray, n: int, positions: np.ndarray | None = None) -> np.ndarray:
    """Keys ``[window, walk * sampling]`` of the windows of n symbols at ``starts``."""
    pos = sampled(n) if positions is None else positions
    keys = np.zeros((len(starts), WALKS * SAMPLINGS), dtype=np.uint64)
    for w in range(WALKS):
        bits = _mix(symbols, 101 + w)
        more = _mix(symbols, 501 + w)
        i = np.zeros(len(starts), dtype=np.int64)
        last = int(pos[w].max()) + 1
        uses: dict[int, list[int]] = defaultdict(list)
        for s in range(SAMPLINGS):
            for p in pos[w, s]:
                uses[int(p)].append(s)
        for j in range(last):
            live = i < n
            at = starts + np.minimum(i, n - 1)
            if j in uses:
                sym = np.where(live, symbols[at], np.uint64(0))
                with np.errstate(over="ignore"):
                    for s in uses[j]:
                        k = w * SAMPLINGS + s
                        keys[:, k] = _mix(keys[:, k] ^ sym, j + 1)
            word = bits if j < 64 else more
            step = (word[at] >> np.uint64(j % 64)) & np.uint64(1)
            i += np.where(live, step, 0).astype(np.int64)
    for k in range(keys.shape[1]):
        keys[:, k] = _mix(keys[:, k], 7_000 + k)
    return keys


def within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two rows of words is at most ``most`` (banded)."""
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= most:
        return True
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != b[j - 1]))
        if min(cur) > most:
            return False
        prev = cur
    return prev[-1] <= most


class ItemIndex:
    """Windows of a block of items in sampling tables."""

    def __init__(self, rows: list[tuple[int, str]], instruction: dict[int, int] | None = None) -> None:
        self.memo: dict[str, int] = {}
        self.words: list[list[str]] = [words_of(t) for _, t in rows]
        self.ids = [i for i, _ in rows]
        lead = defaultdict(int, instruction or {})
        self.tables: dict[int, tuple] = {}
        self.sets: dict[tuple[int, int, int], frozenset] = {}
        vocabulary: set[int] = set()
        at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.symbols: list[np.ndarray] = []
        for k, w in enumerate(self.words):
            h = _hashes(w, self.memo)
            self.symbols.append(h)
            if not len(w):
                continue
            vocabulary.update(h.tolist())
            n = min(WORDS, len(w))
            rest = len(w) - lead[k]
            if lead[k] and rest < WORDS:  # what the instruction leaves of the item is short, and counts whole
                at[rest].append((k, lead[k], 0))
            for s in range(len(w) - n + 1):
                own = min(n, s + n - lead[k])
                if own < min(n, OWN_WORDS):
                    continue
                at[n].append((k, s, max(0, lead[k] - s)))
        self.vocabulary = np.array(sorted(vocabulary), dtype=np.uint64)
        for n, places in at.items():
            flat = np.concatenate([self.symbols[k][s:s + n] for k, s, _ in places])
            keys = embed_keys(flat, np.arange(len(places)) * n, n)
            tables = []
            for c in range(keys.shape[1]):
                order = np.argsort(keys[:, c], kind="stable")
                tables.append((keys[order, c], order))
            self.tables[n] = (places, tables)

    def search(self, text: str) -> set[int]:
        """Positions of the items that the text leaks."""
        return {k for _, k in self.search_all([text])}

    def search_all(self, texts: list[str]) -> set[tuple[int, int]]:
        """``(position of the text, position of the item)`` of all leaks, found over all texts at once.

        The texts lie behind each other with gaps of unknown symbols, wide enough that no window of one
        text reaches the next.
        """
        found: set[tuple[int, int]] = set()
        if not len(self.vocabulary) or not texts:
            return found
        if len(self.memo) > 2_000_000:
            self.memo = {}
        gap = np.zeros(WORDS + WORDS // PER_EDIT, dtype=np.uint64)
        parts, bounds, at = [], [], 0
        for t in texts:
            h = _hashes(words_of(t), self.memo)
            parts += [h, gap]
            bounds.append((at, at + len(h)))
            at += len(h) + len(gap)
        sym = np.concatenate(parts)
        first = np.array([b[0] for b in bounds])
        where = np.searchsorted(self.vocabulary, sym)
        known = self.vocabulary[np.minimum(where, len(self.vocabulary) - 1)] == sym
        total = np.concatenate([[0], np.cumsum(known)])
        for n, (places, tables) in self.tables.items():
            edits = n // PER_EDIT
            starts = np.nonzero(total[n:] - total[:-n] >= n - edits)[0] if len(sym) >= n else np.zeros(0, dtype=np.int64)
            for lot in range(0, len(starts), 200_000):
                mine = starts[lot:lot + 200_000]
                keys = embed_keys(sym, mine, n)
                seen: set[tuple[int, int]] = set()
                for c, (table, order) in enumerate(tables):
                    lo = np.searchsorted(table, keys[:, c], side="left")
                    hit = np.nonzero((lo < len(table)) & (table[np.minimum(lo, len(table) - 1)] == keys[:, c]))[0]
                    if not len(hit):
                        continue
                    hi = np.searchsorted(table, keys[hit, c], side="right")
                    for i, end in zip(hit.tolist(), hi.tolist()):
                        p = int(mine[i])
                        for o in order[lo[i]:end].tolist():
                            if (p, o) in seen:
                                continue
                            seen.add((p, o))
                            k, s, opening = places[o]
                            d = int(np.searchsorted(first, p, side="right")) - 1
                            if (d, k) not in found and self._same(k, s, n, opening, sym, p, edits, bounds[d][1]):
                                found.add((d, k))
        return found

    def _same(self, k: int, s: int, n: int, opening: int, sym: np.ndarray, at: int, edits: int, stop: int) -> bool:
        mine = self.symbols[k][s:s + n].tolist()
        words = self.sets.get((k, s, n))
        if words is None:
            words = self.sets[(k, s, n)] = frozenset(mine)
        # an edit takes away one word at most, so most false candidates end here
        if len(words.intersection(sym[at:min(at + n + 1, stop)].tolist())) < len(words) - edits:
            return False
        sizes = range(n, n - edits - 1, -1) if at + n > stop else (n, n - 1, n + 1) if edits else (n,)
        for size in sizes:
            theirs = sym[at:min(at + size, stop)].tolist()
            if not within(mine, theirs, edits):
                continue
            # words of its own must match for themselves: the instruction alone is no passage
            if opening <= 0 or within(mine[opening:], theirs[max(0, opening + len(theirs) - n):], (n - opening) // PER_EDIT):
                return True
        return False


def leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id``: the documents that hold a passage of an item.

    A passage is 20 successive words of the item, or the whole item (without a standard instruction)
    where it is shorter, with at most one word in ten replaced.  Null and empty texts on either side hold nothing and leak nothing; a
    repeated document or item gives its rows under each of its ids, once.
    """
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    n_blocks = max(1, -(-rows.count() // block))
    led = with_leads(rows)
    out: DataFrame | None = None
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    docs = spread(docs)
    for b in range(n_blocks):
        mine = [(r["item_id"], r["text"], r["lead"]) for r in led.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()]
        # a block has a bound; it is sent to each executor once
        sent = documents.sparkSession.sparkContext.broadcast(mine)
        part = docs.mapInPandas(_searcher(sent), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def with_leads(rows: DataFrame) -> DataFrame:
    """``item_id, text, lead``: how many words of each item are a standard instruction.

    That is the longest opening, up to any end of a sentence, that several items share, whatever number of
    sentences it has; an item that is nothing else has none.
    """

    @F.pandas_udf("array<struct<h:long,n:int>>")
    def heads(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words, n, at, done, got = words_of(t), 0, 0, 0, []
            h = xxhash.xxh64()
            for m in re.finditer(r"[.!?:](?=\s)", t):
                n += len(words_of(t[at:m.end()]))
                at = m.end()
                if n >= len(words):
                    break
                for w in words[done:n]:
                    h.update(w + " ")
                done = n
                if n >= OPENING_WORDS:
                    got.append({"h": h.intdigest() - (1 << 63), "n": n})
            out.append(got)
        return pd.Series(out)

    opened = rows.select("item_id", "text", F.explode(heads("text")).alias("o")).select("item_id", "text", "o.h", "o.n")
    shared = opened.groupBy("h", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SHARED_OPENING)
    longest = opened.join(shared, ["h", "n"]).groupBy("item_id", "text").agg(F.max("n").alias("lead"))
    return rows.join(longest, ["item_id", "text"], "left").select("item_id", "text", F.coalesce("lead", F.lit(0)).alias("lead"))


def _searcher(sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(i, t) for i, t, _ in sent.value]
        index = ItemIndex(rows, {k: n for k, (_, _, n) in enumerate(sent.value)})
        for b in batches:
            # texts of some megabytes at once, however long single ones are
            ids, texts = b["doc_id"].tolist(), b["text"].tolist()
            got, lot, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > LOT_CHARS or i == len(texts) - 1:
                    got += [(ids[lot + d], index.ids[k]) for d, k in index.search_all(texts[lot:i + 1])]
                    lot, size = i + 1, 0
            yield pd.DataFrame(got, columns=["doc_id", "item_id"]).astype({"doc_id": "int64", "item_id": "int64"})

    return run
