"""Mixing sources to target weights.

The records of a source are laid end to end in a pseudorandom order, and the stream of their tokens is
cut into blocks of a fixed number of tokens; a block lists the pieces of records it holds, and only the
last block of a source may be shorter.  Every output shard draws how many of its slots each source gets:
a multinomial draw on the condition that the totals over all shards meet the targets.  It is made by one
pseudorandom permutation of all slots: what a slot is sent to names the source and the ordinal of the
slot within it, so shards agree without talking to each other, at any size.  The ordinal goes through a
pseudorandom permutation of the block indexes, one per source and pass, and the blocks are joined by index.

Nothing is sorted over a whole source: records fall into hash ranges of bounded size, whose totals give
the offsets at which each range starts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.runtime import Staging, small

#: A public byte-level BPE of 50,256 ranks; the place of the vocabulary file on the driver is a parameter.  It is shipped with the job.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLOCK_TOKENS = 256
SLOTS_PER_SHARD = 4096
#: Records of a source per hash range; a range is laid out by one task.
RANGE_RECORDS = 20_000
#: Target sources; a longer list is refused.
SOURCES = 10_000
SEED = 20_240_601

_ENCODERS: dict[str, tiktoken.Encoding] = {}


def encoder(path: str) -> tiktoken.Encoding:
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODERS[path] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def tidy(c: Column) -> Column:
    """The spelling of a source: lower case, blanks and hyphens as one underscore, none at the ends."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), r"[ \-]+", "_"), F.lit(""))


def permuted(q: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` per key, applied to q: Feistel rounds with cycle walking."""
    q, n, key = (np.asarray(x, dtype=np.uint64) for x in (q, n, key))
    out = q.copy()
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64) + 1)) + 1).astype(np.uint64) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    todo = np.ones(len(q), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> half[todo], out[todo] & low[todo]
            for r in range(4):
                z = (right ^ key[todo]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
                z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((z ^ (z >> np.uint64(32))) & low[todo])
            out[todo] = (left << half[todo]) | right
            todo[todo] = out[todo] >= n[todo]
    return out.astype(np.int64)


def shard_slots(shard: int, n_shards: int, totals: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``position, source, ordinal`` of each slot of a shard.

    All shards have ``ceil(slots / n_shards)`` slots or one less.  Over all shards each source i gets each
    ordinal below ``totals[i]`` exactly once, and which shard gets how many is a random draw.
    """
    slots = int(totals.sum())
    at = np.arange(shard * slots // n_shards, (shard + 1) * slots // n_shards, dtype=np.int64)
    to = permuted(at, np.full(len(at), slots), np.full(len(at), seed))
    starts = np.concatenate([[0], np.cumsum(totals)])
    source = np.searchsorted(starts, to, side="right") - 1
    return at - (at[0] if len(at) else 0), source, to - starts[source]


def plan(stats: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int]]:
    """``(source, share, slots)`` from ``(source, target share, repeats, blocks)``.

    Sources without blocks, weight or repeats get no slot; the shares of the others are scaled to one.
    The mix is as large as the scarcest source allows.
    """
    live = [(s, Fraction(p).limit_denominator(10**9), r * b) for s, p, r, b in stats if p and p > 0 and r and r > 0 and b > 0]
    total = sum((p for _, p, _ in live), Fraction(0))
    if not total:
        return []
    slots = min(int(cap * total / p) for _, p, cap in live)
    exact = [(s, p / total, cap, slots * p / total) for s, p, cap in live]
    given = {s: int(x) for s, _, _, x in exact}
    for s, _, cap, x in sorted(exact, key=lambda e: (-(e[3] - int(e[3])), e[0]))[: slots - sum(given.values())]:
        given[s] = min(cap, given[s] + 1)
    return [(s, float(p), given[s]) for s, p, _, _ in exact]


def sized(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of the records with an id, a source and at least one token."""

    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        e = encoder(SparkFiles.get(name))
        return texts.map(lambda t: len(e.encode_ordinary(t)))

    return documents.where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("doc_id").isNotNull()).select(
        "doc_id", tidy(F.col("source")).alias("source"), count("text").alias("n_tokens")
    ).where("source is not null and n_tokens > 0")


class Plan:
    """What a mix is made of: ``pieces`` of records by block, and the ``slots`` of all shards with the block each holds."""

    def __init__(self, pieces: DataFrame, slots: DataFrame, goal: dict[str, float]) -> None:
        self.pieces, self.slots, self.goal = pieces, slots, goal


PIECES = "doc_id long, source string, n_tokens long, block long, first_token long, piece_tokens long"
SLOTS = "shard long, slot long, source string, block long"


def planned(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> Plan:
    """Lays the records out in blocks and the slots over the sources; see :func:`mix` for the cases."""
    spark = documents.sparkSession
    st = Staging(spark, "mix")
    wanted = targets.select(tidy(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in small(wanted, SOURCES, "mix_targets")}
    docs = st.cut(sized(documents, tokenizer).where(F.col("source").isin(list(goal))).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "n_tokens")), "sized")
    have = {r["source"]: (r["n"], r["t"]) for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    given = plan([(s, p, r, -(-have[s][1] // block_tokens)) for s, (p, r) in sorted(goal.items()) if s in have])
    shares_ = {s: goal[s][0] for s, _, _ in given}
    if not given:
        return Plan(spark.createDataFrame([], PIECES), spark.createDataFrame([], SLOTS), {})
    info = spark.createDataFrame([(s, max(1, -(-have[s][0] // RANGE_RECORDS))) for s, _, _ in given], "source string, n_ranges long")

    # where each record starts in the stream of its source: offsets within a range, and totals of the ranges before it
    unit = (F.shiftrightunsigned(F.col("h"), 11).cast("double")) * F.lit(2.0**-53)
    ranged = docs.join(F.broadcast(info), "source").withColumn("range", F.least(F.floor(unit * F.col("n_ranges")), F.col("n_ranges") - 1))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("source", "range").agg(F.sum("n_tokens").alias("t")).select(
        "source", "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base")
    )
    inner = Window.partitionBy("source", "range").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("base") + F.col("upto") - F.col("n_tokens")
    laid = ranged.withColumn("upto", F.sum("n_tokens").over(inner)).join(totals, ["source", "range"]).select("doc_id", "source", "n_tokens", start.alias("start"))
    # a record spans one block or several
    size = F.lit(block_tokens)
    cut = laid.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n_tokens") - 1) / size))).alias("block"))
    first = F.greatest(F.col("block") * size - F.col("start"), F.lit(0))
    pieces = cut.select(
        "doc_id", "source", "n_tokens", "block", first.alias("first_token"), (F.least((F.col("block") + 1) * size - F.col("start"), F.col("n_tokens")) - first).alias("piece_tokens")
    )
    names = [s for s, _, _ in given]
    split = np.array([k for _, _, k in given], dtype=np.int64)
    n_blocks = np.array([-(-have[s][1] // block_tokens) for s in names], dtype=np.int64)
    n_shards = max(1, -(-int(split.sum()) // SLOTS_PER_SHARD))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                slot, i, q = shard_slots(int(shard), n_shards, split, seed)
                nb = n_blocks[i].astype(np.uint64)
                q = q.astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = (q // nb) * np.uint64(0x2545F4914F6CDD1D) + i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
                yield pd.DataFrame({"shard": int(shard), "slot": slot, "source": [names[x] for x in i], "block": permuted(q % nb, nb, key)})

    return Plan(st.cut(pieces, "pieces"), spark.range(n_shards).mapInPandas(draw, SLOTS), shares_)


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, n_tokens, repeats, tokens_used, target_share, actual_share``: the chosen records.

    ``repeats`` is how often a record is used, at most ``max_repeats`` of its source: of the pieces that
    blocks cut it into, the one that is used most often.  ``actual_share`` is the share of all used
    tokens that the record's source has.  A source that has records but no target, or a target but no
    records, gives no rows; the other shares are then scaled up alike.  Null and empty texts, and null
    sources, are not chosen.  Should a document id or a target be listed twice, each row counts by itself
    (rows alike in id, source and size come out as one, with the sums), and the targets of a source add
    up (with the smaller ``max_repeats``).
    """
    p = planned(documents, targets, tokenizer, block_tokens, seed)
    # blocks by index: each with how often a slot holds it
    uses = p.slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("uses"))
    used = p.pieces.join(uses, ["source", "block"])
    chosen = Staging(documents.sparkSession, "mixed").cut(
        used.groupBy("doc_id", "source", "n_tokens").agg(F.max("uses").alias("repeats"), F.sum(F.col("uses") * F.col("piece_tokens")).alias("tokens_used")), "chosen"
    )
    got = {r["source"]: r["t"] for r in chosen.groupBy("source").agg(F.sum("tokens_used").alias("t")).collect()}
    told = documents.sparkSession.createDataFrame(
        [(s, float(p.goal[s]), t / sum(got.values())) for s, t in got.items()], "source string, target_share double, actual_share double"
    )
    return chosen.join(F.broadcast(told), "source").select("doc_id", "source", "n_tokens", "repeats", "tokens_used", "target_share", "actual_share")


def shard_counts(slots: DataFrame) -> DataFrame:
    """``shard, source, n_slots, n_blocks``: what each output shard draws of each source, and of how many blocks."""
    return slots.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n_slots"), F.count_distinct("block").alias("n_blocks"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_records, max_used, tokens_used`` for every target source."""
    wanted = targets.select(tidy(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    got = mixed.groupBy("source").agg(
        F.max("actual_share").alias("actual_share"), F.count(F.lit(1)).alias("n_records"), F.max("repeats").alias("max_used"), F.sum("tokens_used").alias("tokens_used")
    )
    zero = {"actual_share": 0.0, "n_records": 0, "max_used": 0, "tokens_used": 0}
    return wanted.join(got, "source", "left").fillna(zero)
