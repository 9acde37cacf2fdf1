"""Text search: results by brute force, and what enters the exchanges."""

import math
import random
import re

import pytest

from graphloom.operators import retrieval as R
from graphloom.plans import registry


def exchanged(df):
    """The rows of ``df`` and how many rows its exchanges wrote."""
    rows = df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        n = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        kids = plan.children()
        return n + sum(walk(kids.apply(i)) for i in range(kids.size()))

    return rows, walk(df._jdf.queryExecution().executedPlan())


def brute(docs, queries):
    """``{qid: [(floor of the score, id)]}`` in order of rank."""
    words = {i: [w for w in re.split(r"[\W_]+", t.lower()) if w] for i, t in docs.items()}
    avg = sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for qid, text in queries.items():
        terms = sorted({w for w in re.split(r"[\W_]+", (text or "").lower()) if w})
        hit = []
        for i, w in words.items():
            if terms and all(t in w for t in terms):
                s = sum(math.log((len(words) - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in terms)
                hit.append((-math.floor(s * 1e9), i))
        if hit:
            out[qid] = sorted(hit)
    return out


def by_query(rows, *cols):
    out = {}
    for r in sorted(rows, key=lambda r: (r.qid, r.pos)):
        out.setdefault(r.qid, []).append(r.id if cols == () else tuple(r[c] for c in cols))
    return out


@pytest.fixture
def texts():
    rnd = random.Random(7)
    words = ["the", "of", *[f"w{i}" for i in range(25)]]
    docs = {i: " ".join(rnd.choices(words, [30, 20, *[2] * 25], k=rnd.randint(0, 30))) for i in range(600)}
    queries = {i: " ".join(rnd.choices(words, k=rnd.randint(1, 3))) for i in range(80)} | {80: None, 81: "...", 82: "nowhere the", 83: "The, the OF"}
    return docs, queries


@pytest.fixture
def common_words(spark, tmp_path):
    """Documents and titles that share words: 600 x 30 pairs of a document and a query have a word in common, 600 all words."""
    rows = [(i, f"the w{i // 20 % 30}", f"the of w{i % 30}", f"r{i % 4}") for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, title string, text string, repo_uri string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("block, portion", [(20_000, 200_000), (7, 5)])
def test_bm25_by_brute_force(spark, monkeypatch, texts, block, portion):
    monkeypatch.setattr(R, "SEARCH_BLOCK", block)
    monkeypatch.setattr(R, "PORTION", portion)
    docs, queries = texts
    d = spark.createDataFrame(list(docs.items()), "id long, text string").repartition(5)
    q = spark.createDataFrame(list(queries.items()), "qid long, text string")
    want = brute(docs, queries)
    for limit in (3, None):
        got = by_query(R.bm25(d, "id", ["text"], q, limit).collect())
        assert got == {k: [i for _, i in v[:limit]] for k, v in want.items()}
    assert R.bm25(d.limit(0), "id", ["text"], q).count() == 0
    assert R.bm25(d, "id", ["text"], q.limit(0)).count() == 0


def test_bm25_exchanges_hits_and_not_pairs(spark, common_words):
    rows, n = exchanged(registry.queries()["r01_bm25"](spark, common_words))
    assert len({r.qid for r in rows}) == 30 and n < 5_000


def test_zoom_by_brute_force(spark, texts):
    docs, queries = texts
    files = {f"f{i:03d}": t for i, t in list(docs.items())[:60]}
    symbols = {f"s{i:03d}": (f"f{i % 80:03d}", t) for i, t in list(docs.items())[60:]}
    near = brute(files, queries)
    want = {}
    for q, hit in brute({s: t for s, (_, t) in symbols.items()}, queries).items():
        top = {f for _, f in near.get(q, [])[:4]}
        kept = [(s, "zoomed" if top else "flat") for _, s in hit if not top or symbols[s][0] in top][:5]
        if kept:
            want[q] = kept
    f = spark.createDataFrame(list(files.items()), "file_path string, text string").repartition(3)
    s = spark.createDataFrame([(s, *x) for s, x in symbols.items()], "id string, file_path string, text string").repartition(4)
    q = spark.createDataFrame(list(queries.items()), "qid long, text string")
    assert {t for k in want.values() for _, t in k} == {"zoomed", "flat"}
    assert by_query(R.zoom(f, s, q, 4, 5).collect(), "id", "tier") == want


def test_zoom_exchanges_hits_and_not_pairs(spark):
    f = spark.createDataFrame([(f"f{i}", f"go w{i}") for i in range(200)], "file_path string, text string")
    s = spark.createDataFrame([(f"s{i}", f"f{i % 200}", f"go w{i % 200}") for i in range(1000)], "id string, file_path string, text string")
    q = spark.createDataFrame([(i, f"W{i} Go") for i in range(200)], "qid long, text string")
    rows, n = exchanged(R.zoom(f, s, q))
    assert len(rows) == 1000 and n < 10_000


def test_bm25_by_part_by_brute_force(spark, monkeypatch, texts):
    monkeypatch.setattr(R, "PORTION", 40)
    docs, queries = texts
    part = {i: None if i % 11 == 0 else "abcde"[min(i % 17, 4)] for i in docs}
    want = {}
    for q, hit in brute(docs, queries).items():
        at, n = [], {}
        for _, i in hit:
            if part[i] is not None:
                n[part[i]] = n.get(part[i], 0) + 1
                at.append((n[part[i]], part[i], i))
        if at:
            want[q] = sorted(x for x in at if x[0] <= 6)[:12]
    d = spark.createDataFrame([(i, t, part[i]) for i, t in docs.items()], "id long, text string, part string").repartition(5)
    q = spark.createDataFrame(list(queries.items()), "qid long, text string")
    got = {}
    for r in R.bm25_by_part(d, "id", ["text"], "part", q, 6, 12).collect():
        got.setdefault(r.qid, []).append((r.pos, r.part, r.id))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_group_query_exchanges_hits_and_not_pairs(spark, common_words):
    rows, n = exchanged(registry.queries()["r06_group_query"](spark, common_words))
    assert len({r.qid for r in rows}) == 30 and n < 5_000


def test_hybrid_exchanges_hits_and_not_pairs(spark, common_words):
    rows, n = exchanged(registry.queries()["r04_hybrid"](spark, common_words))
    assert len({r.qid for r in rows}) == 30 and n < 8_000
