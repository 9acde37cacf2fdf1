"""Problems 7 and 8: leaked evaluation texts and the source mix."""

import random

import numpy as np
import pytest

from graphloom.llm import leaks as L
from graphloom.llm import mixing as M

LEAD = "You are given a code graph with typed nodes and edges. Answer the question using only the graph."


def item(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(9000)}" for _ in range(n))


def brute(docs, items):
    lead = L.words_of(LEAD)
    out = set()
    for i, t in items:
        w = L.words_of(t)
        own = w[len(lead):] if w[:len(lead)] == lead else w
        n = min(20, len(own))
        for d, x in docs:
            y = L.words_of(x)
            for s in range(len(own) - n + 1):
                if any(sum(a != b for a, b in zip(own[s:s + n], y[p:p + n])) <= n // 10 for p in range(len(y) - n + 1)):
                    out.add((d, i))
    return out


def test_words_regardless_of_form():
    want = ["the", "fox", "jumpsover", "12", "dogs"]
    for t in ("The FOX `jumps_over` 12 dogs.", "> The fox\n> jumps-over 12\n> dogs", "|the|fox|jumps/over|12|dogs|", "the &quot;fox&quot; jumpsover\\n12 dogs", "05:23 the fox\n07:11 jumpsover 12\n09:00 dogs"):
        assert L.words_of(t) == want


def test_leaks_match_brute_force(spark):
    items = [(i, f"{LEAD} {item(i, 30 + i)}") for i in range(4)] + [(10, item(10, 40)), (11, item(11, 14)), (12, ""), (13, None)]
    w = item(10, 40).split()
    two = w[:]
    two[3] = two[11] = "swapped"
    three = w[:20]
    three[3] = three[11] = three[15] = "swapped"
    docs = [
        (1, "intro words here. " + " ".join(w[5:25]) + " and more"), (2, " ".join(two[:20])), (3, " ".join(three)), (4, " ".join(w[:19]) + " other words"), (5, LEAD + " Something else entirely is asked in this text."),
        (6, items[2][1]), (7, item(11, 14).upper()), (8, item(11, 14).replace(item(11, 14).split()[4], "swapped")), (9, ""), (20, "x " * 50_000 + " ".join(w)),
    ]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(30, None, 1)], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, "t", t) for i, t in items] + [(10, "t", item(10, 40))], "item_id long, task string, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(df, it).collect()}
    assert got == brute(docs, [(i, t) for i, t in items if t]) == {(1, 10), (2, 10), (4, 10), (6, 2), (7, 11), (8, 11), (20, 10)}
    assert {(r.doc_id, r.item_id) for r in L.leaks(df, it, block=2).collect()} == got
    assert L.leaks(df.limit(0), it).count() == 0 and L.leaks(df, it.limit(0)).count() == 0


def test_instructions_of_any_number_of_sentences(spark):
    lead = " ".join(f"Rule {i} says w{i} x{i}." for i in range(12))
    rows = [(i, f"{lead} {item(50 + i, 30)} end.") for i in range(3)] + [(9, item(70, 12) + ". " + item(71, 12)), (10, ""), (11, lead)]
    got = {r.item_id: r.lead for r in L.with_leads(spark.createDataFrame(rows, "item_id long, text string")).collect()}
    assert got == {0: 60, 1: 60, 2: 60, 9: 0, 10: 0, 11: 55}


def test_recall_of_the_sampling():
    rng = random.Random(5)
    items = [(i, item(i, 60)) for i in range(40)]
    index = L.ItemIndex(items)
    hit = 0
    for _ in range(400):
        k = rng.randrange(40)
        w = items[k][1].split()
        s = rng.randrange(41)
        x = w[s:s + 20]
        for p in rng.sample(range(20), 2):
            x[p] = rng.choice(items[rng.randrange(40)][1].split())
        hit += k in index.search(" ".join(x))
    assert hit >= 0.9 * 400


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        q = np.arange(n)
        for key in (0, 9, 2**63):
            assert sorted(M.permuted(q, np.full(n, n), np.full(n, key, dtype=np.uint64))) == list(range(n))


@pytest.mark.parametrize("totals", [[700, 0, 301, 17], [1], [5, 5], [0, 0]])
def test_shards_share_out_every_ordinal_once(totals):
    totals, n = np.array(totals), 13
    slots = int(totals.sum())
    parts = [M.shard_slots(s, n, totals, 1) for s in range(n)]
    assert [len(p[0]) for p in parts] == [(s + 1) * slots // n - s * slots // n for s in range(n)]
    assert all(p[0].tolist() == list(range(len(p[0]))) for p in parts)
    got = sorted((int(i), int(q)) for _, src, o in parts for i, q in zip(src, o))
    assert got == [(i, q) for i, t in enumerate(totals) for q in range(t)]


def test_shards_draw_like_a_multinomial():
    totals = np.array([40_000, 60_000])
    draws = np.array([(M.shard_slots(s, 100, totals, 7)[1] == 0).sum() for s in range(100)])
    # hypergeometric: mean 400, variance 1000 * 0.4 * 0.6 * 0.99
    assert abs(draws.mean() - 400) < 1e-9 and 9 < draws.std() < 23


def test_large_totals_are_exact():
    totals = np.array([3_000_000_000_000, 2_000_000_000_001])
    at, src, q = M.shard_slots(1_000_000, 1_200_000_000, totals, 3)
    assert len(at) in (4166, 4167) and ((q >= 0) & (q < totals[src])).all() and 0.5 < (src == 0).mean() < 0.7


def test_plan():
    assert M.plan([("a", 0.5, 1, 100), ("b", 0.25, 4, 10), ("c", 0.25, 1, 0)]) == [("a", pytest.approx(2 / 3), 80), ("b", pytest.approx(1 / 3), 40)]
    assert M.plan([]) == [] and M.plan([("a", 0.0, 1, 5), ("b", None, 1, 5)]) == []


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, item(i, rng.randrange(20, 90)), rng.choice(["Wiki ", " wiki", "WIKI"])) for i in range(600)] + [(1000 + i, item(i, 50), "adr") for i in range(60)]
    rows += [(5000, None, "wiki"), (5001, "", "wiki"), (5002, "no source", None), (5003, "not wanted", "other"), (5004, "blank", "  ")]
    docs = spark.createDataFrame([r + (0,) for r in rows], "doc_id long, text string, source string, repeats int")
    goals = spark.createDataFrame([("wiki", 0.6, 1), ("adr", 0.3, 4), ("ghost", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = M.mix(docs, goals)
    got = mixed.collect()
    assert got and {r.source for r in got} == {"wiki", "adr"} and len({r.doc_id for r in got}) == len(got)
    assert all(r.repeats <= {"wiki": 1, "adr": 4}[r.source] and 0 < r.tokens_used <= r.repeats * r.n_tokens for r in got)
    total = sum(r.tokens_used for r in got)
    for s, share in (("wiki", 2 / 3), ("adr", 1 / 3)):
        used = sum(r.tokens_used for r in got if r.source == s) / total
        assert abs(used - share) < 0.03 and all(abs(r.actual_share - used) < 1e-9 for r in got if r.source == s)
    told = {r.source: r for r in M.shares(mixed, goals).collect()}
    # blocks: every token of every record in exactly one, all of one size but the last of each source
    p = M.planned(docs, goals, block_tokens=64)
    pieces = p.pieces.collect()
    by_doc, load = {}, {}
    for x in pieces:
        by_doc.setdefault((x.doc_id, x.n_tokens), []).append((x.first_token, x.piece_tokens))
        load[x.source, x.block] = load.get((x.source, x.block), 0) + x.piece_tokens
    for (_, n), parts in by_doc.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) == n
    for s in ("wiki", "adr"):
        sizes = [load[s, b] for b in range(max(b for t, b in load if t == s) + 1)]
        assert set(sizes[:-1]) == {64} and 0 < sizes[-1] <= 64
    slots = p.slots.collect()
    assert len({(x.shard, x.slot) for x in slots}) == len(slots)
    drawn = {(r.shard, r.source): r.n_slots for r in M.shard_counts(p.slots).collect()}
    assert sum(drawn.values()) == len(slots)
    assert told["ghost"].n_records == 0 and told["ghost"].actual_share == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, M.mix(docs, goals).collect()))
    assert M.mix(docs.limit(0), goals).count() == 0 and M.mix(docs, goals.limit(0)).count() == 0
