"""Graph analytics: PageRank, components, communities, strong components, dead code and friends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import CONFIRMED_PREFIX, name_words
from graphloom.runtime import Staging

# Relations that make a symbol live, and kinds that can be dead.
REFERRERS = ["CALLS", "REFERENCES", "ACCESSES", "EXTENDS", "IMPLEMENTS", "METHOD_OVERRIDES", "METHOD_IMPLEMENTS"]
SYMBOLS = ["Function", "Method", "Constructor", "Class", "Interface", "Struct", "Trait", "TypeAlias", "Enum"]
UNCONFIRMED = "+scip-unconfirmed"
STOP_WORDS = ["get", "set", "is", "has", "the", "a", "an", "to", "from", "of", "for", "on", "in", "at", "by", "and", "or", "not", "with", "new", "my", "do", "run", "it", "init", "fn", "func"]


def adjacency(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``src, dst, w``: parallel edges add up."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight), F.lit(1.0))
    return edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.sum(w).alias("w"))


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 50, weight: str | None = None, cut_every: int = 5) -> DataFrame:
    """``id, rank``: exactly ``iterations`` rounds, in proportion to weights; dangling mass spreads evenly.

    Ids become 64-bit numbers for the rounds and the adjacency is written once, hash-partitioned by its
    source; the mass of the dangling nodes is one number per round.
    """
    spark = edges.sparkSession
    st = Staging(spark, "pagerank")
    adj = adjacency(edges, weight)
    ids = adj.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ids = st.cut(ids.select("id", F.xxhash64("id").alias("k")), "ids")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"))
    out_w = Window.partitionBy("src")
    links = st.cut(
        adj.withColumn("share", F.col("w") / F.sum("w").over(out_w)).select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"), "share"), "links"
    )
    dangling = st.cut(ids.join(links.select(F.col("a").alias("k")).distinct(), "k", "left_anti").select("k"), "dangling")
    ranks = ids.select("k", F.lit(1.0 / n).alias("r"))
    lost_free = dangling.isEmpty()
    for i in range(iterations):
        lost = 0.0 if lost_free else (ranks.join(dangling, "k", "left_semi").agg(F.sum("r").alias("s")).first()["s"] or 0.0)
        base = (1.0 - damping) / n + damping * lost / n
        got = links.join(ranks, links["a"] == ranks["k"]).groupBy("b").agg(F.sum(F.col("share") * F.col("r")).alias("in"))
        ranks = ids.join(got, ids["k"] == got["b"], "left").select("k", (F.lit(base) + F.lit(damping) * F.coalesce("in", F.lit(0.0))).alias("r"))
        if (i + 1) % cut_every == 0 or not lost_free:
            ranks = st.cut(ranks, f"round{i}")
    return ids.join(ranks, "k").select("id", F.col("r").alias("rank"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component``: connected components, named after their smallest id.

    Large-star and small-star rounds on 64-bit keys, which end after about log n rounds whatever the
    shape.  A hub's neighbours are reduced to a minimum before the exchange.
    """
    spark = edges.sparkSession
    st = Staging(spark, "components")
    e = edges.where("src is not null and dst is not null").select("src", "dst")
    ids = st.cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.xxhash64("id").alias("k")), "ids")
    pairs = st.cut(e.select(F.xxhash64("src").alias("u"), F.xxhash64("dst").alias("v")).where("u <> v").distinct(), "pairs")
    before = None
    for r in range(max_rounds):
        # large star: larger neighbours of each node go to the smallest in its neighbourhood
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        pairs = st.cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"star{r}"
        )
        sign = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if before == (sign["n"], sign["h"]):
            break
        before = (sign["n"], sign["h"])
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    root = ids.join(pairs.select(F.col("u").alias("k"), F.col("v").alias("root")), "k", "left").select("id", F.coalesce("root", "k").alias("root"))
    name = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(name, "root").select("id", "component")


def communities(edges: DataFrame, rounds: int = 10, least: int = 3) -> DataFrame:
    """``id, community, size``: deterministic label propagation on CALLS (1.0) and HAS_METHOD (0.5).

    Every round each node takes the heaviest label around it, the smallest on a tie; communities are
    named after their smallest member, and those below ``least`` members are dropped.  Not the
    modularity method of the original, whose module is not public.
    """
    spark = edges.sparkSession
    st = Staging(spark, "communities")
    w = F.when(F.col("type") == "CALLS", 1.0).otherwise(0.5)
    e = edges.where(F.col("type").isin("CALLS", "HAS_METHOD") & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    und = e.select("src", "dst", w.alias("w")).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("w")))
    adj = st.cut(und.groupBy(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")).agg(F.sum("w").alias("w")), "adj")
    ids = st.cut(und.select(F.col("src").alias("id")).distinct().select("id", F.xxhash64("id").alias("k")), "ids")
    labels = ids.select("k", F.col("k").alias("label"))
    for r in range(rounds):
        votes = adj.join(labels, adj["b"] == labels["k"]).groupBy("a", "label").agg(F.sum("w").alias("s"))
        heaviest = votes.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("s"), "label")).alias("best"))
        # half of the nodes move per round, so that neighbours do not swap labels for ever
        turn = F.pmod(F.xxhash64(F.lit(r), F.col("k")), F.lit(2)) == 0
        labels = st.cut(
            labels.join(heaviest, labels["k"] == heaviest["a"]).select("k", F.when(turn, F.col("best.label")).otherwise(F.col("label")).alias("label")), f"round{r}"
        )
    told = ids.join(labels, "k")
    sizes = told.groupBy("label").agg(F.min("id").alias("community"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return told.join(sizes, "label").select("id", "community", "size")


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``community, cohesion``: mean weight of the inner edges; none with fewer than two members or no edge."""
    m = members.select("id", "community")
    a, b = m.select(F.col("id").alias("src"), F.col("community").alias("ca")), m.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    inner = edges.where("src is not null and dst is not null and src <> dst").join(a, "src").join(b, "dst").where("ca = cb")
    g = inner.groupBy(F.col("ca").alias("community")).agg(F.avg("confidence").alias("m"))
    sizes = m.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(g, "community", "left").select("community", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("m", F.lit(0.0))).alias("cohesion"))


def keywords(nodes: DataFrame, group: str, k: int = 5) -> DataFrame:
    """``group, word, n, pos``: the k most frequent words of the names in a group, by count then word."""
    words = nodes.where(F.col(group).isNotNull() & F.col("name").isNotNull()).select(group, F.explode(name_words(F.col("name"))).alias("word"))
    words = words.where((F.length("word") >= 3) & ~F.col("word").isin(STOP_WORDS)).groupBy(group, "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "word")
    return words.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def degrees(edges: DataFrame, type_: str = "CALLS") -> DataFrame:
    e = edges.where((F.col("type") == type_) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    o = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    i = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return o.join(i, "id", "full").select("id", F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("callers", F.lit(0)).alias("callers"))


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, deadness``: ``live``, ``unreachable-export`` (no use from another file) or ``dead`` (no use at all)."""
    s = nodes.where(F.col("kind").isin(SYMBOLS)).select("id", "file_path", F.coalesce("is_exported", F.lit(False)).alias("exported"))
    src = nodes.select(F.col("id").alias("src"), F.col("file_path").alias("src_file"))
    refs = edges.where(F.col("type").isin(REFERRERS) & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    used = refs.join(src, "src", "left").groupBy(F.col("dst").alias("id"), F.coalesce("src_file", F.lit("")).alias("src_file")).agg(F.count(F.lit(1)).alias("n"))
    j = s.join(used, "id", "left").groupBy("id", "exported").agg(
        F.max(F.col("n").isNotNull()).alias("any"), F.max(F.col("n").isNotNull() & (F.coalesce("src_file", F.lit("")) != F.coalesce("file_path", F.lit("")))).alias("cross")
    )
    verdict = F.when(F.col("exported") & ~F.col("cross"), "unreachable-export").when(~F.col("exported") & ~F.col("any"), "dead").otherwise("live")
    return j.select("id", verdict.alias("deadness"))


def ghosts(members: DataFrame, dead: DataFrame, group: str) -> DataFrame:
    """Groups of which no classified member lives."""
    j = members.join(dead, "id")
    return j.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("deadness") == "live").alias("_l")).where("not _l").drop("_l")


def demote(edges: DataFrame) -> DataFrame:
    """Heuristic edges at 0.5 that an indexer's edge confirms fall to 0.2, with a suffix to their reason."""
    sure = edges.where((F.col("confidence") == 1.0) & F.col("reason").startswith(CONFIRMED_PREFIX)).select("src", "type", "dst").distinct().withColumn("_s", F.lit(True))
    j = edges.join(sure, ["src", "type", "dst"], "left")
    hit = F.coalesce(F.col("_s"), F.lit(False)) & (F.col("confidence") == 0.5) & F.col("type").isin("CALLS", "REFERENCES", "EXTENDS")
    hit = hit & ~F.coalesce(F.col("reason").endswith(UNCONFIRMED), F.lit(False))
    return j.select(
        "id", F.when(hit, 0.2).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.concat(F.coalesce("reason", F.lit("")), F.lit(UNCONFIRMED))).otherwise(F.col("reason")).alias("reason"),
    )


def overrides(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``method, overridden, type, confidence``: METHOD_OVERRIDES of the nearest method of the same name in an ancestor
    that is no interface (0.9), METHOD_IMPLEMENTS of the one in every ancestor that is (0.95)."""
    from graphloom.operators.hierarchy import hierarchies, hierarchy_links

    paths = hierarchies(hierarchy_links(edges, {"EXTENDS": ("inheritance", False)}), with_paths=True)
    anc = paths.where("depth > 0").select(F.col("node_id").alias("cls"), F.posexplode(F.reverse("path")).alias("dist", "anc")).where("dist > 0")
    own = edges.where((F.col("type") == "HAS_METHOD") & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    m = own.join(nodes.where(F.col("kind") == "Method").select(F.col("id").alias("dst"), "name"), "dst")
    a = m.select(F.col("src").alias("cls"), F.col("dst").alias("method"), "name")
    b = m.select(F.col("src").alias("anc"), F.col("dst").alias("overridden"), "name")
    kinds = nodes.where(F.col("kind").isin("Interface", "Trait")).select(F.col("id").alias("anc"), F.lit(True).alias("interface"))
    j = a.join(anc, "cls").join(b, ["anc", "name"]).join(kinds, "anc", "left")
    near = j.where("interface is null").groupBy("method").agg(F.min(F.struct("dist", "overridden")).alias("x")).select("method", "x.overridden", F.lit("METHOD_OVERRIDES").alias("type"), F.lit(0.9).alias("confidence"))
    return near.unionByName(j.where("interface").select("method", "overridden", F.lit("METHOD_IMPLEMENTS").alias("type"), F.lit(0.95).alias("confidence")).distinct())


def strong_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id, component``: strongly connected components with more than one member or a loop.

    Nodes that cannot lie on a cycle are trimmed first; of the rest, each takes the smallest id that
    reaches it and the smallest that it reaches, and pairs that agree form a component.
    """
    st = Staging(edges.sparkSession, "scc")
    e = st.cut(edges.where("src is not null and dst is not null").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct(), "edges")
    found = None
    for r in range(max_rounds):
        size = -1
        while True:  # trim
            keep = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", "v")
            e = st.cut(keep, "trim")
            n = e.count()
            if n == size:
                break
            size = n
        if not size:
            break
        fwd = _reach(st, e.select("u", "v"))
        bwd = _reach(st, e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = st.cut(fwd.select("id", F.col("low").alias("f")).join(bwd.select("id", F.col("low").alias("b")), "id"), "both")
        got = both.where("f = b").select("id", F.col("f").alias("component"))
        found = got if found is None else found.unionByName(got)
        # edges between different pairs join no component
        a, b = both.select(F.col("id").alias("u"), F.col("f").alias("fu"), F.col("b").alias("bu")), both.select(F.col("id").alias("v"), F.col("f").alias("fv"), F.col("b").alias("bv"))
        e = st.cut(e.join(a, "u").join(b, "v").where("fu = fv and bu = bv and fu <> bu").select("u", "v"), f"rest{r}")
    else:
        raise RuntimeError(f"the strong components did not settle in {max_rounds} rounds")
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    return found


def _reach(st: Staging, e: DataFrame, max_rounds: int = 500) -> DataFrame:
    """``id, low``: the smallest id that reaches each node."""
    low = st.cut(e.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("low")), "low")
    for _ in range(max_rounds):
        sent = e.join(low, e["u"] == low["id"]).groupBy(F.col("v").alias("id2")).agg(F.min("low").alias("m"))
        nxt = st.cut(low.join(sent, low["id"] == sent["id2"], "left").select("id", F.least("low", F.coalesce("m", "low")).alias("low"), (F.col("m") < F.col("low")).alias("moved")), "low")
        if nxt.where("moved").isEmpty():
            return nxt.select("id", "low")
        low = nxt.select("id", "low")
    raise RuntimeError(f"a path is longer than {max_rounds} hops")
