"""Parent-child links to full hierarchies by parallel tree contraction.

Each round works on the surviving links ``child -> parent`` with a length ``w``:

* *rake*: every node without children leaves, keeping a record of its parent and distance;
* *compress*: on chains of nodes with a single child an independent set (local minima of a hash that
  changes each round) is spliced out; the child inherits the parent and the summed length.

Trees shrink to their roots in a logarithmic number of rounds, however deep they are.  A core that
no round can shrink further is a cycle: its chain is spliced down to one node that points to itself.
The recorded contractions are then replayed backwards; every record hangs from a node that left
later, so root, depth and path follow from one join per round, over sets that grow geometrically.

Ids travel as two independent 64-bit hashes, which keeps every exchange inside fixed-width hash
aggregation; the texts of the ids come back in one join at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.runtime import Staging

#: Rounds before the contraction gives up; 2^64 nodes in one chain need fewer.
MAX_ROUNDS = 200

#: Tables that the steps back read before they are merged.
PARTS = 4

#: Edge type -> (hierarchy, whether src is the parent).
HIERARCHIES = {
    "CONTAINS": ("containment", True),
    "DEFINES": ("containment", True),
    "HAS_METHOD": ("containment", True),
    "HAS_PROPERTY": ("containment", True),
    "EXTENDS": ("inheritance", False),
}


def hierarchy_links(edges: DataFrame, spec: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    """``hierarchy, child, parent`` of the edges whose type belongs to a hierarchy, both ends non-null."""
    spec = spec or HIERARCHIES
    name = F.create_map(*[x for t, (h, _) in spec.items() for x in (F.lit(t), F.lit(h))])
    down = F.col("type").isin([t for t, (_, parent_first) in spec.items() if parent_first])
    return (
        edges.where(F.col("type").isin(list(spec)) & F.col("src").isNotNull() & F.col("dst").isNotNull())
        .select(
            name[F.col("type")].alias("hierarchy"),
            F.when(down, F.col("dst")).otherwise(F.col("src")).alias("child"),
            F.when(down, F.col("src")).otherwise(F.col("dst")).alias("parent"),
        )
    )


def _key(h: Column, c: Column) -> tuple[Column, Column]:
    return F.xxhash64(h, c), F.xxhash64(F.lit("graphloom"), c, h)


def _rank(k: str, r: int) -> Column:
    return F.xxhash64(F.lit(r), F.col(k))


def hierarchies(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """``hierarchy, node_id, root_id, depth[, path]`` for each id that is an end of a link.

    * A root has depth 0 and itself as ``root_id``.  ``path`` runs from the root to the node.
    * On a cycle ``depth`` is -1 and ``root_id`` the smallest id of the cycle by code points; below a
      cycle ``depth`` is -2 with the same ``root_id``; ``path`` is null in both cases.
    * A link from an id to itself is a cycle.  Repeated links count once.  Should an id have several
      parents in one hierarchy, the smallest parent id is taken, and the other parents stay as nodes;
      :func:`dropped_links` lists the links that are not followed.
    * Links with a null end are ignored.  Empty ids are ids.  No links, no rows.
    """
    spark = links.sparkSession
    st = Staging(spark, "hierarchy")
    links = links.where("hierarchy is not null and child is not null and parent is not null")

    # one row per id: its parent, if any
    ends = links.select("hierarchy", F.explode(F.array(
        F.struct(F.col("child").alias("id"), F.col("parent").alias("up")),
        F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("up")),
    )).alias("e")).select("hierarchy", "e.id", "e.up")
    own = ends.groupBy("hierarchy", "id").agg(F.min("up").alias("up"))
    k1, k2 = _key(F.col("hierarchy"), F.col("id"))
    u1, u2 = _key(F.col("hierarchy"), F.col("up"))
    names = st.cut(
        own.select(
            k1.alias("k1"), k2.alias("k2"),
            F.when(F.col("up").isNotNull(), u1).alias("p1"), F.when(F.col("up").isNotNull(), u2).alias("p2"),
            "hierarchy", F.col("id").alias("node_id"),
        ),
        "names",
    )
    empty = F.array().cast("array<struct<k1:bigint,k2:bigint>>")
    state = names.select("k1", "k2", "p1", "p2", F.lit(1).alias("w"), *([empty.alias("seg")] if with_paths else []))
    seg = ["seg"] if with_paths else []

    spliced: list[tuple[int, DataFrame]] = []
    with_rake: set[int] = set()
    rooted: list[int] = []
    records: list[DataFrame] = []
    left = names.count()
    done = None
    for r in range(MAX_ROUNDS):
        # how many children each survivor has, and the child where there is just one
        ups = state.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count(F.lit(1)).alias("nc"), F.max("k1").alias("c1"), F.max("k2").alias("c2")
        )
        seen = state.join(ups, ["k1", "k2"], "left")
        loop = (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2"))
        leaf = F.col("nc").isNull() & F.col("p1").isNotNull()
        # in a cycle of two both nodes are the other's child and parent: the hash picks one of them
        unary = (
            (F.col("nc") == 1) & F.col("p1").isNotNull() & ~loop
            & (_rank("k1", r) < _rank("c1", r)) & (_rank("k1", r) <= _rank("p1", r))
        )
        what = F.when(F.col("p1").isNull() & F.col("nc").isNull(), "root").when(leaf, "rake").when(unary, "splice").otherwise("stay")
        # one job per round: the counts come with the write
        told = Observation()
        n_of = lambda w: F.count_if(F.col("what") == w).alias(w)
        marked = st.cut(
            seen.select("k1", "k2", "p1", "p2", "w", *seg, "c1", "c2", what.alias("what")).observe(told, n_of("rake"), n_of("splice"), n_of("root")), f"round{r}"
        )
        counts = told.get
        gone = counts["rake"] + counts["splice"] + counts["root"]
        record = marked.where("what in ('rake', 'splice', 'root')")
        records.append(record)
        if counts["rake"]:
            with_rake.add(r)
        if counts["root"]:
            rooted.append(r)
        if counts["splice"]:
            spliced.append((r, marked.where("what = 'splice'")))
        left -= gone
        stay = marked.where("what = 'stay'").select("k1", "k2", "p1", "p2", "w", *seg)
        if counts["splice"]:
            # the only child of a spliced node takes over its parent and length
            cuts = marked.where("what = 'splice'").select(
                F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("p1").alias("n1"), F.col("p2").alias("n2"),
                F.col("w").alias("add"), *([F.col("seg").alias("up_seg"), F.col("k1").alias("v1"), F.col("k2").alias("v2")] if with_paths else []),
            )
            state = stay.join(cuts, ["k1", "k2"], "left").select(
                "k1", "k2",
                F.coalesce("n1", "p1").alias("p1"), F.coalesce("n2", "p2").alias("p2"),
                (F.col("w") + F.coalesce("add", F.lit(0))).alias("w"),
                *([F.when(F.col("n1").isNotNull(), F.concat("up_seg", F.array(F.struct(F.col("v1").alias("k1"), F.col("v2").alias("k2"))), "seg")).otherwise(F.col("seg")).alias("seg")] if with_paths else []),
            )
        else:
            state = stay
        done = state
        if left == 0 or gone == 0:
            break
    else:
        raise RuntimeError("the contraction did not end")

    # what no round could shrink are self-loops, one per cycle (their trees and chains are recorded)
    cores = left
    name_of = names.select("k1", "k2", "node_id")
    roots = reduce(DataFrame.unionByName, [records[r].where("what = 'root'").select("k1", "k2") for r in rooted or [0]])
    known = roots.join(name_of, ["k1", "k2"]).select(
        "k1", "k2", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"),
        *([empty.alias("path")] if with_paths else []),
    )
    cyc = None
    if cores:
        core = done.select("k1", "k2")
        cyc = st.cut(core.select("k1", "k2", F.col("k1").alias("g1"), F.col("k2").alias("g2")), "core")
        for r, rec in reversed(spliced):
            on = rec.select("k1", "k2", "c1", "c2").join(
                cyc.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "g1", "g2"), ["c1", "c2"]
            ).select("k1", "k2", "g1", "g2")
            cyc = st.cut(cyc.unionByName(on), f"cycle{r}")
        smallest = cyc.join(name_of, ["k1", "k2"]).groupBy("g1", "g2").agg(F.min("node_id").alias("root_id"))
        known = known.unionByName(
            smallest.select(
                F.col("g1").alias("k1"), F.col("g2").alias("k2"), "root_id", F.lit(-1).alias("depth"),
                *([empty.alias("path")] if with_paths else []),
            )
        )
    # the steps back: each round adds its own nodes as a table; a few tables are merged to one, so that each
    # node is written a logarithmic number of times and no plan reads many tables
    with_splice = {r for r, _ in spliced}
    parts = [st.cut(known, "known")]

    def add(found: DataFrame, label: str) -> None:
        parts.append(st.cut(found, label))
        if len(parts) > PARTS:
            parts[:] = [st.cut(reduce(DataFrame.unionByName, parts), f"{label}-merged")]

    def hang(rec: DataFrame, under: DataFrame) -> DataFrame:
        up = under.select(
            F.col("k1").alias("p1"), F.col("k2").alias("p2"), "root_id", F.col("depth").alias("d"), *(["path"] if with_paths else [])
        )
        return rec.select("k1", "k2", "p1", "p2", "w", *seg).join(up, ["p1", "p2"]).select(
            "k1", "k2", "root_id", F.when(F.col("d") < 0, F.lit(-2)).otherwise(F.col("d") + F.col("w")).alias("depth"),
            *([F.concat("path", F.array(F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"))), "seg").alias("path")] if with_paths else []),
        )

    for i in range(len(records) - 1, -1, -1):
        # a raked leaf may hang from a node spliced in the same round: splices come back first
        for what_left in (["splice"] if i in with_splice else []) + (["rake"] if i in with_rake else []):
            add(hang(records[i].where(F.col("what") == what_left), reduce(DataFrame.unionByName, parts)), f"back{i}-{what_left}")
    known = reduce(DataFrame.unionByName, parts)
    if cyc is not None:
        known = known.join(cyc.select("k1", "k2", F.lit(True).alias("on_cycle")), ["k1", "k2"], "left").withColumn(
            "depth", F.when(F.col("on_cycle"), F.lit(-1)).otherwise(F.col("depth"))
        )
    out = known.join(names.select("k1", "k2", "hierarchy", "node_id"), ["k1", "k2"])
    if not with_paths:
        return out.select("hierarchy", "node_id", "root_id", "depth")
    # the texts of the ancestors: one row per step, and one group per node, as long as its path
    steps = out.where("depth >= 0").select("k1", "k2", F.posexplode("path").alias("pos", "a"))
    told = steps.join(name_of.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("node_id").alias("anc")),
                      (F.col("a.k1") == F.col("a1")) & (F.col("a.k2") == F.col("a2")))
    told = told.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("pos", "anc"))).alias("s"))
    return out.drop("path").join(told, ["k1", "k2"], "left").select(
        "hierarchy", "node_id", "root_id", "depth",
        F.when(F.col("depth") >= 0, F.concat(F.coalesce(F.col("s.anc"), F.array().cast("array<string>")), F.array("node_id"))).alias("path"),
    )


def dropped_links(links: DataFrame) -> DataFrame:
    """``hierarchy, child, parent``: the links that :func:`hierarchies` does not follow, as their child has a smaller parent too."""
    links = links.where("hierarchy is not null and child is not null and parent is not null").distinct()
    taken = links.groupBy("hierarchy", "child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n")).where("n > 1")
    more = taken.select("hierarchy", "child", F.col("parent").alias("kept"))
    return links.join(more, ["hierarchy", "child"]).where("parent <> kept").drop("kept")


def _pairs(paths: DataFrame) -> DataFrame:
    w = F.size("path")
    return paths.where("depth > 0").select(
        "hierarchy", F.col("node_id").alias("descendant_id"), w.alias("n"), F.posexplode(F.slice("path", F.lit(1), w - 1)).alias("pos", "node_id")
    ).select("hierarchy", "node_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).alias("distance"))


def descendants(links: DataFrame) -> DataFrame:
    """``hierarchy, node_id, descendant_id, distance``: each id with each other id below it, by the fewest steps down.

    An id on a cycle has below it all other ids of the cycle, and all that hangs from any of them; an id
    below a cycle has its own subtree.  No id is below itself.  A leaf has no rows.
    """
    links = links.where("hierarchy is not null and child is not null and parent is not null")
    found = hierarchies(links, with_paths=True)
    out = _pairs(found)
    looped = found.where("depth < 0").select("hierarchy", "node_id", "root_id", "depth")
    if looped.isEmpty():
        return out
    # one parent per id, as in the hierarchies
    own = links.groupBy("hierarchy", "child").agg(F.min("parent").alias("parent"))
    st = Staging(links.sparkSession, "loops")
    mine = st.cut(own.join(looped.withColumnRenamed("node_id", "child"), ["hierarchy", "child"]), "links")
    # a cycle opened above its smallest id is a chain, whose depths are the places on the cycle
    chain = mine.where("depth = -1 and child <> root_id")
    places = hierarchies(chain).select("hierarchy", "node_id", F.col("depth").alias("place"))
    ring = mine.where("depth = -1").select("hierarchy", F.col("child").alias("node_id"), F.col("root_id").alias("ring"))
    size = ring.groupBy("hierarchy", "ring").agg(F.count(F.lit(1)).alias("size"))
    ring = st.cut(ring.join(places, ["hierarchy", "node_id"], "left").join(size, ["hierarchy", "ring"]).fillna(0, ["place"]), "ring")
    # what hangs from the cycle, with its path from the id on the cycle
    hung = hierarchies(mine.where("depth = -2"), with_paths=True)
    below = hung.where("depth > 0").select("hierarchy", F.col("root_id").alias("at"), F.col("node_id").alias("descendant_id"), F.col("depth").alias("down"))
    at = ring.select("hierarchy", F.col("node_id").alias("at"), "ring", F.col("place").alias("there"))
    reached = below.join(at, ["hierarchy", "at"]).select("hierarchy", "ring", "descendant_id", "at", "there", "down").unionByName(
        at.select("hierarchy", "ring", F.col("at").alias("descendant_id"), "at", "there", F.lit(0).alias("down"))
    )
    around = ring.join(reached, ["hierarchy", "ring"]).where("node_id <> at").select(
        "hierarchy", "node_id", "descendant_id", (F.pmod(F.col("there") - F.col("place"), F.col("size")) + F.col("down")).cast("int").alias("distance")
    )
    return out.unionByName(_pairs(hung)).unionByName(around)


def cycles(found: DataFrame) -> DataFrame:
    """``hierarchy, root_id, n_on_cycle, n_below`` for each cycle."""
    return found.where("depth < 0").groupBy("hierarchy", "root_id").agg(
        F.count_if(F.col("depth") == -1).alias("n_on_cycle"), F.count_if(F.col("depth") == -2).alias("n_below")
    )
