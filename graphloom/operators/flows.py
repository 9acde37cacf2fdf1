"""Flows from entry points along calls: processes, their steps, and what they say about symbols and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import name_words
from graphloom.operators.traversal import traverse
from graphloom.runtime import Staging

CALLABLES = ["Function", "Method", "Constructor"]
#: Bounds of a flow: hops, callees followed per symbol, symbols, and the least steps.
DEPTH, BRANCHES, SYMBOLS, LEAST_STEPS = 10, 4, 30, 2
#: Entry points: a twentieth of the callables, within these bounds.
LEAST_ENTRIES, MOST_ENTRIES, ENTRY_SHARE = 20, 300, 0.05
LEAST_CONFIDENCE = 0.5

# Hints at entry points, by file stem, path, name; files that pass on what their folder holds.
FILE_HINTS = "main handler handlers controller controllers route routes router view views api index mod lib app application server entry urls endpoints middleware service services resource resources page pages".split()
DIR_HINTS = "/app/api/ /pages/api/ /app/controllers/ /app/http/controllers/ /controllers/ /handlers/ /routes/ /router/ /views/ /endpoints/ /api/ /cmd/ /src/handlers/ /src/routes/ /src/controller/ /src/controllers/ /lib/pages/ /handlers.".split()
PATH_ENDS = "/route.ts /route.tsx /route.js /route.mjs /handler.ts /handler.py /main.go /main.rs /mod.rs /lib.rs /main.py /urls.py /routes.py /views.py /public/index.php".split()
NAME_OPENINGS = "handle on serve main route dispatch get post put patch delete do process index show list create update destroy setup run".split()
NAME_ENDS = "Controller Handler Middleware Service Endpoint Resource View Route RouteHandler Action".split()
PASSING_FILES = "index.ts index.tsx index.js index.mjs index.cjs index.jsx mod.rs lib.rs __init__.py main.py index.php index.dart library.dart".split()
# Words that no label of a flow is made of.
LABEL_STOPS = "get set is has new make do handle on to from of the a an or and for with fn func function method impl cls self this ctx run exec init start stop main".split()


def _any(c, texts, how):
    out = F.lit(False)
    for t in texts:
        out = out | how(c, t)
    return out


def call_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, n``: calls between callables of enough confidence, with how many edges say so."""
    c = nodes.where(F.col("kind").isin(CALLABLES)).select("id")
    e = edges.where((F.col("type") == "CALLS") & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("confidence") >= LEAST_CONFIDENCE)).select("src", "dst")
    e = e.join(c.select(F.col("id").alias("src")), "src", "left_semi").join(c.select(F.col("id").alias("dst")), "dst", "left_semi")
    return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def scored_entries(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """``id, name, file_path, score``: callables that call something, tests apart, by callees over callers and hints."""
    from graphloom.operators.finders import without_tests

    out = steps.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("callees"))
    into = steps.groupBy(F.col("dst").alias("id")).agg(F.sum("n").alias("callers"))
    c = without_tests(nodes.where(F.col("kind").isin(CALLABLES) & F.col("file_path").isNotNull() & F.col("name").isNotNull()))
    passing = nodes.where((F.col("kind") == "File") & F.element_at(F.split(F.lower("file_path"), "/"), -1).isin(PASSING_FILES)).select(
        F.regexp_replace("file_path", "/?[^/]*$", "").alias("dir")
    ).distinct().withColumn("passing", F.lit(True))
    low = F.lower(F.concat(F.lit("/"), F.col("file_path")))
    stem = F.split(F.element_at(F.split(F.lower("file_path"), "/"), -1), r"\.").getItem(0)
    exported = F.coalesce("is_exported", F.lit(False))
    hint = lambda cond, v: F.when(cond, v).otherwise(0.0)
    in_dir = _any(low, DIR_HINTS, lambda a, t: a.contains(t)) | _any(low, PATH_ENDS, lambda a, t: a.endswith(t))
    named = F.col("name").rlike(f"^(?:{'|'.join(NAME_OPENINGS)})(?:$|[A-Z_-])") | F.col("name").rlike(f".(?:{'|'.join(NAME_ENDS)})$")
    score = (
        F.col("callees") / (F.coalesce("callers", F.lit(0)) + 1) + hint(exported, 0.5) + hint(stem.isin(FILE_HINTS), 0.3) + hint(in_dir, 0.3)
        + hint(named, 0.3) + hint(exported & F.coalesce("passing", F.lit(False)), 0.4)
    )
    j = c.withColumn("dir", F.regexp_replace("file_path", "/?[^/]*$", "")).join(out, "id").join(into, "id", "left").join(passing, "dir", "left")
    return j.select("id", "name", "file_path", score.alias("score"))


def entries(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """The best entry points, a twentieth of all callables within bounds; ties go to the smaller id."""
    n = nodes.where(F.col("kind").isin(CALLABLES)).count()
    top = max(LEAST_ENTRIES, min(MOST_ENTRIES, int(n * ENTRY_SHARE)))
    return scored_entries(nodes, steps).orderBy(F.desc(F.round("score", 9)), "id").limit(top)


def flows(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """``start, src, dst, depth``: the steps of the flow from each start, breadth first.

    A symbol follows its first callees by id, and a flow ends at its bound of symbols.  As whole levels
    are taken in the order in which a queue would, the visited set is that of the sequential walk.
    """
    st = Staging(steps.sparkSession, "flows")
    level = st.cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("ord")), "level0")
    seen = level.select("start", "node")
    out = level.select("start", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("depth")).limit(0)
    w = Window.partitionBy("start")
    for d in range(1, DEPTH + 1):
        # only callees of the level are ranked; the rank keeps few of a hub before the exchange
        mine = steps.select("src", "dst").join(level.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
        few = mine.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("pos") <= BRANCHES)
        reach = level.join(few, level["node"] == few["src"]).select("start", "src", "dst", F.struct("ord", "pos").alias("o"))
        fresh = reach.join(seen.select("start", F.col("node").alias("dst")), ["start", "dst"], "left_anti")
        first = fresh.groupBy("start", "dst").agg(F.min(F.struct("o", "src")).alias("b")).select("start", "dst", "b.src", "b.o")
        have = seen.groupBy("start").agg(F.count(F.lit(1)).alias("have"))
        kept = first.withColumn("ord", F.row_number().over(w.orderBy("o"))).join(have, "start").where(F.col("ord") <= F.lit(SYMBOLS) - F.col("have"))
        found = st.cut(kept.select("start", "src", "dst", F.lit(d).alias("depth"), "ord"), f"level{d}")
        if found.isEmpty():
            break
        out = out.unionByName(found.drop("ord"))
        level = found.select("start", F.col("dst").alias("node"), "ord")
        seen = seen.unionByName(level.select("start", "node"))
    long = out.groupBy("start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_STEPS).select("start")
    return out.join(long, "start", "left_semi")


def processes(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """``id, name, entry_point_id, step_count, label``: one process per flow, named after the words of its symbols."""
    names = nodes.select("id", "name", "file_path")
    counts = walked.groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("step_count"))
    members = walked.select("start", F.col("dst").alias("id")).unionByName(walked.select("start", F.col("start").alias("id")).distinct())
    words = members.join(names.where("name is not null"), "id").select("start", F.explode(name_words(F.col("name"))).alias("word"))
    words = words.where((F.length("word") >= 3) & ~F.col("word").isin(LABEL_STOPS)).groupBy("start", "word").agg(F.count(F.lit(1)).alias("n"))
    top = words.withColumn("r", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("n"), "word"))).where("r <= 3")
    label = top.groupBy(F.col("start").alias("id")).agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("w"))
    told = F.when(F.size("w") >= 2, F.array_join(F.col("w.word"), " ")).otherwise(F.concat("name", F.lit("-flow")))
    return counts.join(names, "id").join(label, "id", "left").select(
        F.concat(F.lit("Process:"), "file_path", F.lit(":process-"), "id").alias("id"), F.concat("name", F.lit("-flow")).alias("name"),
        F.col("id").alias("entry_point_id"), "step_count", F.coalesce(told, F.concat("name", F.lit("-flow"))).alias("label"),
    )


def step_edges(walked: DataFrame) -> DataFrame:
    """``src, dst, type, confidence, reason, step`` of the steps, each pair and depth once."""
    return walked.select("src", "dst", F.col("depth").alias("step")).distinct().select(
        "src", "dst", F.lit("PROCESS_STEP").alias("type"), F.lit(0.85).alias("confidence"), F.lit("bfs-from-entry-point").alias("reason"), "step"
    )


def affected(targets: DataFrame, steps: DataFrame, procs: DataFrame, depth: int = 8) -> DataFrame:
    """``start, process_id``: processes whose entry point is the target or reaches it in ``depth`` steps."""
    up = traverse(steps, targets, None, "up", depth).select("start", "node_id").unionByName(targets.select("start", F.col("start").alias("node_id")))
    return up.join(procs.select(F.col("entry_point_id").alias("node_id"), F.col("id").alias("process_id")), "node_id").select("start", "process_id").distinct()


def grouped_hits(hits: DataFrame, steps: DataFrame, procs: DataFrame, depth: int = 10) -> DataFrame:
    """``qid, process_id, score, n_members``: processes that the hits of a query lie in, by their best hit.

    ``hits(qid, node_id, score)``.  A process counts if its entry point is a hit or reaches one; its
    members are what the entry point reaches, and its score is the best of its members' scores.
    """
    best = hits.groupBy("qid", "node_id").agg(F.max("score").alias("score"))
    near = affected(best.select(F.col("node_id").alias("start")).distinct(), steps, procs, depth)
    mine = best.join(near, best["node_id"] == near["start"]).select("qid", "process_id").distinct()
    roots = procs.select(F.col("id").alias("process_id"), F.col("entry_point_id").alias("start"))
    down = traverse(steps, roots.select("start").distinct(), None, "down", depth).select("start", "node_id").unionByName(roots.select("start", F.col("start").alias("node_id")).distinct())
    members = roots.join(down, "start").select("process_id", "node_id").distinct()
    sizes = members.groupBy("process_id").agg(F.count(F.lit(1)).alias("n_members"))
    scored = mine.join(members, "process_id").join(best, ["qid", "node_id"]).groupBy("qid", "process_id").agg(F.max("score").alias("score"))
    return mine.join(scored, ["qid", "process_id"], "left").join(sizes, "process_id").select("qid", "process_id", F.coalesce("score", F.lit(0.0)).alias("score"), "n_members")
