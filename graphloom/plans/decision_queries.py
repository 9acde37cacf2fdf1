"""Queries that end in a decision or a ranking: packs, verdicts, resolution orders, hybrids; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import analytics as N
from graphloom.operators import delta as D
from graphloom.operators import joins as J
from graphloom.operators import linearize
from graphloom.operators import retrieval as R
from graphloom.operators import traversal as T
from graphloom.operators.finders import is_test_path
from graphloom.plans.graph_queries import _TYPES, E_SQL, N_SQL, NE, S0_SQL, STARTS, _pagerank_sql, _walk, edges, nodes
from graphloom.plans.history_queries import _TOK
from graphloom.plans.relation_queries import _TEST
from graphloom.runtime import small, table

QUERIES: dict = {}
SQL: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@q("g10_change_pack", f"""WITH RECURSIVE {NE}, {S0_SQL}, {_walk('up', 4, _TYPES, ' AND confidence >= 0.7')},
  m AS (SELECT node_id, min(depth) AS depth FROM best WHERE r = 1 GROUP BY 1) SELECT m.node_id, depth, {_TEST} AS is_test FROM m JOIN n ON n.id = m.node_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d)
    hit = T.traverse(edges(s, d), T.query_set(n, STARTS), T.IMPACT_TYPES, "up", 4, 0.7)
    m = hit.groupBy("node_id").agg(F.min("depth").alias("depth"))
    return m.join(n.select(F.col("id").alias("node_id"), "file_path"), "node_id").select("node_id", "depth", F.coalesce(is_test_path(F.col("file_path")), F.lit(False)).alias("is_test"))


@q("d06_api_impact", f"""WITH {NE}, k AS (SELECT DISTINCT e.dst AS id, f.file_path AS consumer FROM e JOIN n f ON f.id = e.src WHERE e.type = 'CALLS' AND f.file_path IS NOT NULL),
  c AS (SELECT n.id, count(k.consumer) AS consumers FROM n LEFT JOIN k ON k.id = n.id AND k.consumer <> coalesce(n.file_path, '') WHERE coalesce(is_exported, FALSE) AND kind IN ('Function', 'Method') GROUP BY 1)
  SELECT id, consumers, CASE WHEN consumers >= 20 THEN 'CRITICAL' WHEN consumers >= 5 THEN 'HIGH' WHEN consumers >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM c""")
def _(s, d):
    n = nodes(s, d)
    api = n.where(F.coalesce("is_exported", F.lit(False)) & F.col("kind").isin("Function", "Method")).select("id", F.coalesce("file_path", F.lit("")).alias("own"))
    calls = edges(s, d).where("type = 'CALLS'").select("src", F.col("dst").alias("id"))
    used = calls.join(n.where("file_path is not null").select(F.col("id").alias("src"), F.col("file_path").alias("consumer")), "src").select("id", "consumer").distinct()
    c = api.join(used, "id", "left").groupBy("id").agg(F.count_if(F.col("consumer") != F.col("own")).alias("consumers"))
    risk = F.when(F.col("consumers") >= 20, "CRITICAL").when(F.col("consumers") >= 5, "HIGH").when(F.col("consumers") >= 1, "MEDIUM").otherwise("LOW")
    return c.select("id", "consumers", risk.alias("risk"))


@q("d10_verdicts", f"""WITH RECURSIVE {NE}, {S0_SQL}, {_walk('up', 3, _TYPES, ' AND confidence >= 0.7')},
  h AS (SELECT b.start, b.node_id, t.repo_uri FROM best b LEFT JOIN n t ON t.id = b.node_id WHERE r = 1),
  m AS (SELECT s0.start, count(h.node_id) AS radius, count(DISTINCT h.repo_uri) AS modules FROM s0 LEFT JOIN h ON h.start = s0.start GROUP BY 1)
  SELECT m.start, radius, modules, CASE WHEN radius >= 50 THEN 'block' WHEN radius >= 20 THEN 'expert' WHEN modules >= 3 OR radius >= 5 OR coalesce(cyclomatic_complexity, 0) > 10 AND description IS NULL THEN 'dual'
    WHEN coalesce(cyclomatic_complexity, 0) > 10 THEN 'single' ELSE 'auto' END AS tier FROM m JOIN n ON n.id = m.start""")
def _(s, d):
    n = nodes(s, d)
    starts = T.query_set(n, STARTS)
    hit = T.traverse(edges(s, d), starts, T.IMPACT_TYPES, "up", 3, 0.7).join(n.select(F.col("id").alias("node_id"), "repo_uri"), "node_id", "left")
    m = hit.groupBy("start").agg(F.count(F.lit(1)).alias("radius"), F.count_distinct("repo_uri").alias("modules"))
    own = n.select(F.col("id").alias("start"), (F.coalesce("cyclomatic_complexity", F.lit(0)) > 10).alias("complex"), F.col("description").isNull().alias("bare"))
    g = starts.join(m, "start", "left").fillna(0, ["radius", "modules"]).join(own, "start")
    # a symbol that is complex and untold stands for one that is complex and untested, as the tables hold no coverage
    tier = D.tier(F.col("radius"), F.col("modules"), F.col("complex") & F.col("bare"), warnings=F.col("complex").cast("int"))
    return g.select("start", "radius", "modules", tier.alias("tier"))


@q("t09_test_ratio", """SELECT DISTINCT source_file, target_file, cocommit_count::DOUBLE / (total_commits_source + total_commits_target - cocommit_count) AS ratio FROM cochanges
  WHERE total_commits_source + total_commits_target > cocommit_count""")
def _(s, d):
    c = table(s, d, "cochanges").where("total_commits_source + total_commits_target > cocommit_count")
    return c.select("source_file", "target_file", (F.col("cocommit_count") / (F.col("total_commits_source") + F.col("total_commits_target") - F.col("cocommit_count"))).alias("ratio")).distinct()


@q("t15_community_risk", f"""WITH {NE}, m AS (SELECT id, repo_uri AS community FROM n WHERE repo_uri IS NOT NULL), z AS (SELECT community, count(*) AS k FROM m GROUP BY 1),
  g AS (SELECT a.community, avg(e.confidence) AS m FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.community = b.community AND e.src <> e.dst GROUP BY 1)
  SELECT z.community, floor(k * (1 - least(greatest(CASE WHEN k < 2 THEN 0.0 ELSE coalesce(g.m, 0.0) END, 0.0), 1.0)) * 1000.0 + 0.5) / 1000.0 AS risk FROM z LEFT JOIN g USING (community)""")
def _(s, d):
    m = nodes(s, d).where("repo_uri is not null").select("id", F.col("repo_uri").alias("community"))
    sizes = m.groupBy("community").agg(F.count(F.lit(1)).alias("k"))
    c = F.least(F.greatest(F.col("cohesion"), F.lit(0.0)), F.lit(1.0))
    return sizes.join(N.cohesion(edges(s, d), m), "community").select("community", (F.floor(F.col("k") * (1 - c) * 1000.0 + 0.5) / 1000.0).alias("risk"))


@q("n03_skeleton", f"SELECT m.id, coalesce(x.rank, 0.0) AS score FROM (WITH {N_SQL} SELECT id FROM n WHERE kind IN ('Function', 'Method')) m LEFT JOIN ({_pagerank_sql(50)}) x ON x.id = m.id")
def _(s, d):
    r = N.pagerank(edges(s, d).where("type = 'CALLS'"))
    return nodes(s, d).where("kind in ('Function', 'Method')").select("id").join(r, "id", "left").select("id", F.coalesce(F.round("rank", 9), F.lit(0.0)).alias("score"))


@q("n12_resolution_orders", f"""WITH RECURSIVE {E_SQL}, l AS (SELECT DISTINCT src AS child, dst AS parent FROM e WHERE type = 'EXTENDS' AND src IS NOT NULL AND dst IS NOT NULL),
  t AS (SELECT parent AS cls, [parent] AS mro FROM (SELECT DISTINCT parent FROM l) WHERE parent NOT IN (SELECT child FROM l) UNION ALL SELECT l.child, list_prepend(l.child, t.mro) FROM t JOIN l ON l.parent = t.cls) SELECT cls, mro FROM t""")
def _(s, d):
    l = edges(s, d).where("type = 'EXTENDS'").select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.lit(0).alias("pos"))
    return linearize.linearise(l)


_BM25 = f"""w AS (SELECT doc_id AS id, {_TOK.format(c="concat_ws(' ', title, text)")} AS w FROM documents), l AS (SELECT id, len(w) AS len FROM w),
  p AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM w) GROUP BY 1, 2), st AS (SELECT count(*) AS n, avg(len) AS av FROM l),
  qs AS (SELECT DISTINCT doc_id AS qid, unnest({_TOK.format(c='title')}) AS term FROM documents WHERE doc_id % 20 = 0), need AS (SELECT qid, count(*) AS terms FROM qs GROUP BY 1),
  f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT qid, p.id, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) AS s FROM qs JOIN p USING (term) JOIN f USING (term) JOIN l ON l.id = p.id, st),
  h AS (SELECT qid, id, sum(s) AS score, count(*) AS k FROM s GROUP BY 1, 2)"""


def _titles(docs: DataFrame) -> DataFrame:
    """The stated query set: the whole titles of all documents whose id is divisible by 20."""
    return docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("title").alias("text"))


def _text_run(s: SparkSession, d: str, limit: int | None) -> DataFrame:
    """The stated query set against all documents."""
    docs = table(s, d, "documents")
    return R.bm25(docs, "doc_id", ["title", "text"], _titles(docs), limit)


@q("r01_bm25", f"""WITH {_BM25}, r AS (SELECT h.*, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e9) DESC, id) AS pos FROM h JOIN need USING (qid) WHERE k = terms)
  SELECT qid, id, round(score, 6) AS score FROM r WHERE pos <= 50""")
def _(s, d):
    return _text_run(s, d, 50).select("qid", "id", F.round("score", 6).alias("score"))


@q("r04_hybrid", f"""WITH {_BM25}, a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e9) DESC, id) AS pos FROM h JOIN need USING (qid) WHERE k = terms),
  x AS (SELECT v.vec_id AS qid, b.vec_id AS id, 1 - list_cosine_similarity(v.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings v, embeddings b WHERE v.vec_id % 20 = 0),
  b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS pos FROM x),
  u AS (SELECT qid, id, pos, 0 AS run FROM a WHERE pos <= 50 UNION ALL SELECT qid, id, pos, 1 FROM b WHERE pos <= 10), g AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + pos)) AS score, min((run, pos)) AS f FROM u GROUP BY 1, 2)
  SELECT qid, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e12) DESC, f, id) AS r FROM g) WHERE r <= 50""")
def _(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = R.knn(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "v"))
    return R.fuse(_text_run(s, d, 50), near).select("qid", "id", F.round("score", 9).alias("score"))


@q("r06_group_query", f"""WITH {_BM25}, r AS (SELECT h.qid, h.id, h.score, d.repo_uri FROM h JOIN need USING (qid) JOIN documents d ON d.doc_id = h.id WHERE k = terms AND d.repo_uri IS NOT NULL),
  m AS (SELECT least(greatest(50, ceil(100.0 / count(DISTINCT repo_uri))), 200) AS per_repo FROM documents),
  t AS (SELECT *, row_number() OVER (PARTITION BY qid, repo_uri ORDER BY floor(score * 1e9) DESC, id) AS pos FROM r)
  SELECT qid, repo_uri, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, repo_uri, id) AS o FROM t, m WHERE pos <= per_repo) WHERE o <= 50""")
def _(s, d):
    docs = table(s, d, "documents")
    per_repo = R.group_limit(50, docs.agg(F.count_distinct("repo_uri")).first()[0])
    hit = R.bm25_by_part(docs, "doc_id", ["title", "text"], "repo_uri", _titles(docs), per_repo)
    return hit.select("qid", F.col("part").alias("repo_uri"), "id", "pos")


@q("c08_found_in", f"""WITH {N_SQL}, p AS (SELECT id, file_path, coalesce(start_line, 1) AS line FROM n WHERE kind = 'Property'),
  s AS (SELECT p.id, n.id AS target, row_number() OVER (PARTITION BY p.id ORDER BY end_line - start_line, start_line, end_line, n.id) AS r FROM p JOIN n USING (file_path) WHERE n.kind IN ('Class', 'Struct', 'Function') AND line BETWEEN start_line AND end_line)
  SELECT p.id, f.id AS target, 0 AS step FROM p JOIN n f ON f.kind = 'File' AND f.file_path = p.file_path UNION ALL SELECT id, target, 1 FROM s WHERE r = 1""")
def _(s, d):
    n = nodes(s, d)
    p = n.where("kind = 'Property'").select("id", "file_path", F.coalesce("start_line", F.lit(1)).alias("line"))
    files = n.where("kind = 'File'").select("file_path", F.col("id").alias("target"))
    to_file = p.join(files, "file_path").select("id", "target", F.lit(0).alias("step"))
    inner = J.innermost(p.select(F.col("id").alias("probe_id"), "file_path", "line"), n.where("kind in ('Class', 'Struct', 'Function')"))
    return to_file.unionByName(inner.select(F.col("probe_id").alias("id"), F.col("symbol_id").alias("target"), F.lit(1).alias("step")))


@q("s21_newest_snapshots", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("r")).where("r <= 100").drop("r")


@q("t17_divergence", """WITH o AS (SELECT DISTINCT p_brand AS branch, l_orderkey AS sha FROM lineitem JOIN part ON p_partkey = l_partkey), base AS (SELECT sha FROM o WHERE branch = (SELECT min(branch) FROM o)),
  c AS (SELECT branch, count(*) AS k, count(*) FILTER (WHERE sha IN (SELECT sha FROM base)) AS hit FROM o GROUP BY 1) SELECT branch, k - hit AS ahead, (SELECT count(*) FROM base) - hit AS behind FROM c""")
def _(s, d):
    o = table(s, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("sha")).join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("branch")), "l_partkey").select("branch", "sha").distinct()
    # a commit knows whether the base has it: one aggregation per commit instead of a join of branches
    base = o.agg(F.min("branch").alias("base")).first()["base"]
    is_base = F.col("branch") == F.lit(base)
    per = o.withColumn("in_base", F.max(is_base).over(Window.partitionBy("sha")))
    g = per.groupBy("branch").agg(F.count(F.lit(1)).alias("k"), F.count_if("in_base").alias("both"))
    n = o.where(is_base).count()
    return g.select("branch", (F.col("k") - F.col("both")).alias("ahead"), (F.lit(n) - F.col("both")).alias("behind"))


@q("t20_staleness", """WITH r AS (SELECT repo_uri, max(strptime(index_time, '%Y-%m-%dT%H:%M:%SZ')) AS t FROM repos WHERE repo_uri IS NOT NULL GROUP BY 1)
  SELECT r.repo_uri, count(e.id) FILTER (WHERE e.indexed_at > r.t) AS behind, count(e.id) FILTER (WHERE e.indexed_at > r.t) > 0 AS stale FROM r LEFT JOIN edges e ON e.repo_uri = r.repo_uri GROUP BY 1""")
def _(s, d):
    t = F.try_to_timestamp("index_time", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz")
    r = table(s, d, "repos").where("repo_uri is not null").groupBy("repo_uri").agg(F.max(t).alias("t"))
    r = s.createDataFrame(small(r, 100_000, "repos"), "repo_uri string, t timestamp_ntz")
    # the repositories, whose number was checked, go to the edges, and these fold to counts where they are read
    late = table(s, d, "edges").select("repo_uri", "indexed_at").join(F.broadcast(r), "repo_uri").where("indexed_at > t").groupBy("repo_uri").agg(F.count(F.lit(1)).alias("behind"))
    return r.select("repo_uri").join(late, "repo_uri", "left").select("repo_uri", F.coalesce("behind", F.lit(0)).alias("behind"), (F.coalesce("behind", F.lit(0)) > 0).alias("stale"))
