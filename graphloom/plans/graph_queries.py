"""Queries over the merged graph tables: finders, counts, joins, traversal and analytics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import aggregates as A
from graphloom.operators import analytics as N
from graphloom.operators import delta as D
from graphloom.operators import finders as FI
from graphloom.operators import joins as J
from graphloom.operators import traversal as T
from graphloom.operators.graph_tables import merge_edges, merge_nodes
from graphloom.runtime import table

_COLS = "id kind name file_path start_line end_line language signature description owner parameter_count is_exported cyclomatic_complexity repo_uri".split()
_ALL = (
    "kind name file_path start_line end_line language content content_hash signature description owner parameter_count "
    "return_type is_exported cyclomatic_complexity repo_uri indexed_at removed_at"
).split()

#: The delivery rules in SQL: the tables n and e.
N_SQL = f"""n AS (SELECT {', '.join(_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY
  {' + '.join(f'({c} IS NOT NULL)::INT' for c in _ALL)} DESC, indexed_at) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1)"""
E_SQL = """e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY confidence DESC NULLS LAST, loaded_at) AS rn
  FROM edges WHERE id IS NOT NULL) WHERE rn = 1)"""
NE = f"{N_SQL}, {E_SQL}"

#: Kinds that traversals start from, and their stated query set in SQL.
STARTS = ["Function", "Method", "Class", "Struct"]
S0_SQL = """s0 AS (SELECT id AS start FROM n WHERE kind IN ('Function', 'Method', 'Class', 'Struct') AND ('0x' || substring(sha256(id), 1, 4))::INT % 20 = 0)"""

QUERIES: dict = {}
SQL: dict = {}


def nodes(s: SparkSession, d: str) -> DataFrame:
    return merge_nodes(table(s, d, "nodes"), _COLS)


def edges(s: SparkSession, d: str) -> DataFrame:
    return merge_edges(table(s, d, "edges"))


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_FIRST = "(SELECT min(id) FROM nodes WHERE kind = 'Class')"


def _first(s, d, kind):
    return table(s, d, "nodes").where(F.col("kind") == kind).agg(F.min("id").alias("start"))


@q("f01_get_node", f"WITH {N_SQL} SELECT id, kind, name, file_path, start_line, end_line FROM n WHERE id = {_FIRST}")
def _(s, d):
    first = _first(s, d, "Class")
    return nodes(s, d).join(F.broadcast(first), F.col("id") == F.col("start")).select("id", "kind", "name", "file_path", "start_line", "end_line")


@q("f02_list_nodes", f"WITH {N_SQL} SELECT id, kind, name FROM n WHERE kind IN ('Class', 'Struct')")
def _(s, d):
    return FI.list_nodes(nodes(s, d), ["Class", "Struct"]).select("id", "kind", "name")


@q("f02_page_of_nodes", f"WITH {N_SQL} SELECT id, kind FROM n WHERE kind = 'Method' ORDER BY id LIMIT 50 OFFSET 20")
def _(s, d):
    return FI.list_nodes(nodes(s, d), ["Method"], limit=50, offset=20).select("id", "kind")


@q("f03_by_kind_like", f"WITH {N_SQL} SELECT id, file_path FROM n WHERE kind = 'File' AND contains(lower(file_path), 'docs/')")
def _(s, d):
    return FI.list_by_kind(nodes(s, d), "File", "DOCS/").select("id", "file_path")


@q("f09_by_name", f"WITH {N_SQL} SELECT id, name, kind FROM n WHERE name = 'README.md'")
def _(s, d):
    return FI.list_by_name(nodes(s, d), "README.md").select("id", "name", "kind")


@q("f10_list_edges", f"WITH {E_SQL} SELECT id, src, dst, type, confidence FROM e WHERE type IN ('EXTENDS', 'REFERENCES') AND confidence >= 0.8")
def _(s, d):
    return FI.list_edges(edges(s, d), ["EXTENDS", "REFERENCES"], min_confidence=0.8).select("id", "src", "dst", "type", "confidence")


@q("f11_edges_by_type", f"WITH {E_SQL} SELECT id, src, dst FROM e WHERE type = 'ACCESSES'")
def _(s, d):
    return FI.list_edges(edges(s, d), ["ACCESSES"]).select("id", "src", "dst")


@q("f12_embeddings", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings WHERE label IN (1, 2, 3) ORDER BY vec_id LIMIT 100")
def _(s, d):
    return FI.list_embeddings(table(s, d, "embeddings"), "vec_id", "label", [1, 2, 3], 100).select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@q("f12_all_embeddings", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
def _(s, d):
    return FI.list_embeddings(table(s, d, "embeddings"), "vec_id", "label").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


_HOT = "(SELECT source_file FROM cochanges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@q("f14_cochanges_for", f"""SELECT DISTINCT source_file, target_file, lift FROM cochanges WHERE (source_file = {_HOT} OR target_file = {_HOT}) AND lift >= 1.0
  ORDER BY lift DESC, source_file, target_file LIMIT 10""")
def _(s, d):
    c = table(s, d, "cochanges")
    hot = c.groupBy("source_file").count().orderBy(F.desc("count"), "source_file").limit(1).first()["source_file"]
    return FI.cochanges_for(c.select("source_file", "target_file", "lift").distinct(), hot)


@q("f15_cochanges_between", "SELECT DISTINCT source_file, target_file, lift FROM cochanges ORDER BY source_file, target_file LIMIT 1")
def _(s, d):
    c = table(s, d, "cochanges").select("source_file", "target_file", "lift").distinct()
    p = c.agg(F.min(F.struct("source_file", "target_file")).alias("p")).first()["p"]
    return FI.cochanges_between(c, p["target_file"], p["source_file"])


@q("f16_resolve_target", f"""WITH {N_SQL}, t AS (SELECT DISTINCT name AS query FROM n WHERE kind = 'Class' AND name NOT LIKE '%:%:%'),
  f AS (SELECT query, id, coalesce(file_path, '') = '<unresolved>' AS stub FROM t JOIN n ON n.name = t.query),
  p AS (SELECT query, count(*) FILTER (WHERE NOT stub) AS real, count(*) AS al FROM f GROUP BY 1)
  SELECT f.query, f.id, CASE WHEN real > 0 THEN real ELSE al END AS n_candidates, CASE WHEN real > 0 THEN real ELSE al END > 1 AS ambiguous
  FROM f JOIN p USING (query) WHERE NOT stub OR real = 0""")
def _(s, d):
    n = nodes(s, d)
    return FI.resolve_target(n, n.where("kind = 'Class'").select(F.col("name").alias("query")).where("not query like '%:%:%'").distinct())


@q("f19_test_paths", f"""WITH {N_SQL} SELECT id, (len(list_intersect(string_split(lower(file_path), '/'), ['test', 'tests', 'spec', 'specs', '__tests__'])) > 0
  OR contains(lower(file_path), '.test.') OR contains(lower(file_path), '.spec.')) AS is_test FROM n WHERE kind = 'File'""")
def _(s, d):
    return nodes(s, d).where("kind = 'File'").select("id", X.is_test_path(F.col("file_path")).alias("is_test"))


@q("f22_list_repos", "SELECT name, repo_uri, coalesce(default_branch, 'main') AS branch, repo_group FROM repos")
def _(s, d):
    return table(s, d, "repos").select("name", "repo_uri", F.coalesce("default_branch", F.lit("main")).alias("branch"), "repo_group")


@q("f23_snippets", f"WITH {N_SQL} SELECT id, substring(description, 1, 200) AS snippet FROM n WHERE description IS NOT NULL")
def _(s, d):
    return nodes(s, d).where("description is not null").select("id", F.substring("description", 1, 200).alias("snippet"))


_KINDS = ["File", "Function", "Method", "Class", "Route", "Tool"]


@q("a01_count_by_kind", f"""WITH {N_SQL} SELECT k.kind, count(n.id) AS n FROM (SELECT unnest({_KINDS}) AS kind) k LEFT JOIN n ON n.kind = k.kind GROUP BY 1""")
def _(s, d):
    return A.count_by(nodes(s, d), "kind", _KINDS)


@q("a02_count_by_type", f"WITH {E_SQL} SELECT k.type, count(e.id) AS n FROM (SELECT unnest({A.EDGE_TYPES}) AS type) k LEFT JOIN e ON e.type = k.type GROUP BY 1")
def _(s, d):
    return A.count_by(edges(s, d), "type", A.EDGE_TYPES)


@q("a03_stats", f"""WITH {NE} SELECT 'node' AS what, kind AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2""")
def _(s, d):
    a = A.count_by(nodes(s, d), "kind").select(F.lit("node").alias("what"), F.col("kind").alias("name"), "n")
    return a.unionByName(A.count_by(edges(s, d), "type").select(F.lit("edge").alias("what"), F.col("type").alias("name"), "n"))


@q("a04_grouped_examples", f"""WITH {E_SQL} SELECT type, reason, count(*) AS n, list_slice(list_sort(list(id)), 1, 3) AS examples FROM e GROUP BY 1, 2""")
def _(s, d):
    return A.grouped_examples(edges(s, d), ["type", "reason"])


_TIER = "CASE WHEN license IS NULL OR trim(license) = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(upper(trim(license)), '{rx}') THEN '{t}'" for t, rx in X.LICENSE_TIERS) + " ELSE 'unknown' END"


@q("a05_license_audit", f"""WITH g AS (SELECT ecosystem, count(*) FILTER (WHERE regexp_matches(upper(trim(license)), '{X.COPYLEFT}')) AS n_copyleft,
  count(*) FILTER (WHERE {_TIER} = 'proprietary') AS n_proprietary, count(*) FILTER (WHERE license IS NULL OR trim(license) = '') AS n_unknown, count(*) AS n
  FROM external_symbols GROUP BY 1) SELECT *, CASE WHEN n_copyleft > 0 OR n_proprietary > 0 THEN 'BLOCK' WHEN n_unknown > 0 THEN 'WARN' ELSE 'OK' END AS verdict FROM g""")
def _(s, d):
    return A.license_audit(table(s, d, "external_symbols"))


@q("x10_license_tier", f"SELECT id, {_TIER} AS tier FROM external_symbols")
def _(s, d):
    return table(s, d, "external_symbols").select("id", X.license_tier(F.col("license")).alias("tier"))


@q("a08_confidence", f"""WITH {E_SQL}, c AS (SELECT type, coalesce(confidence >= 0.95 AND reason LIKE 'scip:%', FALSE) AS yes, coalesce(confidence <= 0.2, FALSE) AS low FROM e)
  SELECT type, count(*) FILTER (WHERE yes) AS confirmed, count(*) FILTER (WHERE NOT yes AND low) AS unknown, count(*) FILTER (WHERE NOT yes AND NOT low) AS heuristic FROM c GROUP BY 1""")
def _(s, d):
    return A.confidence_breakdown(edges(s, d))


@q("a11_language_shares", f"""WITH {N_SQL}, l AS (SELECT DISTINCT repo_uri, language FROM n WHERE kind = 'File' AND language IS NOT NULL)
  SELECT repo_uri, language, 1.0 / count(*) OVER (PARTITION BY repo_uri) AS share FROM l""")
def _(s, d):
    return A.language_shares(nodes(s, d))


@q("a12_median", f"WITH {N_SQL} SELECT language, median(cyclomatic_complexity) AS median FROM n WHERE cyclomatic_complexity IS NOT NULL GROUP BY 1")
def _(s, d):
    return A.median_by(nodes(s, d).where("cyclomatic_complexity is not null"), "language", "cyclomatic_complexity")


@q("a13_dispersion", """SELECT event_type, count(value) AS n, avg(value) AS mean, CASE WHEN count(value) < 2 THEN 0.0 ELSE stddev_pop(value) END AS deviation,
  count(DISTINCT user_id) / count(user_id) AS distinct_ratio FROM events GROUP BY 1""")
def _(s, d):
    return A.dispersion(table(s, d, "events"), "event_type", "value", "user_id")


@q("a14_complex_files", f"""WITH {N_SQL} SELECT file_path, max(cyclomatic_complexity) AS max_complexity, max(cyclomatic_complexity) > 10 AS flagged FROM n
  WHERE cyclomatic_complexity IS NOT NULL AND file_path IS NOT NULL GROUP BY 1""")
def _(s, d):
    return A.complex_files(nodes(s, d))


@q("a15_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(s, d):
    return A.last_wins(table(s, d, "events"), "user_id", "event_id", ["event_type", "value"])


@q("j01_cross_repo", f"""WITH {NE} SELECT e.id, e.src, e.dst, a.repo_uri AS src_repo, b.repo_uri AS dst_repo FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst
  WHERE e.type = 'CALLS' AND a.repo_uri <> b.repo_uri""")
def _(s, d):
    return J.cross_repo(edges(s, d), nodes(s, d), "CALLS")


@q("j02_hydrate", f"WITH {NE} SELECT e.id, n.kind, n.name FROM e JOIN n ON n.id = e.dst WHERE e.type = 'EXTENDS'")
def _(s, d):
    e = edges(s, d).where("type = 'EXTENDS'").select("id", "dst")
    return e.join(nodes(s, d).select(F.col("id").alias("dst"), "kind", "name"), "dst").select("id", "kind", "name")


@q("j03_edges_in_set", f"WITH {NE} SELECT id, type FROM e WHERE src IN (SELECT id FROM n WHERE kind = 'Struct')")
def _(s, d):
    st = nodes(s, d).where("kind = 'Struct'").select(F.col("id").alias("src"))
    return edges(s, d).join(st, "src", "left_semi").select("id", "type")


@q("j04_unknown_edges", f"WITH {NE} SELECT id, dst FROM e WHERE dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.dst)")
def _(s, d):
    e = edges(s, d).where("dst is not null")
    return e.join(nodes(s, d).select(F.col("id").alias("dst")), "dst", "left_anti").select("id", "dst")


_SYM = "n.kind NOT IN ('File', 'Folder') AND n.start_line IS NOT NULL AND n.end_line IS NOT NULL"


@q("j05_hunks_on_symbols", f"""WITH {N_SQL}, h AS (SELECT id AS hunk_id, file_path, start_line AS h1, start_line + 4 AS h2 FROM n WHERE kind = 'Property' AND start_line IS NOT NULL)
  SELECT h.hunk_id, n.id AS symbol_id, greatest(h1, start_line) AS first_line, least(h2, end_line) AS last_line, least(h2, end_line) - greatest(h1, start_line) + 1 AS n_lines
  FROM h JOIN n USING (file_path) WHERE {_SYM} AND h2 >= start_line AND h1 <= end_line""")
def _(s, d):
    n = nodes(s, d)
    h = n.where("kind = 'Property'").select(F.col("id").alias("hunk_id"), "file_path", F.col("start_line").alias("start"), F.lit(5).alias("count"))
    return J.overlapping(h, n)


@q("j06_innermost", f"""WITH {N_SQL}, p AS (SELECT id AS probe_id, file_path, start_line AS line FROM n WHERE kind IN ('Property', 'Method') AND start_line IS NOT NULL)
  SELECT probe_id, symbol_id, span FROM (SELECT p.probe_id, n.id AS symbol_id, end_line - start_line AS span,
    row_number() OVER (PARTITION BY probe_id ORDER BY end_line - start_line, start_line, end_line, n.id) AS r
    FROM p JOIN n USING (file_path) WHERE n.kind IN ('Class', 'Struct', 'Function') AND line BETWEEN start_line AND end_line) WHERE r = 1""")
def _(s, d):
    n = nodes(s, d)
    p = n.where("kind in ('Property', 'Method')").select(F.col("id").alias("probe_id"), "file_path", F.col("start_line").alias("line"))
    return J.innermost(p, n.where("kind in ('Class', 'Struct', 'Function')"))


@q("j08_latest_start", f"""WITH {N_SQL}, p AS (SELECT id AS probe_id, file_path, start_line AS line FROM n WHERE kind = 'Property')
  SELECT probe_id, symbol_id FROM (SELECT p.probe_id, n.id AS symbol_id, row_number() OVER (PARTITION BY probe_id ORDER BY start_line DESC NULLS LAST, n.id DESC) AS r
    FROM p LEFT JOIN n ON n.file_path = p.file_path AND n.kind IN ('Class', 'Struct') AND line BETWEEN start_line AND end_line) WHERE r = 1""")
def _(s, d):
    n = nodes(s, d)
    p = n.where("kind = 'Property'").select(F.col("id").alias("probe_id"), "file_path", F.col("start_line").alias("line"))
    return J.latest_start(p, n.where("kind in ('Class', 'Struct')"))


@q("j09_preceded", """SELECT DISTINCT f.event_id, f.user_id FROM events f JOIN events g ON g.user_id = f.user_id AND g.event_type = 'signup' AND g.ts < f.ts
  AND f.ts - g.ts <= INTERVAL 172800 SECOND WHERE f.event_type = 'error'""")
def _(s, d):
    return J.preceded(table(s, d, "events"), "signup", "error", 172_800)


@q("j14_tiered", f"""WITH {NE}, r AS (SELECT e.id AS ref_id, t.name, f.file_path, f.repo_uri FROM e JOIN n f ON f.id = e.src JOIN n t ON t.id = e.dst WHERE e.type = 'CALLS'),
  i AS (SELECT * FROM n WHERE kind IN ('Function', 'Method')),
  a AS (SELECT name, file_path, min(id) AS x FROM i GROUP BY 1, 2), b AS (SELECT name, repo_uri, min(id) AS y FROM i WHERE repo_uri IS NOT NULL GROUP BY 1, 2), c AS (SELECT name, min(id) AS z FROM i GROUP BY 1)
  SELECT ref_id, coalesce(x, y, z) AS target, CASE WHEN x IS NOT NULL THEN 'same-file' WHEN y IS NOT NULL THEN 'import' WHEN z IS NOT NULL THEN 'global' END AS tier,
  CASE WHEN x IS NOT NULL THEN 0.95::DOUBLE WHEN y IS NOT NULL THEN 0.9 WHEN z IS NOT NULL THEN 0.5 END AS confidence
  FROM r LEFT JOIN a USING (name, file_path) LEFT JOIN b USING (name, repo_uri) LEFT JOIN c USING (name)""")
def _(s, d):
    n, e = nodes(s, d), edges(s, d)
    slim = n.select("id", "name", "file_path", "repo_uri")
    calls = e.where("type = 'CALLS'").select(F.col("id").alias("ref_id"), "src", "dst")
    r = calls.join(slim.select(F.col("id").alias("src"), "file_path", "repo_uri"), "src").join(slim.select(F.col("id").alias("dst"), "name"), "dst").select("ref_id", "name", "file_path", "repo_uri")
    return J.tiered(r, n.where("kind in ('Function', 'Method')"))


@q("w07_merged_lines", f"""WITH {N_SQL}, r AS (SELECT DISTINCT file_path, start_line AS s, end_line + 1 AS t FROM n WHERE kind IN ('Function', 'Method') AND end_line + 1 > start_line AND file_path IS NOT NULL),
  f AS (SELECT *, max(t) OVER (PARTITION BY file_path ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
  g AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS isle FROM f)
  SELECT file_path, min(s) AS s, max(t) AS t FROM g GROUP BY file_path, isle""")
def _(s, d):
    n = nodes(s, d).where("kind in ('Function', 'Method') and file_path is not null").select("file_path", F.col("start_line").alias("s"), (F.col("end_line") + 1).alias("t"))
    return J.merge_intervals(n, "file_path", "s", "t")


def _walk(direction: str, depth: int, types: str = "", conf: str = "") -> str:
    down, up = "SELECT src AS a, dst AS b FROM e WHERE src <> dst", "SELECT dst AS a, src AS b FROM e WHERE src <> dst"
    pick = {"down": down, "up": up, "both": f"{down}{{0}} UNION {up}{{0}}"}[direction]
    where = types + conf
    pick = pick.format(where) if direction == "both" else pick + where
    return f"""st AS (SELECT DISTINCT a, b FROM ({pick})),
  w AS (SELECT start, start AS node_id, 0 AS depth, [start] AS path FROM s0 UNION ALL
    SELECT w.start, st.b, w.depth + 1, list_append(w.path, st.b) FROM w JOIN st ON st.a = w.node_id WHERE w.depth < {depth} AND NOT list_contains(w.path, st.b)),
  best AS (SELECT *, row_number() OVER (PARTITION BY start, node_id ORDER BY depth, path) AS r FROM w WHERE depth > 0)"""


_TYPES = " AND type IN ('CALLS', 'IMPORTS', 'EXTENDS', 'IMPLEMENTS', 'METHOD_OVERRIDES', 'METHOD_IMPLEMENTS', 'HAS_METHOD', 'HAS_PROPERTY')"


@q("g01_traverse", f"WITH RECURSIVE {NE}, {S0_SQL}, {_walk('down', 4)} SELECT start, node_id, depth, path FROM best WHERE r = 1")
def _(s, d):
    return T.traverse(edges(s, d), T.query_set(nodes(s, d), STARTS), None, "down", 4)


@q("g02_traverse_both", f"WITH RECURSIVE {NE}, {S0_SQL}, {_walk('both', 3, ''' AND type IN ('DEFINES', 'HAS_METHOD', 'EXTENDS')''')} SELECT start, node_id, depth, path FROM best WHERE r = 1")
def _(s, d):
    return T.traverse(edges(s, d), T.query_set(nodes(s, d), STARTS), ["DEFINES", "HAS_METHOD", "EXTENDS"], "both", 3)


@q("g03_ancestors", f"WITH RECURSIVE {NE}, s0 AS (SELECT id AS start FROM n WHERE kind = 'Property'), {_walk('up', 8, ''' AND type IN ('HAS_PROPERTY', 'DEFINES')''')} SELECT start, node_id, depth, path FROM best WHERE r = 1")
def _(s, d):
    return T.traverse(edges(s, d), nodes(s, d).where("kind = 'Property'").select(F.col("id").alias("start")), ["HAS_PROPERTY", "DEFINES"], "up", 8)


@q("g04_impact", f"""WITH RECURSIVE {NE}, {S0_SQL}, {_walk('up', 3, _TYPES, ' AND confidence >= 0.7')},
  k AS (SELECT b.start, b.depth FROM best b JOIN n ON n.id = b.node_id WHERE r = 1 AND NOT coalesce(len(list_intersect(string_split(lower(file_path), '/'), ['test', 'tests', 'spec', 'specs', '__tests__'])) > 0
    OR contains(lower(file_path), '.test.') OR contains(lower(file_path), '.spec.'), FALSE)),
  g AS (SELECT start, count(*) FILTER (WHERE depth = 1) AS d1, count(*) FILTER (WHERE depth = 2) AS d2, count(*) FILTER (WHERE depth = 3) AS d3, count(*) AS n FROM k GROUP BY 1)
  SELECT *, (d1 * 3 + d2 + d3 * 0.3)::DOUBLE AS score, CASE WHEN n >= 1000 THEN 'CRITICAL' WHEN n >= 100 THEN 'HIGH' WHEN n >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_by_count,
  CASE WHEN d1 * 3 + d2 + d3 * 0.3 >= 30 THEN 'CRITICAL' WHEN d1 * 3 + d2 + d3 * 0.3 >= 10 THEN 'HIGH' WHEN d1 * 3 + d2 + d3 * 0.3 >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_by_score FROM g""")
def _(s, d):
    n = nodes(s, d)
    return T.impact(edges(s, d), n, T.query_set(n, STARTS))


@q("n01_adjacency", f"WITH {E_SQL} SELECT src, dst, sum(coalesce(confidence, 1.0)) AS w FROM e WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return N.adjacency(edges(s, d), "confidence")


def _pagerank_sql(n: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM v)::DOUBLE AS r FROM v)"]
    for i in range(n):
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * coalesce((SELECT sum(r) FROM r{i} WHERE id NOT IN (SELECT src FROM a)), 0) / (SELECT count(*) FROM v)
          + 0.85 * coalesce(x.s, 0) AS r FROM v LEFT JOIN (SELECT dst, sum(share * r) AS s FROM a JOIN r{i} ON r{i}.id = a.src GROUP BY 1) x ON x.dst = v.id)""")
    return f"""WITH {E_SQL}, a0 AS (SELECT src, dst, count(*)::DOUBLE AS w FROM e WHERE type = 'CALLS' AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2),
      a AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM a0), v AS MATERIALIZED (SELECT src AS id FROM a UNION SELECT dst FROM a), {', '.join(steps)}
      SELECT id, round(r, 9) AS rank FROM r{n}"""


@q("n02_pagerank", _pagerank_sql(50))
def _(s, d):
    return N.pagerank(edges(s, d).where("type = 'CALLS'")).select("id", F.round("rank", 9).alias("rank"))


@q("n04_communities")
def _(s, d):
    return N.communities(edges(s, d))


@q("n05_components", """WITH RECURSIVE u AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL UNION SELECT DISTINCT dst, src FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL),
  cc(id, component) USING KEY (id) AS (SELECT DISTINCT a AS id, a AS component FROM u
    UNION (SELECT p.id, min(c.component) FROM cc c JOIN u ON u.a = c.id JOIN recurring.cc p ON p.id = u.b WHERE c.component < p.component GROUP BY 1))
  SELECT id, component FROM cc""")
def _(s, d):
    return N.components(table(s, d, "edges"))


@q("n06_cohesion", f"""WITH {NE}, m AS (SELECT id, repo_uri AS community FROM n WHERE repo_uri IS NOT NULL), z AS (SELECT community, count(*) AS k FROM m GROUP BY 1),
  g AS (SELECT a.community, avg(e.confidence) AS m FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.community = b.community AND e.src <> e.dst GROUP BY 1)
  SELECT z.community, CASE WHEN k < 2 THEN 0.0 ELSE coalesce(g.m, 0.0) END AS cohesion FROM z LEFT JOIN g USING (community)""")
def _(s, d):
    m = nodes(s, d).where("repo_uri is not null").select("id", F.col("repo_uri").alias("community"))
    return N.cohesion(edges(s, d), m)


_WORDS = r"list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')"


@q("n07_keywords", f"""WITH {N_SQL}, w AS (SELECT repo_uri, unnest({_WORDS}) AS word FROM n WHERE repo_uri IS NOT NULL AND name IS NOT NULL),
  c AS (SELECT repo_uri, word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN ('get', 'set', 'is', 'has', 'the', 'a', 'an', 'to', 'from', 'of', 'for', 'on', 'in', 'at', 'by', 'and', 'or', 'not', 'with', 'new', 'my', 'do', 'run', 'it', 'init', 'fn', 'func') GROUP BY 1, 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_uri ORDER BY n DESC, word) AS pos FROM c) WHERE pos <= 5""")
def _(s, d):
    return N.keywords(nodes(s, d), "repo_uri")


@q("n08_degrees", f"""WITH {E_SQL}, k AS (SELECT DISTINCT src, dst FROM e WHERE type = 'CALLS' AND src IS NOT NULL AND dst IS NOT NULL), o AS (SELECT src AS id, count(*) AS callees FROM k GROUP BY 1),
  i AS (SELECT dst AS id, count(*) AS callers FROM k GROUP BY 1) SELECT coalesce(o.id, i.id) AS id, coalesce(callees, 0) AS callees, coalesce(callers, 0) AS callers FROM o FULL JOIN i ON o.id = i.id""")
def _(s, d):
    return N.degrees(edges(s, d))


@q("n11_strong_components", f"""WITH RECURSIVE {E_SQL}, k AS MATERIALIZED (SELECT DISTINCT src, dst FROM e WHERE type = 'CALLS' AND src IS NOT NULL AND dst IS NOT NULL),
  r AS (SELECT src AS a, dst AS b FROM k UNION SELECT r.a, k.dst FROM r JOIN k ON k.src = r.b)
  SELECT r.a AS id, min(r.b) AS component FROM r JOIN r s ON s.a = r.b AND s.b = r.a GROUP BY 1""")
def _(s, d):
    return N.strong_components(edges(s, d).where("type = 'CALLS'"))


@q("n13_overrides", f"""WITH RECURSIVE {NE}, l AS (SELECT src AS child, min(dst) AS parent FROM e WHERE type = 'EXTENDS' AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1),
  an AS (SELECT child AS cls, parent AS anc, 1 AS dist, [child, parent] AS path FROM l WHERE child <> parent UNION ALL SELECT an.cls, l.parent, dist + 1, list_append(path, l.parent) FROM an JOIN l ON l.child = an.anc WHERE NOT list_contains(path, l.parent)),
  bad AS (SELECT DISTINCT an.cls FROM an JOIN l ON l.child = an.anc WHERE list_contains(path, l.parent)),
  m AS (SELECT DISTINCT e.src AS cls, e.dst AS method, t.name FROM e JOIN n t ON t.id = e.dst WHERE e.type = 'HAS_METHOD' AND e.src IS NOT NULL AND t.kind = 'Method'),
  j AS (SELECT a.method, b.method AS overridden, dist, coalesce(i.kind IN ('Interface', 'Trait'), FALSE) AS iface FROM m a JOIN an USING (cls) JOIN m b ON b.cls = an.anc AND b.name = a.name LEFT JOIN n i ON i.id = an.anc WHERE a.cls NOT IN (SELECT cls FROM bad))
  SELECT method, overridden, 'METHOD_OVERRIDES' AS type, 0.9::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY dist, overridden) AS r FROM j WHERE NOT iface) WHERE r = 1
  UNION SELECT method, overridden, 'METHOD_IMPLEMENTS', 0.95 FROM j WHERE iface""")
def _(s, d):
    return N.overrides(nodes(s, d), edges(s, d))


_DEAD = f"""r AS (SELECT DISTINCT src, dst FROM e WHERE type IN ('CALLS', 'REFERENCES', 'ACCESSES', 'EXTENDS', 'IMPLEMENTS', 'METHOD_OVERRIDES', 'METHOD_IMPLEMENTS') AND src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
  u AS (SELECT r.dst AS id, coalesce(f.file_path, '') AS src_file FROM r LEFT JOIN n f ON f.id = r.src),
  x AS (SELECT n.id, coalesce(is_exported, FALSE) AS exported, bool_or(u.id IS NOT NULL) AS a, bool_or(u.id IS NOT NULL AND u.src_file <> coalesce(n.file_path, '')) AS c, any_value(repo_uri) AS repo_uri
    FROM n LEFT JOIN u ON u.id = n.id WHERE kind IN ('Function', 'Method', 'Constructor', 'Class', 'Interface', 'Struct', 'Trait', 'TypeAlias', 'Enum') GROUP BY 1, 2),
  dead AS (SELECT id, repo_uri, CASE WHEN exported AND NOT c THEN 'unreachable-export' WHEN NOT exported AND NOT a THEN 'dead' ELSE 'live' END AS deadness FROM x)"""


@q("n14_dead_code", f"WITH {NE}, {_DEAD} SELECT id, deadness FROM dead")
def _(s, d):
    return N.dead_code(nodes(s, d), edges(s, d))


@q("n15_ghost_files", f"""WITH {NE}, {_DEAD} SELECT file_path, count(*) AS n FROM dead JOIN n USING (id) WHERE file_path IS NOT NULL GROUP BY 1 HAVING NOT bool_or(deadness = 'live')""")
def _(s, d):
    n = nodes(s, d)
    return N.ghosts(n.where("file_path is not null").select("id", "file_path"), N.dead_code(n, edges(s, d)), "file_path")


@q("n16_demote", f"""WITH {E_SQL}, k AS (SELECT DISTINCT src, type, dst FROM e WHERE confidence = 1.0 AND reason LIKE 'scip:%')
  SELECT e.id, CASE WHEN k.src IS NOT NULL AND confidence = 0.5 AND e.type IN ('CALLS', 'REFERENCES', 'EXTENDS') THEN 0.2 ELSE confidence END AS confidence,
  CASE WHEN k.src IS NOT NULL AND confidence = 0.5 AND e.type IN ('CALLS', 'REFERENCES', 'EXTENDS') THEN coalesce(reason, '') || '+scip-unconfirmed' ELSE reason END AS reason
  FROM e LEFT JOIN k ON k.src = e.src AND k.type = e.type AND k.dst = e.dst""")
def _(s, d):
    return N.demote(edges(s, d))


@q("d01_baseline", f"""WITH b AS (SELECT file_path, name, min((kind, coalesce(signature, ''))) AS o FROM nodes WHERE indexed_at < TIMESTAMP '2025-05-01' AND file_path IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT file_path, name, min((kind, coalesce(signature, ''))) AS o FROM nodes WHERE removed_at IS NULL AND file_path IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2)
  SELECT coalesce(b.file_path, c.file_path) AS file_path, coalesce(b.name, c.name) AS name, CASE WHEN b.name IS NULL THEN 'new' WHEN c.name IS NULL THEN 'fixed' WHEN b.o = c.o THEN 'unchanged' ELSE 'updated' END AS state
  FROM b FULL JOIN c ON b.file_path = c.file_path AND b.name = c.name""")
def _(s, d):
    n = table(s, d, "nodes").where("file_path is not null and name is not null").select("file_path", "name", "kind", F.coalesce("signature", F.lit("")).alias("signature"), "indexed_at", "removed_at")
    return D.baseline(n.where(F.col("indexed_at") < F.lit("2025-05-01").cast("timestamp_ntz")), n.where("removed_at is null"), ["file_path", "name"], ["kind", "signature"])


@q("d04_suppressions", f"""WITH {N_SQL} SELECT id, coalesce((kind = 'Function' AND regexp_matches(file_path, '^(?:.*/)?tests/.*$')) OR regexp_matches(file_path, '^.*\\.md$'), FALSE) AS suppressed FROM n""")
def _(s, d):
    f = nodes(s, d).select("id", F.col("kind").alias("rule_id"), F.col("file_path").alias("path"))
    return D.suppress(f, [("Function", "**/tests/**"), ("*", "**.md")]).select("id", "suppressed")


@q("d05_fingerprints", f"""WITH {N_SQL} SELECT id, substring(sha256('graph' || chr(0) || kind || chr(0) || coalesce(file_path, '') || chr(0) || sha256(trim(regexp_replace(coalesce(signature, ''), '\\s+', ' ', 'g')))), 1, 32) AS fingerprint FROM n""")
def _(s, d):
    return nodes(s, d).select("id", D.fingerprint(F.lit("graph"), F.col("kind"), F.coalesce("file_path", F.lit("")), F.coalesce("signature", F.lit(""))).alias("fingerprint"))


@q("d07_cross_links", f"""WITH {NE}, p AS (SELECT DISTINCT b.repo_uri AS producer_repo, a.repo_uri AS consumer_repo FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.type = 'IMPORTS' AND a.repo_uri <> b.repo_uri)
  SELECT producer_repo AS source_repo_uri, consumer_repo AS target_repo_uri, 'consumer_of' AS relation FROM p UNION SELECT consumer_repo, producer_repo, 'depends_on' FROM p""")
def _(s, d):
    x = J.cross_repo(edges(s, d), nodes(s, d), "IMPORTS")
    return D.cross_links(x.select(F.col("dst_repo").alias("producer_repo"), F.col("src_repo").alias("consumer_repo")))


@q("d11_policy", f"SELECT id, {_TIER} AS tier, CASE WHEN upper(trim(license)) IN ('GPL-3.0', 'AGPL-3.0') THEN 'block' WHEN {_TIER} = 'unknown' THEN 'warn' ELSE 'pass' END AS decision FROM external_symbols")
def _(s, d):
    return D.policy(table(s, d, "external_symbols"), ["GPL-3.0", "AGPL-3.0"])


@q("d13_xrefs", f"WITH {E_SQL} SELECT 'call' AS what, src, dst FROM e WHERE type = 'CALLS' UNION ALL SELECT 'import', src, dst FROM e WHERE type = 'IMPORTS'")
def _(s, d):
    e = edges(s, d)
    pick = lambda t, w: e.where(F.col("type") == t).select(F.lit(w).alias("what"), "src", "dst")
    return D.merge_logs(pick("CALLS", "call"), pick("IMPORTS", "import"))


@q("d14_file_tree", f"""WITH {N_SQL} SELECT file_path, list_reverse(string_split(file_path, '/'))[1] AS name, len(string_split(file_path, '/')) AS depth, language FROM n WHERE kind = 'File'""")
def _(s, d):
    parts = F.split("file_path", "/")
    return nodes(s, d).where("kind = 'File'").select("file_path", F.element_at(parts, -1).alias("name"), F.size(parts).alias("depth"), "language")


@q("c02_symbol_index", f"WITH {N_SQL} SELECT file_path, name, max({{'l': coalesce(start_line, 0), 'i': id}}).i AS last_id, count(*) AS n FROM n WHERE kind IN ('Function', 'Method', 'Class', 'Struct') AND file_path IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    n = nodes(s, d).where("kind in ('Function', 'Method', 'Class', 'Struct') and file_path is not null")
    # of several definitions of a name the last in the file answers
    last = F.max(F.struct(F.coalesce("start_line", F.lit(0)).alias("l"), "id"))["id"]
    return n.groupBy("file_path", "name").agg(last.alias("last_id"), F.count(F.lit(1)).alias("n"))


@q("x09_short_hash", f"WITH {N_SQL} SELECT id, substring(sha256(id), 1, 6) AS h FROM n")
def _(s, d):
    return nodes(s, d).select("id", X.short_hash(F.col("id")).alias("h"))


@q("x01_name_words", f"WITH {N_SQL} SELECT id, {_WORDS} AS words FROM n WHERE name IS NOT NULL")
def _(s, d):
    return nodes(s, d).where("name is not null").select("id", X.name_words(F.col("name")).alias("words"))


@q("h01_guarded_sql", "SELECT type, count(*) AS n, max(confidence) AS best FROM edges GROUP BY type HAVING count(*) > 10")
def _(s, d):
    from graphloom.functions import sql_guard

    table(s, d, "edges").createOrReplaceTempView("edges")
    return sql_guard.run(s, "SELECT type, count(*) AS n, max(confidence) AS best FROM edges GROUP BY type HAVING count(*) > 10")
