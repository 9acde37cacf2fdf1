"""Further queries: contexts, nesting, carry-over, decisions, normalisation and the store; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import delta as D
from graphloom.operators import joins as J
from graphloom.operators import relations as L
from graphloom.operators import temporal as T
from graphloom.operators import traversal as TR
from graphloom.plans.graph_queries import E_SQL, N_SQL, NE, S0_SQL, STARTS, edges, nodes
from graphloom.runtime import table
from graphloom.sources import readers, store

QUERIES: dict = {}
SQL: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_TEST = """coalesce(len(list_intersect(string_split(lower(file_path), '/'), ['test', 'tests', 'spec', 'specs', '__tests__'])) > 0
  OR contains(lower(file_path), '.test.') OR contains(lower(file_path), '.spec.'), FALSE)"""


@q("f13_content_hashes", f"WITH {N_SQL} SELECT id, sha256(coalesce(signature, '') || chr(10) || coalesce(description, '')) AS hash FROM n WHERE kind IN ('Function', 'Method', 'Class', 'Struct')")
def _(s, d):
    body = F.concat(F.coalesce("signature", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    return nodes(s, d).where("kind in ('Function', 'Method', 'Class', 'Struct')").select("id", F.sha2(body, 256).alias("hash"))


@q("f17_context_targets", f"""WITH {N_SQL}, x AS (SELECT min(name) AS m FROM n WHERE kind = 'Method') SELECT id, file_path FROM n, x WHERE name = m AND contains(file_path, '/')
  ORDER BY file_path, id LIMIT 25""")
def _(s, d):
    n = nodes(s, d)
    m = n.where("kind = 'Method'").agg(F.min("name").alias("m"))
    return n.join(F.broadcast(m), F.col("name") == F.col("m")).where(F.col("file_path").contains("/")).orderBy("file_path", "id").limit(25).select("id", "file_path")


@q("f20_owners", """WITH p AS (SELECT l_partkey AS file, l_suppkey AS owner, sum(l_quantity) AS lines FROM lineitem GROUP BY 1, 2)
  SELECT file, s_name AS owner_name, lines, pos FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lines DESC, owner) AS pos FROM p) JOIN supplier ON s_suppkey = owner WHERE pos <= 5""")
def _(s, d):
    p = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("owner")).agg(F.sum("l_quantity").alias("lines"))
    top = L.top_per(p, "file", "owner", [F.desc("lines"), F.col("owner")], 5)
    return top.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("owner"), F.col("s_name").alias("owner_name")), "owner").select("file", "owner_name", "lines", "pos")


@q("a07_daily_histogram", """SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS views,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS total FROM events GROUP BY 1""")
def _(s, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    return table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(n("error").alias("errors"), n("view").alias("views"), n("purchase").alias("purchases"), F.count(F.lit(1)).alias("total"))


@q("a09_affected_modules", f"""WITH {NE}, st AS (SELECT DISTINCT dst AS a, src AS b FROM e WHERE type IN ('CALLS', 'EXTENDS') AND src <> dst), {S0_SQL},
  one AS (SELECT DISTINCT s0.start, b FROM s0 JOIN st ON a = s0.start), two AS (SELECT DISTINCT start, st.b FROM one JOIN st ON a = one.b WHERE st.b <> start),
  h AS (SELECT start, b, min(depth) AS depth FROM (SELECT start, b, 1 AS depth FROM one UNION ALL SELECT start, b, 2 FROM two) GROUP BY 1, 2)
  SELECT h.start, n.repo_uri AS module, count(*) AS hits, bool_or(depth = 1) AS direct FROM h JOIN n ON n.id = h.b WHERE n.repo_uri IS NOT NULL GROUP BY 1, 2""")
def _(s, d):
    n = nodes(s, d)
    hit = TR.traverse(edges(s, d), TR.query_set(n, STARTS), ["CALLS", "EXTENDS"], "up", 2)
    j = hit.join(n.select(F.col("id").alias("node_id"), F.col("repo_uri").alias("module")), "node_id").where("module is not null")
    return j.groupBy("start", "module").agg(F.count(F.lit(1)).alias("hits"), F.bool_or(F.col("depth") == 1).alias("direct"))


@q("j13_callers_and_callees", f"""WITH {E_SQL}, k AS (SELECT DISTINCT src, dst FROM e WHERE type = 'EXTENDS' AND src IS NOT NULL AND dst IS NOT NULL),
  a AS (SELECT src AS id, list_sort(list(dst)) AS bases FROM k GROUP BY 1), b AS (SELECT dst AS id, list_sort(list(src)) AS subs FROM k GROUP BY 1)
  SELECT coalesce(a.id, b.id) AS id, bases, subs FROM a FULL JOIN b ON a.id = b.id""")
def _(s, d):
    k = edges(s, d).where("type = 'EXTENDS' and src is not null and dst is not null").select("src", "dst").distinct()
    a = k.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("bases"))
    return a.join(k.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("subs")), "id", "full")


@q("j15_line_shares", f"""WITH {N_SQL}, b AS (SELECT file_path, start_line AS line, coalesce(owner, name) AS author FROM n WHERE kind = 'Property' AND start_line IS NOT NULL)
  SELECT n.id AS symbol_id, author, count(DISTINCT line) / (any_value(end_line) - any_value(start_line) + 1) AS share FROM b JOIN n USING (file_path)
  WHERE n.kind IN ('Class', 'Struct') AND line BETWEEN start_line AND end_line GROUP BY 1, 2""")
def _(s, d):
    n = nodes(s, d)
    b = n.where("kind = 'Property' and start_line is not null").select("file_path", F.col("start_line").alias("line"), F.coalesce("owner", "name").alias("author"))
    return L.line_shares(b, n.where("kind in ('Class', 'Struct')"))


@q("j16_enriched", f"""WITH {NE}, c AS (SELECT dst AS id, count(DISTINCT src) AS k FROM e WHERE type = 'CALLS' AND dst IS NOT NULL GROUP BY 1), g AS (SELECT repo_uri, min(repo_group) AS repo_group FROM repos GROUP BY 1),
  f AS (SELECT file_path, min(language) AS language FROM n WHERE kind = 'File' AND file_path IS NOT NULL GROUP BY 1)
  SELECT n.id, f.language, g.repo_group, coalesce(c.k, 0) AS n_callers, {_TEST.replace('file_path', 'n.file_path')} AS is_test FROM n LEFT JOIN f ON f.file_path = n.file_path LEFT JOIN g ON g.repo_uri = n.repo_uri LEFT JOIN c ON c.id = n.id
  WHERE n.kind IN ('Function', 'Method')""")
def _(s, d):
    return L.enriched(nodes(s, d), edges(s, d), table(s, d, "repos"))


_CHANGED = "SELECT DISTINCT src AS file FROM e WHERE type = 'IMPORTS' AND src LIKE '%/tests/%'"


@q("g08_closure", f"""WITH {E_SQL}, ch AS ({_CHANGED}), st AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e WHERE type = 'IMPORTS' AND src <> dst UNION SELECT dst, src FROM e WHERE type = 'IMPORTS' AND src <> dst)),
  one AS (SELECT DISTINCT b AS file FROM ch JOIN st ON a = file), two AS (SELECT DISTINCT b AS file FROM one JOIN st ON a = file)
  SELECT file, min(depth) AS depth FROM (SELECT file, 0 AS depth FROM ch UNION ALL SELECT file, 1 FROM one UNION ALL SELECT file, 2 FROM two) GROUP BY 1""")
def _(s, d):
    # the closure asks for the distinct ends alone, which repeated deliveries of an edge share: nothing to merge
    imports = table(s, d, "edges").where("id is not null and type = 'IMPORTS'").select("src", "dst")
    return TR.closure(imports, imports.where("src like '%/tests/%'").select(F.col("src").alias("file")).distinct(), 2)


@q("c09_carried", f"""WITH {NE}, ch AS (SELECT DISTINCT file_path AS file FROM n WHERE file_path LIKE '%/tests/%'), k AS (SELECT id FROM n WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT file FROM ch))
  SELECT e.id FROM e WHERE type IN ('CALLS', 'REFERENCES') AND confidence > 0.5 AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def _(s, d):
    n = nodes(s, d)
    return L.carried(edges(s, d), n, n.where("file_path like '%/tests/%'").select(F.col("file_path").alias("file")).distinct(), ["CALLS", "REFERENCES"], 0.5).select("id")


@q("c01_nesting", f"""WITH {N_SQL}, t AS (SELECT * FROM (SELECT id AS owner_id, file_path, name AS owner, count(*) OVER (PARTITION BY file_path, name) AS k FROM n WHERE kind IN ('Class', 'Struct') AND file_path IS NOT NULL) WHERE k = 1),
  f AS (SELECT file_path, min(id) AS file_id FROM n WHERE kind = 'File' GROUP BY 1)
  SELECT n.id, coalesce(owner_id, file_id) AS parent, CASE WHEN owner_id IS NOT NULL AND kind IN ('Function', 'Method') THEN 'HAS_METHOD' WHEN owner_id IS NOT NULL THEN 'HAS_PROPERTY' ELSE 'DEFINES' END AS relation,
  CASE WHEN n.owner IS NOT NULL AND owner_id IS NULL THEN 0.9::DOUBLE ELSE 1.0 END AS confidence
  FROM n LEFT JOIN t ON t.file_path = n.file_path AND t.owner = n.owner LEFT JOIN f ON f.file_path = n.file_path WHERE kind IN ('Function', 'Method', 'Class', 'Struct', 'Property') AND n.file_path IS NOT NULL""")
def _(s, d):
    return L.nesting(nodes(s, d))


@q("c03_import_stubs", f"WITH {E_SQL} SELECT DISTINCT 'CodeElement' AS kind, dst AS id FROM e WHERE type = 'IMPORTS' AND dst LIKE 'CodeElement:<external>:%'")
def _(s, d):
    return edges(s, d).where("type = 'IMPORTS' and dst like 'CodeElement:<external>:%'").select(F.lit("CodeElement").alias("kind"), F.col("dst").alias("id")).distinct()


@q("n20_property_targets", f"""WITH {NE}, r AS (SELECT e.id AS ref_id, t.name, f.file_path FROM e JOIN n f ON f.id = e.src JOIN n t ON t.id = e.dst WHERE e.type = 'ACCESSES'),
  p AS (SELECT * FROM n WHERE kind = 'Property'), a AS (SELECT name, file_path, min(id) AS x FROM p GROUP BY 1, 2), c AS (SELECT name, min(id) AS z FROM p GROUP BY 1)
  SELECT ref_id, coalesce(x, z) AS target FROM r LEFT JOIN a USING (name, file_path) LEFT JOIN c USING (name)""")
def _(s, d):
    n, e = nodes(s, d), edges(s, d)
    slim = n.select("id", "name", "file_path", F.lit(None).cast("string").alias("repo_uri"))
    r = e.where("type = 'ACCESSES'").select(F.col("id").alias("ref_id"), "src", "dst").join(slim.select(F.col("id").alias("src"), "file_path", "repo_uri"), "src").join(slim.select(F.col("id").alias("dst"), "name"), "dst")
    return J.tiered(r.select("ref_id", "name", "file_path", "repo_uri"), slim.join(n.where("kind = 'Property'").select("id"), "id", "left_semi")).select("ref_id", "target")


@q("d08_shapes", f"""WITH {NE}, u AS (SELECT e.src, list_sort(list(DISTINCT t.name)) AS accessed FROM e JOIN n t ON t.id = e.dst WHERE e.type = 'ACCESSES' GROUP BY 1),
  k AS (SELECT file_path, list(DISTINCT name) AS known FROM n WHERE kind = 'Property' AND file_path IS NOT NULL GROUP BY 1)
  SELECT src, CASE WHEN len(accessed) = 0 THEN 'PARTIAL' WHEN len(m) = 0 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict, m AS missing FROM (
    SELECT u.src, accessed, list_sort(list_filter(accessed, lambda x: NOT list_contains(coalesce(known, []), x))) AS m FROM u JOIN n f ON f.id = u.src LEFT JOIN k ON k.file_path = f.file_path)""")
def _(s, d):
    return L.shapes(edges(s, d), nodes(s, d))


@q("d09_decisions", f"""WITH a AS (SELECT repo_uri, count(*) AS v FROM edges WHERE indexed_at < TIMESTAMP '2025-04-01' AND repo_uri IS NOT NULL GROUP BY 1), b AS (SELECT repo_uri, count(*) AS v FROM edges WHERE repo_uri IS NOT NULL GROUP BY 1)
  SELECT coalesce(a.repo_uri, b.repo_uri) AS repo_uri, a.v IS NOT NULL AS in_a, b.v IS NOT NULL AS in_b, b.v - a.v AS delta FROM a FULL JOIN b ON a.repo_uri = b.repo_uri WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v""")
def _(s, d):
    e = table(s, d, "edges").where("repo_uri is not null")
    n = lambda x: x.groupBy("repo_uri").agg(F.count(F.lit(1)).alias("v"))
    return D.decision_diff(n(e.where(F.col("indexed_at") < F.lit("2025-04-01").cast("timestamp_ntz"))), n(e), "repo_uri", "v")


@q("r10_context", f"""WITH {E_SQL}, x AS (SELECT DISTINCT * FROM (SELECT src AS id, 'out' AS direction, type, dst AS other FROM e WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT dst, 'in', type, src FROM e WHERE src IS NOT NULL AND dst IS NOT NULL))
  SELECT id, direction, type, count(*) AS n, list_slice(list_sort(list(other)), 1, 5) AS examples FROM x GROUP BY 1, 2, 3""")
def _(s, d):
    return L.context(edges(s, d))


@q("s14_upsert", """WITH o AS (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL AND indexed_at < TIMESTAMP '2025-04-01'), w AS (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL AND indexed_at >= TIMESTAMP '2025-04-01')
  SELECT id, 'old' AS side FROM o WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, 'new' FROM w""")
def _(s, d):
    n = table(s, d, "nodes").where("id is not null")
    cut = F.lit("2025-04-01").cast("timestamp_ntz")
    side = lambda c, w: n.where(c).select("id").distinct().withColumn("side", F.lit(w))
    return store.upsert(side(F.col("indexed_at") < cut, "old"), side(F.col("indexed_at") >= cut, "new"), ["id"])


@q("s17_meta", f"WITH {NE} SELECT '1.2.0' AS schema_version, (SELECT count(*) FROM n) AS node_count, (SELECT count(*) FROM e) AS edge_count")
def _(s, d):
    return store.meta(nodes(s, d), edges(s, d))


@q("s02_folders", f"""WITH {N_SQL} SELECT DISTINCT CASE WHEN i = 1 THEN '.' ELSE array_to_string(list_slice(p, 1, i - 1), '/') END AS parent, array_to_string(list_slice(p, 1, i), '/') AS child
  FROM (SELECT string_split(file_path, '/') AS p FROM n WHERE kind = 'File' AND file_path IS NOT NULL), unnest(range(1, len(p) + 1)) AS t(i)""")
def _(s, d):
    return readers.folders(nodes(s, d).where("kind = 'File'").select(F.col("file_path").alias("path")))


@q("s12_sections")
def _(s, d):
    return readers.sections(table(s, d, "nodes").where("kind = 'File'").select("id", "file_path", "content").dropDuplicates(["id"]))


@q("t02_commit_classes", "SELECT doc_id, lower(regexp_extract(text, '^\\s*(?:[#>*-]+\\s*)?(feat|fix|docs|chore|refactor|perf|test|build|ci|style|revert)(?:\\([^)]*\\))?!?:', 1, 'i')) AS class FROM documents WHERE text IS NOT NULL")
def _(s, d):
    rx = r"(?i)^\s*(?:[#>*-]+\s*)?(feat|fix|docs|chore|refactor|perf|test|build|ci|style|revert)(?:\([^)]*\))?!?:"
    return table(s, d, "documents").where("text is not null").select("doc_id", F.lower(F.regexp_extract("text", rx, 1)).alias("class"))


@q("t05_reverts", "SELECT doc_id, regexp_matches(text, '(?i)(^revert\\b|this reverts commit [0-9a-f]{7,}|^rollback\\b)') AS reverts, len(regexp_extract_all(lower(text), '\\b(?:hotfix|urgent|broke|crash|security|regression)\\b')) AS risk_words FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select(
        "doc_id", F.col("text").rlike(r"(?i)(^revert\b|this reverts commit [0-9a-f]{7,}|^rollback\b)").alias("reverts"),
        F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:hotfix|urgent|broke|crash|security|regression)\b"), 0)).alias("risk_words"))


@q("t14_truck_factor", """WITH p AS (SELECT p_brand AS file, l_suppkey AS author, sum(l_quantity)::BIGINT AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) AS i FROM p WHERE k > 0),
  g AS (SELECT file, count(*) AS n, greatest(least(2.0::DOUBLE * sum(i * k) / (count(*) * sum(k)) - (count(*) + 1.0::DOUBLE) / count(*), 1.0), 0.0) AS gini FROM r GROUP BY 1)
  SELECT file, n, gini::DOUBLE AS gini, least(greatest(1.0 + floor((1.0 - gini) * (n - 1) + 0.5), 1.0), n)::BIGINT AS bus_factor FROM g""")
def _(s, d):
    lines = table(s, d, "lineitem").join(table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    p = lines.groupBy(F.col("p_brand").alias("file"), F.col("l_suppkey").alias("author")).agg(F.sum("l_quantity").cast("long").alias("k"))
    return T.gini(p, "file", "k")


_PATHS = r"""p AS (SELECT id, CASE WHEN id LIKE '%2%' THEN '/' ELSE coalesce(name, 'x') || '/:id' || CASE WHEN id LIKE '%1%' THEN '?a=1' ELSE '//' END END AS p FROM repos),
  q AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(p, '[?#].*$', ''), ':([A-Za-z_]\w*)', '{\1}', 'g'), '/+$', '') AS s FROM p)"""


def _raw_paths(s, d):
    tail = F.when(F.col("id").contains("1"), F.lit("?a=1")).otherwise(F.lit("//"))
    p = F.when(F.col("id").contains("2"), F.lit("/")).otherwise(F.concat(F.coalesce("name", F.lit("x")), F.lit("/:id"), tail))
    return table(s, d, "repos").select("id", p.alias("p"))


@q("x02_bare_paths", f"WITH {_PATHS} SELECT id, s AS path FROM q")
def _(s, d):
    return _raw_paths(s, d).select("id", X.norm_path(F.col("p"), root="", lead=False).alias("path"))


@q("x02_rooted_paths", f"WITH {_PATHS} SELECT id, CASE WHEN s = '' THEN '/' WHEN s LIKE '/%' THEN s ELSE '/' || s END AS path FROM q")
def _(s, d):
    return _raw_paths(s, d).select("id", X.norm_path(F.col("p")).alias("path"))


@q("x02_normal_paths", r"""WITH p AS (SELECT id, '/' || coalesce(name, '') || '/:id' || CASE WHEN id LIKE '%1%' THEN '?a=1' ELSE '/' END AS p FROM repos)
  SELECT id, regexp_replace(regexp_replace(regexp_replace(p, '[?#].*$', ''), ':([A-Za-z_]\w*)', '{\1}', 'g'), '/+$', '') AS path FROM p""")
def _(s, d):
    p = F.concat(F.lit("/"), F.coalesce("name", F.lit("")), F.lit("/:id"), F.when(F.col("id").contains("1"), F.lit("?a=1")).otherwise(F.lit("/")))
    return table(s, d, "repos").select("id", X.norm_path(p).alias("path"))


@q("x03_topics", "SELECT id, list_reverse(string_split(regexp_replace(origin_url, '/+$', ''), '/'))[1] AS topic FROM repos WHERE origin_url IS NOT NULL")
def _(s, d):
    return table(s, d, "repos").where("origin_url is not null").select("id", X.norm_topic(F.col("origin_url")).alias("topic"))
