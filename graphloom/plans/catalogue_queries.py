"""Queries of findings, dependencies, routes, contracts, indexer edges, measures and retrieval tiers, with their SQL.

Findings, routes and coverage are derived from the nodes, alike in both forms, as the tables hold none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import catalogue as C
from graphloom.operators import contracts as K
from graphloom.operators import delta as D
from graphloom.operators import indexer as I
from graphloom.operators import metrics as M
from graphloom.operators import retrieval as R
from graphloom.operators import traversal as T
from graphloom.operators.graph_tables import merge_nodes
from graphloom.plans.graph_queries import _TIER, N_SQL, NE, S0_SQL, STARTS, edges, nodes
from graphloom.plans.history_queries import _TOK
from graphloom.runtime import Staging, table

QUERIES: dict = {}
SQL: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_F_SQL = f"""{N_SQL}, f AS (SELECT 'Finding:' || id AS id, CASE WHEN cyclomatic_complexity > 20 THEN 'error' WHEN cyclomatic_complexity > 10 THEN 'warning' ELSE 'note' END AS severity,
  'complex-' || coalesce(language, 'text') AS rule_id, CASE WHEN description IS NULL THEN 'new' ELSE 'unchanged' END AS baseline_state,
  CASE WHEN is_exported THEN NULL ELSE '[{{"kind":"inSource"}}]' END AS suppressed_json, kind AS scanner, file_path, start_line FROM n WHERE kind IN ('Function', 'Method') AND cyclomatic_complexity > 3)"""


def findings(s: SparkSession, d: str) -> DataFrame:
    c = F.col("cyclomatic_complexity")
    return nodes(s, d).where(F.col("kind").isin("Function", "Method") & (c > 3)).select(
        F.concat(F.lit("Finding:"), "id").alias("id"), F.when(c > 20, "error").when(c > 10, "warning").otherwise("note").alias("severity"),
        F.concat(F.lit("complex-"), F.coalesce("language", F.lit("text"))).alias("rule_id"), F.when(F.col("description").isNull(), "new").otherwise("unchanged").alias("baseline_state"),
        F.when(F.coalesce("is_exported", F.lit(False)), None).otherwise('[{"kind":"inSource"}]').alias("suppressed_json"), F.col("kind").alias("scanner"), "file_path", "start_line",
    )


@q("f04_list_findings", f"WITH {_F_SQL} SELECT id, severity, rule_id FROM f WHERE severity IN ('error', 'warning', 'note') AND rule_id = 'complex-python' AND baseline_state IN ('new', 'updated') AND suppressed_json IS NOT NULL")
def _(s, d):
    return C.list_findings(findings(s, d), ["error", "warning", "note"], "complex-python", ["new", "updated"], True).select("id", "severity", "rule_id")


@q("f04_unsuppressed", f"WITH {_F_SQL} SELECT id, severity FROM f WHERE suppressed_json IS NULL")
def _(s, d):
    return C.list_findings(findings(s, d), suppressed=False).select("id", "severity")


@q("f18_search_findings", f"WITH {_F_SQL} SELECT id, file_path FROM f WHERE severity IN ('note', 'warning') AND scanner = 'Method' AND contains(file_path, 'src/') ORDER BY id LIMIT 500")
def _(s, d):
    return C.search_findings(findings(s, d), ["note", "warning"], None, "Method", "src/").select("id", "file_path")


@q("d02_tagged", f"""WITH {_F_SQL}, k AS (SELECT DISTINCT rule_id, file_path FROM f WHERE baseline_state = 'unchanged' AND file_path IS NOT NULL)
  SELECT f.id, CASE WHEN k.rule_id IS NULL THEN 'new' ELSE 'unchanged' END AS baseline_state FROM f LEFT JOIN k ON k.rule_id = f.rule_id AND k.file_path = f.file_path""")
def _(s, d):
    f = findings(s, d)
    keys = f.where("baseline_state = 'unchanged' and file_path is not null").select("rule_id", "file_path").distinct().withColumn("state", F.lit("unchanged"))
    return C.tagged(f.drop("baseline_state"), keys, ["rule_id", "file_path"]).select("id", "baseline_state")


@q("f05_dependencies", f"SELECT id, {_TIER} AS tier FROM (SELECT * FROM external_symbols WHERE ecosystem = 'npm' ORDER BY id LIMIT 50) WHERE {_TIER} IN ('permissive', 'unknown')")
def _(s, d):
    return C.list_dependencies(table(s, d, "external_symbols"), "npm", ["permissive", "unknown"], 50).select("id", "tier")


_R_SQL = f"""{N_SQL}, r AS (SELECT id, repo_uri, file_path, CASE WHEN regexp_matches(name, '^(get|list|read|load|scan)') THEN 'GET' WHEN regexp_matches(name, '^(create|insert|send|publish|emit)') THEN 'POST'
  WHEN regexp_matches(name, '^(update|patch|rotate|refresh)') THEN 'PUT' WHEN regexp_matches(name, '^(delete|remove|evict|prune)') THEN 'DELETE' END AS method, '/' || lower(regexp_replace(name, '([a-z])([A-Z_])', '\\1/\\2', 'g')) || '/:id/' AS url
  FROM n WHERE kind IN ('Function', 'Method') AND is_exported AND name IS NOT NULL AND file_path IS NOT NULL)"""


def routes(s: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    method = F.when(name.rlike("^(get|list|read|load|scan)"), "GET").when(name.rlike("^(create|insert|send|publish|emit)"), "POST").when(name.rlike("^(update|patch|rotate|refresh)"), "PUT").when(name.rlike("^(delete|remove|evict|prune)"), "DELETE")
    url = F.concat(F.lit("/"), F.lower(F.regexp_replace(name, "([a-z])([A-Z_])", "$1/$2")), F.lit("/:id/"))
    return nodes(s, d).where("kind in ('Function', 'Method') and is_exported and name is not null and file_path is not null").select("id", "repo_uri", "file_path", method.alias("method"), url.alias("url"))


@q("f06_routes", f"WITH {_R_SQL} SELECT id, method, url FROM r WHERE method IN ('GET', 'DELETE') AND contains(lower(url), 'e')")
def _(s, d):
    return C.list_routes(routes(s, d), ["GET", "DELETE"], "E").select("id", "method", "url")


_NORM = "regexp_replace(regexp_replace(url, ':([A-Za-z_]\\w*)', '{{\\1}}', 'g'), '/+$', '')".replace("{{", "{").replace("}}", "}")


@q("c07_route_handlers", f"""WITH {_R_SQL}, h AS (SELECT DISTINCT 'Route:' || file_path || ':' || coalesce(method, 'ANY') || ' ' || {_NORM} AS id, file_path, coalesce(method, 'ANY') AS m, {_NORM} AS u FROM r),
  a AS (SELECT m, u, count(DISTINCT file_path) AS n_alike FROM h GROUP BY 1, 2) SELECT h.id, h.file_path, 'HANDLES_ROUTE' AS type, 0.9::DOUBLE AS confidence, n_alike FROM h JOIN a USING (m, u)""")
def _(s, d):
    return K.first_handlers(routes(s, d))


_CALLS_SQL = f"c AS (SELECT id, repo_uri, coalesce(method, 'GET') AS method, {_NORM} AS u FROM r WHERE length(id) % 2 = 0), t AS (SELECT id, repo_uri, method, {_NORM} AS u FROM r WHERE length(id) % 2 = 1 AND method IS NOT NULL)"


def _fetches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Routes with ids of even length stand for calls, the others for what is called."""
    r = routes(s, d)
    even = F.length("id") % 2 == 0
    return r.where(even).withColumn("method", F.coalesce("method", F.lit("GET"))), r.where(~even & F.col("method").isNotNull())


@q("j10_calls_on_routes", f"""WITH {_R_SQL}, {_CALLS_SQL}, f AS (SELECT method, u, min(id) AS route FROM t GROUP BY 1, 2)
  SELECT c.id AS call_id, coalesce(route, '<unresolved>:' || c.method || ' ' || c.u) AS target, CASE WHEN route IS NULL THEN 0.5::DOUBLE ELSE 0.8 END AS confidence FROM c LEFT JOIN f ON f.method = c.method AND f.u = c.u""")
def _(s, d):
    return K.matched_calls(*_fetches(s, d))


@q("j12_cross_repo_routes", f"""WITH {_R_SQL}, {_CALLS_SQL} SELECT c.id AS consumer, t.id AS route, c.repo_uri AS consumer_repo, t.repo_uri AS route_repo FROM c JOIN t ON t.method = c.method AND t.u = c.u WHERE c.repo_uri <> t.repo_uri""")
def _(s, d):
    return K.fetched_routes(*_fetches(s, d))


_K_SQL = f"""{N_SQL}, p AS (SELECT repo_uri AS p_repo_uri, file_path AS p_file_path, start_line AS p_line, lower(repo_uri) || '.v1.' || owner || '/' || name AS sig, owner, name FROM n WHERE kind = 'Method' AND is_exported AND owner IS NOT NULL AND file_path IS NOT NULL AND repo_uri IS NOT NULL AND start_line IS NOT NULL),
  c AS (SELECT repo_uri AS c_repo_uri, file_path AS c_file_path, start_line AS c_line, name AS sig FROM n WHERE kind IN ('Class', 'Struct') AND file_path IS NOT NULL AND repo_uri IS NOT NULL AND start_line IS NOT NULL)"""


@q("j11_contract_links", f"""WITH {_K_SQL} SELECT DISTINCT p_repo_uri, p_file_path, p_line, c_repo_uri, c_file_path, c_line, 'grpc' AS family, p.sig AS p_signature, c.sig AS c_signature, 'signature' AS reason
  FROM p JOIN c ON c.sig = p.owner OR c.sig = p.name WHERE p_repo_uri <> c_repo_uri AND c.sig <> ''""")
def _(s, d):
    n = nodes(s, d).where("file_path is not null and repo_uri is not null and start_line is not null")
    p = n.where("kind = 'Method' and is_exported and owner is not null").select(
        F.lit("grpc_service").alias("type"), F.concat(F.lower("repo_uri"), F.lit(".v1."), "owner", F.lit("/"), "name").alias("signature"), "repo_uri", "file_path", F.col("start_line").alias("line")
    )
    c = n.where("kind in ('Class', 'Struct')").select(F.lit("grpc_client").alias("type"), F.col("name").alias("signature"), "repo_uri", "file_path", F.col("start_line").alias("line"))
    return K.cross_links(p.unionByName(c))


@q("x04_contracts")
def _(s, d):
    n = table(s, d, "nodes").where("kind = 'File'").select("file_path", "repo_uri", "content")
    return K.extract(n)


@q("f07_repo_node", """SELECT id, name FROM (SELECT id, 'Repo' AS kind, name FROM repos UNION ALL SELECT DISTINCT id, kind, name FROM nodes WHERE kind = 'File' AND name IS NOT NULL)
  WHERE kind = 'Repo' AND id = (SELECT min(id) FROM repos)""")
def _(s, d):
    r = table(s, d, "repos").select("id", F.lit("Repo").alias("kind"), "name")
    every = r.unionByName(table(s, d, "nodes").where("kind = 'File' and name is not null").select("id", "kind", "name").distinct())
    return C.repo_node(every, r.agg(F.min("id")).first()[0]).select("id", "name")


@q("f21_tool_map", f"WITH {N_SQL} SELECT name, file_path FROM (SELECT * FROM n WHERE kind = 'Function' AND is_exported ORDER BY id LIMIT 500) WHERE contains(lower(name), 'r') ORDER BY name, file_path")
def _(s, d):
    return C.tool_map(nodes(s, d).where("kind = 'Function' and is_exported"), "R").select("name", "file_path")


@q("a06_file_histogram", f"""WITH {N_SQL}, g AS (SELECT repo_uri AS community, file_path, count(*) AS n FROM n WHERE kind <> 'File' AND repo_uri IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, file_path) AS pos FROM g) WHERE pos <= 10""")
def _(s, d):
    return C.file_histogram(nodes(s, d).where("kind <> 'File'").select(F.col("repo_uri").alias("community"), "file_path"))


@q("a06_top_contributors", """WITH g AS (SELECT p_brand AS community, l_suppkey AS contributor, round(sum(1 - l_discount), 6) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY weight DESC, contributor) AS pos FROM g) WHERE pos <= 5""")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("community"))
    owned = table(s, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("contributor"), (1 - F.col("l_discount")).alias("confidence")).join(p, "l_partkey")
    return C.top_contributors(owned)


@q("a10_untested_radius", f"""WITH {NE}, {S0_SQL}, v AS (SELECT id, file_path, CASE WHEN description IS NULL THEN NULL ELSE least(1.0, parameter_count * 0.3)::DOUBLE END AS ratio FROM n WHERE kind IN ('Function', 'Method')),
  vf AS (SELECT file_path, avg(ratio) AS ratio FROM v WHERE file_path IS NOT NULL GROUP BY 1 HAVING avg(ratio) IS NOT NULL),
  h AS (SELECT DISTINCT s0.start, e.src FROM e JOIN s0 ON s0.start = e.dst WHERE e.type = 'CALLS' AND e.src IS NOT NULL AND e.src <> e.dst),
  j AS (SELECT h.start, coalesce(v.ratio, vf.ratio) AS r FROM h JOIN n ON n.id = h.src LEFT JOIN v ON v.id = h.src AND v.ratio IS NOT NULL LEFT JOIN vf ON vf.file_path = n.file_path)
  SELECT start, count(*) AS direct, count(*) FILTER (WHERE r >= 0.5) AS tested, count(*) FILTER (WHERE r < 0.5) AS untested, count(*) FILTER (WHERE r IS NULL) AS unknown FROM j GROUP BY 1""")
def _(s, d):
    n = nodes(s, d)
    own = n.where("kind in ('Function', 'Method')").select("id", "file_path", F.when(F.col("description").isNull(), None).otherwise(F.least(F.lit(1.0), F.col("parameter_count") * 0.3)).alias("ratio"))
    of_file = own.where("file_path is not null").groupBy("file_path").agg(F.avg("ratio").alias("ratio")).select(F.lit(None).cast("string").alias("id"), "file_path", "ratio")
    cover = own.unionByName(of_file).where("ratio is not null")
    return C.untested_radius(edges(s, d), n, cover, T.query_set(n, STARTS), ["CALLS"])


@q("d12_sieve", f"""WITH {N_SQL}, f AS (SELECT id, CASE WHEN coalesce(cyclomatic_complexity, 0) > 3 THEN 1 ELSE 0 END AS a, CASE WHEN regexp_matches(lower(name), 'parse|format|encode|decode|render') THEN 1 ELSE 0 END AS b,
  CASE WHEN regexp_matches(lower(name), '^(get|set|load|map|merge)') THEN 1 ELSE 0 END AS c, kind = 'Method' AS o FROM n WHERE kind IN ('Function', 'Method') AND name IS NOT NULL)
  SELECT id, CASE WHEN a = 0 AND b > 0 THEN 'serialization-pure' WHEN a = 0 AND c > 0 AND NOT o THEN 'plumbing-no-domain' ELSE 'none' END AS tier, CASE WHEN a = 0 AND b > 0 THEN 0.95::DOUBLE WHEN a = 0 AND c > 0 AND NOT o THEN 0.9 ELSE 0 END AS confidence FROM f""")
def _(s, d):
    low = F.lower("name")
    flag = lambda c: F.when(c, 1).otherwise(0)
    tier, conf = C.sieve(flag(F.coalesce("cyclomatic_complexity", F.lit(0)) > 3), flag(low.rlike("parse|format|encode|decode|render")), flag(low.rlike("^(get|set|load|map|merge)")), F.col("kind") == "Method")
    return nodes(s, d).where("kind in ('Function', 'Method') and name is not null").select("id", tier.alias("tier"), conf.alias("confidence"))


@q("d15_scanners", """WITH c AS (SELECT * FROM (VALUES ('secrets', '*'), ('py-lint', 'python'), ('ts-lint', 'typescript'), ('go-vet', 'go'), ('cobol-lint', 'cobol')) t(scanner, needs)),
  p AS (SELECT DISTINCT repo_uri, language AS what FROM nodes WHERE kind = 'File' AND repo_uri IS NOT NULL AND language IS NOT NULL)
  SELECT DISTINCT scanner, repo_uri FROM p JOIN c ON c.needs = p.what OR c.needs = '*'""")
def _(s, d):
    c = s.createDataFrame([("secrets", "*"), ("py-lint", "python"), ("ts-lint", "typescript"), ("go-vet", "go"), ("cobol-lint", "cobol")], "scanner string, needs string")
    p = table(s, d, "nodes").where("kind = 'File' and repo_uri is not null and language is not null").select("repo_uri", F.col("language").alias("what")).distinct()
    return C.carrying_scanners(c, p)


@q("d10_tiers", """WITH m AS (SELECT user_id, count(*) AS radius, count(DISTINCT event_type) AS modules, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS warnings FROM events GROUP BY 1)
  SELECT user_id, CASE WHEN radius >= 50 THEN 'block' WHEN radius >= 20 OR errors > 0 THEN 'expert' WHEN modules >= 3 OR radius >= 5 THEN 'dual' WHEN warnings > 0 THEN 'single' ELSE 'auto' END AS tier FROM m""")
def _(s, d):
    n = lambda t: F.count_if(F.col("event_type") == t)
    m = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("radius"), F.count_distinct("event_type").alias("modules"), n("error").alias("errors"), n("click").alias("warnings"))
    return m.select("user_id", D.tier(F.col("radius"), F.col("modules"), F.lit(False), F.col("errors"), F.col("warnings")).alias("tier"))


_O_SQL = f"""{N_SQL}, df AS (SELECT id || CASE WHEN kind IN ('Function', 'Method') THEN '().' ELSE '#' END AS symbol, file_path, start_line, 0 AS start_char, end_line, 80 AS end_char FROM n WHERE kind IN ('Function', 'Method', 'Class', 'Struct') AND start_line IS NOT NULL AND end_line IS NOT NULL AND file_path IS NOT NULL),
  si AS (SELECT id AS site_id, file_path, start_line, length(name) AS start_char, start_line AS end_line, length(name) + 3 AS end_char FROM n WHERE kind IN ('Property', 'Method') AND start_line IS NOT NULL AND name IS NOT NULL AND file_path IS NOT NULL),
  en AS (SELECT si.site_id, df.symbol, row_number() OVER (PARTITION BY si.site_id ORDER BY df.end_line - df.start_line, df.end_char - df.start_char, df.symbol) AS r FROM si JOIN df ON df.file_path = si.file_path
    AND (df.start_line < si.start_line OR df.start_line = si.start_line AND df.start_char <= si.start_char) AND (df.end_line > si.end_line OR df.end_line = si.end_line AND df.end_char >= si.end_char))"""


def _occurrences(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Definitions and sites of the nodes' lines, as an indexer would tell them."""
    n = nodes(s, d).where("start_line is not null and file_path is not null")
    like = F.when(F.col("kind").isin("Function", "Method"), "().").otherwise("#")
    defs = n.where("kind in ('Function', 'Method', 'Class', 'Struct') and end_line is not null").select(
        F.concat("id", like).alias("symbol"), "file_path", "start_line", F.lit(0).alias("start_char"), "end_line", F.lit(80).alias("end_char")
    )
    sites = n.where("kind in ('Property', 'Method') and name is not null").select(
        F.col("id").alias("site_id"), "file_path", "start_line", F.length("name").alias("start_char"), F.col("start_line").alias("end_line"), (F.length("name") + 3).alias("end_char")
    )
    return sites, defs


@q("j07_enclosing_range", f"WITH {_O_SQL} SELECT site_id, symbol FROM en WHERE r = 1")
def _(s, d):
    return I.enclosing(*_occurrences(s, d))


_D_SQL = f"""{NE}, df AS (SELECT id || CASE WHEN kind IN ('Function', 'Method') THEN '().' ELSE '#' END AS symbol, file_path, start_line, 0 AS start_char, end_line, 80 AS end_char FROM n WHERE kind IN ('Function', 'Method') AND start_line IS NOT NULL AND end_line IS NOT NULL AND file_path IS NOT NULL),
  si AS (SELECT e.id AS site_id, f.file_path, f.start_line, 5 AS start_char, f.start_line AS end_line, 8 AS end_char, e.dst || CASE WHEN e.type = 'CALLS' THEN '().' ELSE '.' END AS dst
    FROM e JOIN n f ON f.id = e.src WHERE e.type IN ('CALLS', 'ACCESSES') AND e.dst IS NOT NULL AND f.file_path IS NOT NULL AND f.start_line IS NOT NULL),
  en AS (SELECT si.site_id, si.dst, df.symbol, row_number() OVER (PARTITION BY si.site_id ORDER BY df.end_line - df.start_line, df.end_char - df.start_char, df.symbol) AS r FROM si JOIN df ON df.file_path = si.file_path
    AND (df.start_line < si.start_line OR df.start_line = si.start_line AND df.start_char <= si.start_char) AND (df.end_line > si.end_line OR df.end_line = si.end_line AND df.end_char >= si.end_char)),
  dv AS (SELECT DISTINCT symbol AS src, dst, CASE WHEN dst LIKE '%().' THEN 'CALLS' ELSE 'REFERENCES' END AS type FROM en WHERE r = 1 AND symbol <> dst)"""


def _derived(s: SparkSession, d: str) -> DataFrame:
    """What an indexer would say of the calls and accesses: an occurrence on the first line of whoever makes them."""
    _, defs = _occurrences(s, d)
    f = nodes(s, d).where("file_path is not null and start_line is not null").select(F.col("id").alias("src"), "file_path", "start_line")
    e = edges(s, d).where("type in ('CALLS', 'ACCESSES') and dst is not null").select("id", "src", "dst", "type")
    symbol = F.concat("dst", F.when(F.col("type") == "CALLS", "().").otherwise("."))
    occ = e.join(f, "src").select(
        F.col("id").alias("site_id"), "file_path", "start_line", F.lit(5).alias("start_char"), F.col("start_line").alias("end_line"), F.lit(8).alias("end_char"), symbol.alias("symbol"), F.lit("reference").alias("role")
    )
    return I.derived_edges(occ, defs)


@q("n17_occurrence_edges", f"WITH {_D_SQL} SELECT src, dst, type FROM dv")
def _(s, d):
    return _derived(s, d)


@q("n18_upgrades", f"""WITH {_D_SQL}, x AS (SELECT DISTINCT rtrim(src, '().') AS src, rtrim(dst, '().') AS dst, CASE WHEN type = 'CALLS' THEN 'CALLS' ELSE 'ACCESSES' END AS type FROM dv),
  h AS (SELECT src, dst, type, max(coalesce(confidence, 0)) AS was FROM e WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2, 3)
  SELECT x.src, x.dst, x.type, 1.0::DOUBLE AS confidence, CASE WHEN was IS NULL THEN 'emitted' WHEN was < 1 THEN 'upgraded' ELSE 'known' END AS outcome FROM x LEFT JOIN h USING (src, dst, type)""")
def _(s, d):
    bare = lambda c: F.regexp_replace(c, r"[().]+$", "")
    x = _derived(s, d).select(bare("src").alias("src"), bare("dst").alias("dst"), F.when(F.col("type") == "CALLS", "CALLS").otherwise("ACCESSES").alias("type"))
    return I.upgraded(x, edges(s, d))


@q("c04_heritage", f"""WITH {NE}, r AS (SELECT e.src, t.name, f.file_path, f.repo_uri, t.kind = 'Struct' AS i FROM e JOIN n f ON f.id = e.src JOIN n t ON t.id = e.dst WHERE e.type = 'EXTENDS'),
  x AS (SELECT * FROM n WHERE kind IN ('Class', 'Struct')), a AS (SELECT name, file_path, min(id) AS x FROM x GROUP BY 1, 2), b AS (SELECT name, repo_uri, min(id) AS y FROM x WHERE repo_uri IS NOT NULL GROUP BY 1, 2), c AS (SELECT name, min(id) AS z FROM x GROUP BY 1)
  SELECT src, coalesce(x, y, z) AS dst, CASE WHEN i THEN 'IMPLEMENTS' ELSE 'EXTENDS' END AS type, CASE WHEN x IS NOT NULL THEN 0.95::DOUBLE WHEN y IS NOT NULL THEN 0.9 ELSE 0.5 END AS confidence
  FROM r LEFT JOIN a USING (name, file_path) LEFT JOIN b USING (name, repo_uri) LEFT JOIN c USING (name) WHERE coalesce(x, y, z) IS NOT NULL AND coalesce(x, y, z) <> src""")
def _(s, d):
    n = nodes(s, d)
    e = edges(s, d).where("type = 'EXTENDS'").select("src", "dst")
    slim = n.select("id", "name", "file_path", "repo_uri", "kind")
    r = e.join(slim.select(F.col("id").alias("src"), "file_path", "repo_uri"), "src").join(slim.select(F.col("id").alias("dst"), "name", F.when(F.col("kind") == "Struct", "interface").otherwise("class").alias("kind")), "dst")
    return I.heritage(r.select("src", "name", "file_path", "repo_uri", "kind"), n.where("kind in ('Class', 'Struct')"))


_T19 = r"""b AS (SELECT id, code, regexp_replace(code, '//[^\n]*|#[^\n]*|"[^"\n]*"|''[^''\n]*''', ' ', 'g') AS bare, list_filter(string_split(code, chr(10)), lambda x: trim(x, ' ') <> '') AS ln FROM sp),
  m AS (SELECT id, ln, regexp_extract_all(bare, '\b(?:if|elif|for|while|case|catch|except)\b|&&|\|\||\band\b|\bor\b') AS dc,
    regexp_extract_all(bare, '[-+*/%=<>!&|^~?:]+|\b(?:if|else|for|while|return|case|switch|try|catch|throw|new|in|not|and|or|def|func|fn|function|class|import|from|const|let|var)\b') AS op,
    list_filter(regexp_extract_all(bare, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?'), lambda x: NOT regexp_matches(x, '^(?:[-+*/%=<>!&|^~?:]+|\b(?:if|else|for|while|return|case|switch|try|catch|throw|new|in|not|and|or|def|func|fn|function|class|import|from|const|let|var)\b)$')) AS nm FROM b)"""


@q("t19_complexity", f"""WITH {N_SQL}, fc AS (SELECT file_path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM (SELECT file_path, content, row_number() OVER (PARTITION BY file_path ORDER BY content) AS r FROM nodes WHERE kind = 'File' AND content IS NOT NULL AND file_path IS NOT NULL) WHERE r = 1),
  sp AS (SELECT n.id, array_to_string(lines[greatest(start_line, 1):end_line], chr(10)) AS code FROM n JOIN fc USING (file_path) WHERE kind IN ('Function', 'Method') AND start_line IS NOT NULL AND end_line >= start_line), {_T19}
  SELECT id, len(dc) + 1 AS cyclomatic, len(ln) AS nloc, CASE WHEN len(list_distinct(op)) + len(list_distinct(nm)) > 0 THEN floor((len(op) + len(nm)) * log2((len(list_distinct(op)) + len(list_distinct(nm)))::DOUBLE) * 1000 + 0.5) / 1000 ELSE 0 END AS volume,
  coalesce(floor((list_max(list_transform(ln, lambda x: length(regexp_extract(replace(x, chr(9), '    '), '^( *)', 1)))) - list_min(list_transform(ln, lambda x: length(regexp_extract(replace(x, chr(9), '    '), '^( *)', 1))))) / 4), 0)::INT AS depth FROM m""")
def _(s, d):
    files = table(s, d, "nodes").where("kind = 'File' and content is not null and file_path is not null").groupBy("file_path").agg(F.min("content").alias("content"))
    return M.callables_measured(nodes(s, d), files)


@q("r05_zoom", f"""WITH {N_SQL}, qy AS (SELECT DISTINCT id AS qid, unnest({_TOK.format(c="name || ' ' || coalesce(language, '')")}) AS term FROM n WHERE kind = 'Struct'), nd AS (SELECT qid, count(*) AS terms FROM qy GROUP BY 1),
  ft AS (SELECT file_path AS id, max(concat_ws(' ', name, language, description, file_path)) AS text FROM n WHERE kind = 'File' AND file_path IS NOT NULL GROUP BY 1), s_t AS (SELECT id, file_path, concat_ws(' ', name, signature, description, language) AS text FROM n WHERE kind NOT IN ('File', 'Folder') AND file_path IS NOT NULL),
  {", ".join(f'''{p}w AS (SELECT id, {_TOK.format(c="text")} AS w FROM {t}), {p}p AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM {p}w) GROUP BY 1, 2), {p}l AS (SELECT id, len(w) AS len FROM {p}w), {p}n AS (SELECT count(*) AS n, avg(len) AS av FROM {p}l), {p}d AS (SELECT term, count(*) AS df FROM {p}p GROUP BY 1),
  {p}h AS (SELECT qid, p.id, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS score, count(*) AS k FROM qy JOIN {p}p p USING (term) JOIN {p}d USING (term) JOIN {p}l l ON l.id = p.id, {p}n GROUP BY 1, 2),
  {p}r AS (SELECT h.qid, h.id, score FROM {p}h h JOIN nd USING (qid) WHERE k = terms)''' for p, t in (("f", "ft"), ("s", "s_t")))},
  top AS (SELECT qid, id AS file_path FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e9) DESC, id) AS pos FROM fr) WHERE pos <= 10),
  u AS (SELECT sr.qid, sr.id, score, CASE WHEN EXISTS (SELECT 1 FROM top WHERE top.qid = sr.qid) THEN 'zoomed' ELSE 'flat' END AS tier FROM sr JOIN s_t ON s_t.id = sr.id WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.qid = sr.qid) OR EXISTS (SELECT 1 FROM top WHERE top.qid = sr.qid AND top.file_path = s_t.file_path))
  SELECT qid, id, round(score, 6) AS score, pos, tier FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e9) DESC, id) AS pos FROM u) WHERE pos <= 50""")
def _(s, d):
    # files, symbols and queries are several scans each: the nodes are merged once, and their texts written for all of them
    every = Staging(s, "zoom").cut(merge_nodes(table(s, d, "nodes"), "id kind name file_path language signature description".split()), "nodes")
    n = every.where("file_path is not null")
    files = n.where("kind = 'File'").select("file_path", F.concat_ws(" ", "name", "language", "description", "file_path").alias("text"))
    symbols = n.where("kind not in ('File', 'Folder')").select("id", "file_path", F.concat_ws(" ", "name", "signature", "description", "language").alias("text"))
    qs = every.where("kind = 'Struct'").select(F.col("id").alias("qid"), F.concat_ws(" ", "name", F.coalesce("language", F.lit(""))).alias("text"))
    return R.zoom(files, symbols, qs).select("qid", "id", F.round("score", 6).alias("score"), "pos", "tier")


@q("r08_embedding_chunks", f"""WITH {N_SQL}, t AS (SELECT id AS node_id, concat_ws(chr(10), signature, description) AS text FROM n WHERE kind IN ('Function', 'Method', 'Constructor', 'Class', 'Interface', 'Struct', 'Enum', 'Trait'))
  SELECT node_id, 'symbol' AS granularity, 0 AS chunk_index, sha256(text) AS content_hash FROM t WHERE length(text) > 0 AND length(text) <= 2000""")
def _(s, d):
    return R.embedding_chunks(nodes(s, d)).select("node_id", "granularity", "chunk_index", "content_hash")


@q("j04_unchanged_chunks", f"""WITH {N_SQL}, t AS (SELECT id AS node_id, concat_ws(chr(10), signature, description) AS text, is_exported FROM n WHERE kind IN ('Function', 'Method', 'Constructor', 'Class', 'Interface', 'Struct', 'Enum', 'Trait'))
  SELECT node_id, 0 AS chunk_index FROM t WHERE length(text) > 0 AND length(text) <= 2000 AND NOT coalesce(is_exported, FALSE)""")
def _(s, d):
    n = nodes(s, d)
    known = R.embedding_chunks(n.where("is_exported"))
    return R.embedding_chunks(n, known).select("node_id", "chunk_index")
