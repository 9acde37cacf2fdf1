"""Queries of flows and processes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import flows as W
from graphloom.operators import traversal as T
from graphloom.plans.graph_queries import NE, S0_SQL, STARTS, _WORDS, edges, nodes
from graphloom.runtime import Staging

QUERIES: dict = {}
SQL: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CALLS = """cal AS (SELECT id FROM n WHERE kind IN ('Function', 'Method', 'Constructor')),
  k AS (SELECT src, dst, count(*) AS n FROM e WHERE type = 'CALLS' AND confidence >= 0.5 AND src IN (SELECT id FROM cal) AND dst IN (SELECT id FROM cal) GROUP BY 1, 2)"""
_ENTRIES = f"""{_CALLS}, o AS (SELECT src AS id, sum(n) AS callees FROM k GROUP BY 1), i AS (SELECT dst AS id, sum(n) AS callers FROM k GROUP BY 1),
  pd AS (SELECT DISTINCT regexp_replace(file_path, '/?[^/]*$', '') AS dir FROM n WHERE kind = 'File' AND list_reverse(string_split(lower(file_path), '/'))[1] IN
    ('index.ts', 'index.tsx', 'index.js', 'index.mjs', 'index.cjs', 'index.jsx', 'mod.rs', 'lib.rs', '__init__.py', 'main.py', 'index.php', 'index.dart', 'library.dart')),
  sc AS (SELECT n.id, n.name, n.file_path, callees / (coalesce(callers, 0) + 1) + CASE WHEN coalesce(is_exported, FALSE) THEN 0.5::DOUBLE ELSE 0 END
    + CASE WHEN string_split(list_reverse(string_split(lower(file_path), '/'))[1], '.')[1] IN ('main', 'handler', 'handlers', 'controller', 'controllers', 'route', 'routes', 'router', 'view', 'views', 'api', 'index', 'mod', 'lib',
      'app', 'application', 'server', 'entry', 'urls', 'endpoints', 'middleware', 'service', 'services', 'resource', 'resources', 'page', 'pages') THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches('/' || lower(file_path), '/app/api/|/pages/api/|/app/controllers/|/app/http/controllers/|/controllers/|/handlers/|/routes/|/router/|/views/|/endpoints/|/api/|/cmd/|/src/handlers/|/src/routes/|/src/controller/|/src/controllers/|/lib/pages/|/handlers\\.')
      OR regexp_matches('/' || lower(file_path), '(/route\\.ts|/route\\.tsx|/route\\.js|/route\\.mjs|/handler\\.ts|/handler\\.py|/main\\.go|/main\\.rs|/mod\\.rs|/lib\\.rs|/main\\.py|/urls\\.py|/routes\\.py|/views\\.py|/public/index\\.php)$') THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(n.name, '^(handle|on|serve|main|route|dispatch|get|post|put|patch|delete|do|process|index|show|list|create|update|destroy|setup|run)($|[A-Z_-])')
      OR regexp_matches(n.name, '.(Controller|Handler|Middleware|Service|Endpoint|Resource|View|Route|RouteHandler|Action)$') THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN coalesce(is_exported, FALSE) AND pd.dir IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END AS score
    FROM n JOIN o ON o.id = n.id LEFT JOIN i ON i.id = n.id LEFT JOIN pd ON pd.dir = regexp_replace(file_path, '/?[^/]*$', '')
    WHERE kind IN ('Function', 'Method', 'Constructor') AND n.file_path IS NOT NULL AND n.name IS NOT NULL AND NOT (len(list_intersect(string_split(lower(file_path), '/'), ['test', 'tests', 'spec', 'specs', '__tests__'])) > 0
      OR contains(lower(file_path), '.test.') OR contains(lower(file_path), '.spec.'))),
  ep AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM sc) WHERE r <= greatest(20, least(300, floor((SELECT count(*) FROM cal) * 0.05))))"""


def _levels() -> str:
    out = ["""adj AS MATERIALIZED (SELECT src, dst, pos FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM k) WHERE pos <= 4),
  l0 AS MATERIALIZED (SELECT id AS start, id AS node, 0 AS ord FROM ep), v0 AS (SELECT start, node FROM l0)"""]
    for d in range(1, 11):
        p = d - 1
        out.append(f"""c{d} AS (SELECT l.start, l.node AS src, a.dst, row_number() OVER (PARTITION BY l.start ORDER BY l.ord, a.pos) AS o FROM l{p} l JOIN adj a ON a.src = l.node
    WHERE NOT EXISTS (SELECT 1 FROM v{p} v WHERE v.start = l.start AND v.node = a.dst)),
  u{d} AS (SELECT start, dst, arg_min(src, o) AS src, min(o) AS o FROM c{d} GROUP BY 1, 2), h{d} AS (SELECT start, count(*) AS have FROM v{p} GROUP BY 1),
  l{d} AS MATERIALIZED (SELECT start, src, node, ord FROM (SELECT u.start, src, dst AS node, have, row_number() OVER (PARTITION BY u.start ORDER BY o) AS ord FROM u{d} u JOIN h{d} h ON h.start = u.start) WHERE ord <= 30 - have),
  v{d} AS MATERIALIZED (SELECT start, node FROM v{p} UNION ALL SELECT start, node FROM l{d})""")
    every = " UNION ALL ".join(f"SELECT start, src, node AS dst, {d} AS depth FROM l{d}" for d in range(1, 11))
    out.append(f"al AS ({every}), fl AS MATERIALIZED (SELECT * FROM al WHERE start IN (SELECT start FROM al GROUP BY 1 HAVING count(*) >= 2))")
    return ", ".join(out)


_FLOWS = f"{_ENTRIES}, {_levels()}"
_WORD = _WORDS.replace("(name,", "(n.name,")
_PROCS = f"""mem AS (SELECT start, dst AS id FROM fl UNION ALL SELECT DISTINCT start, start FROM fl),
  tk AS (SELECT start, word, count(*) AS c FROM (SELECT start, unnest({_WORD}) AS word FROM mem JOIN n ON n.id = mem.id WHERE n.name IS NOT NULL) WHERE length(word) >= 3 AND word NOT IN
    ('get', 'set', 'is', 'has', 'new', 'make', 'do', 'handle', 'on', 'to', 'from', 'of', 'the', 'a', 'an', 'or', 'and', 'for', 'with', 'fn', 'func', 'function', 'method', 'impl', 'cls', 'self', 'this', 'ctx', 'run', 'exec', 'init', 'start', 'stop', 'main') GROUP BY 1, 2),
  lb AS (SELECT start, count(*) AS m, string_agg(word, ' ' ORDER BY r) AS label FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY c DESC, word) AS r FROM tk) WHERE r <= 3 GROUP BY 1),
  pr AS (SELECT 'Process:' || n.file_path || ':process-' || n.id AS id, n.name || '-flow' AS name, n.id AS entry_point_id, c.step_count, CASE WHEN m >= 2 THEN label ELSE n.name || '-flow' END AS label
    FROM (SELECT start, count(*) AS step_count FROM fl GROUP BY 1) c JOIN n ON n.id = c.start LEFT JOIN lb ON lb.start = c.start)"""


def _walked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(s, d)
    st = Staging(s, "calls")
    steps = st.cut(W.call_steps(n, edges(s, d)), "steps")
    return n, st.cut(W.flows(W.entries(n, steps), steps), "flows")


@q("n08_entries", f"WITH {NE}, {_ENTRIES} SELECT ep.id, round(score, 9) AS score FROM ep JOIN sc ON sc.id = ep.id")
def _(s, d):
    n = nodes(s, d)
    return W.entries(n, Staging(s, "calls").cut(W.call_steps(n, edges(s, d)), "steps")).select("id", F.round("score", 9).alias("score"))


@q("n09_flows", f"WITH {NE}, {_FLOWS} SELECT start, src, dst, depth FROM fl")
def _(s, d):
    return _walked(s, d)[1]


@q("n10_processes", f"WITH {NE}, {_FLOWS}, {_PROCS} SELECT * FROM pr")
def _(s, d):
    n, walked = _walked(s, d)
    return W.processes(n, walked)


@q("n10_steps", f"WITH {NE}, {_FLOWS} SELECT DISTINCT src, dst, 'PROCESS_STEP' AS type, 0.85::DOUBLE AS confidence, 'bfs-from-entry-point' AS reason, depth AS step FROM fl")
def _(s, d):
    return W.step_edges(_walked(s, d)[1])


_UP = """ps AS MATERIALIZED (SELECT DISTINCT src, dst FROM fl WHERE src <> dst),
  up AS (SELECT start, start AS node, 0 AS depth FROM tg UNION SELECT up.start, ps.src, up.depth + 1 FROM up JOIN ps ON ps.dst = up.node WHERE up.depth < {0})"""


@q("g05_affected_processes", f"WITH RECURSIVE {NE}, {S0_SQL}, {_FLOWS}, {_PROCS}, tg AS (SELECT start FROM s0), {_UP.format(8)} SELECT DISTINCT up.start, pr.id AS process_id FROM up JOIN pr ON pr.entry_point_id = up.node")
def _(s, d):
    n, walked = _walked(s, d)
    return W.affected(T.query_set(n, STARTS), W.step_edges(walked), W.processes(n, walked))


@q("f08_by_entry_point", f"WITH {NE}, {_FLOWS}, {_PROCS} SELECT id, name FROM pr WHERE entry_point_id = (SELECT min(entry_point_id) FROM pr)")
def _(s, d):
    n, walked = _walked(s, d)
    p = W.processes(n, walked)
    return p.where(F.col("entry_point_id") == F.lit(p.agg(F.min("entry_point_id")).first()[0])).select("id", "name")


@q("g09_grouped_hits", f"""WITH RECURSIVE {NE}, {S0_SQL}, {_FLOWS}, {_PROCS}, hit AS (SELECT coalesce(n.language, '') AS qid, n.id AS node_id, max(coalesce(cyclomatic_complexity, 0))::DOUBLE AS score FROM s0 JOIN n ON n.id = s0.start GROUP BY 1, 2),
  tg AS (SELECT DISTINCT node_id AS start FROM hit), {_UP.format(10)},
  dn AS (SELECT entry_point_id AS start, entry_point_id AS node, 0 AS depth FROM pr UNION SELECT dn.start, ps.dst, dn.depth + 1 FROM dn JOIN ps ON ps.src = dn.node WHERE dn.depth < 10),
  me AS (SELECT DISTINCT pr.id AS process_id, dn.node AS node_id FROM pr JOIN dn ON dn.start = pr.entry_point_id),
  mi AS (SELECT DISTINCT qid, pr.id AS process_id FROM hit JOIN up ON up.start = hit.node_id JOIN pr ON pr.entry_point_id = up.node),
  sc2 AS (SELECT mi.qid, mi.process_id, max(hit.score) AS score FROM mi JOIN me ON me.process_id = mi.process_id JOIN hit ON hit.qid = mi.qid AND hit.node_id = me.node_id GROUP BY 1, 2)
  SELECT mi.qid, mi.process_id, coalesce(sc2.score, 0.0) AS score, z.n_members FROM mi LEFT JOIN sc2 ON sc2.qid = mi.qid AND sc2.process_id = mi.process_id JOIN (SELECT process_id, count(*) AS n_members FROM me GROUP BY 1) z ON z.process_id = mi.process_id""")
def _(s, d):
    n, walked = _walked(s, d)
    starts = T.query_set(n, STARTS)
    hits = starts.join(n, starts["start"] == n["id"]).select(F.coalesce("language", F.lit("")).alias("qid"), F.col("id").alias("node_id"), F.coalesce("cyclomatic_complexity", F.lit(0)).cast("double").alias("score"))
    return W.grouped_hits(hits, W.step_edges(walked), W.processes(n, walked))
