"""Queries of readers, sinks and the composed analysis over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import catalogue as C
from graphloom.plans.graph_queries import _DEAD, _TIER, N_SQL, NE, nodes
from graphloom.plans.phases import ANALYSIS, DEPENDENCIES, ordered
from graphloom.runtime import table
from graphloom.sources import ignore, reports, sinks

QUERIES: dict = {}
SQL: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_IGNORE = [("", "*.md\n!README.md\ntests/\n/docs\n**/gen_*.py\n")]


@q("s02_unignored", f"""WITH {N_SQL} SELECT file_path FROM n WHERE kind = 'File' AND file_path IS NOT NULL AND NOT regexp_matches(file_path, '(^|/)tests/') AND NOT regexp_matches(file_path, '^docs(/|$)')
  AND NOT regexp_matches(file_path, '(^|/)[^/]*\\.md/') AND NOT (regexp_matches(file_path, '\\.md$') AND NOT regexp_matches(file_path, '(^|/)README\\.md$')) AND NOT regexp_matches(file_path, '(^|/)gen_[^/]*\\.py(/|$)')""")
def _(s: SparkSession, d: str) -> DataFrame:
    return ignore.without_ignored(nodes(s, d).where("kind = 'File' and file_path is not null").select("file_path"), _IGNORE, "file_path")


_RULES = [("markdown-site", "*", "file", r"(^|/)docs/[^/]+\.md$"), ("node-package", "npm", "file", r"(^|/)package(-lock)?\.json$"), ("cargo-crate", "cargo", "file", r"\.rs$"), ("go-module", "go", "file", r"\.go$")]


@q("s13_frameworks", f"""WITH {N_SQL}, p AS (SELECT DISTINCT repo_uri, file_path AS path FROM n WHERE kind = 'File' AND repo_uri IS NOT NULL AND file_path IS NOT NULL),
  dp AS (SELECT DISTINCT n.repo_uri, x.ecosystem FROM edges e JOIN n ON n.id = e.src JOIN external_symbols x ON x.id = e.dst WHERE n.repo_uri IS NOT NULL),
  h AS (SELECT repo_uri, 'markdown-site' AS framework, path FROM p WHERE regexp_matches(path, '(^|/)docs/[^/]+\\.md$') UNION ALL
    SELECT repo_uri, 'node-package', path FROM p WHERE regexp_matches(path, '(^|/)package(-lock)?\\.json$') AND repo_uri IN (SELECT repo_uri FROM dp WHERE ecosystem = 'npm') UNION ALL
    SELECT repo_uri, 'cargo-crate', path FROM p WHERE regexp_matches(path, '\\.rs$') AND repo_uri IN (SELECT repo_uri FROM dp WHERE ecosystem = 'cargo') UNION ALL
    SELECT repo_uri, 'go-module', path FROM p WHERE regexp_matches(path, '\\.go$') AND repo_uri IN (SELECT repo_uri FROM dp WHERE ecosystem = 'go'))
  SELECT repo_uri, framework, list_sort(list(DISTINCT 'file:' || path)) AS evidence FROM h GROUP BY 1, 2""")
def _(s, d):
    n = nodes(s, d)
    ext = table(s, d, "external_symbols").select(F.col("id").alias("dst"), "ecosystem", "name")
    used = table(s, d, "edges").select("src", "dst").join(F.broadcast(ext), "dst").join(n.where("repo_uri is not null").select(F.col("id").alias("src"), "repo_uri"), "src")
    return reports.frameworks(_RULES, used.select("repo_uri", "ecosystem", "name").distinct(), n.where("kind = 'File' and repo_uri is not null and file_path is not null").select("repo_uri", F.col("file_path").alias("path")).distinct())


@q("s16_cochange_rows", """SELECT source_file, target_file, b.c AS cocommit_count, b.l AS lift, nullif(b.at, '') AS last_cocommit_at FROM (SELECT source_file, target_file, max({'at': coalesce(last_cocommit_at, ''), 'c': cocommit_count, 'l': lift}) AS b
  FROM cochanges WHERE source_file IS NOT NULL AND target_file IS NOT NULL GROUP BY 1, 2)""")
def _(s, d):
    return sinks.cochange_rows(table(s, d, "cochanges"))


_PURL = "'pkg:' || ecosystem || '/' || name || coalesce('@' || version, '')"


@q("s18_components", f"""SELECT DISTINCT {_PURL} AS purl, '{{"type":"library","name":"' || name || '"' || coalesce(',"version":"' || version || '"', '') || ',"purl":"' || {_PURL} || '"}}' AS component FROM external_symbols WHERE ecosystem IS NOT NULL AND name IS NOT NULL""")
def _(s, d):
    return sinks.cyclonedx(table(s, d, "external_symbols"))


@q("s18_packages", f"""SELECT DISTINCT {_PURL} AS purl, '{{"SPDXID":"SPDXRef-' || substring(sha256({_PURL}), 1, 12) || '","name":"' || name || '"' || coalesce(',"versionInfo":"' || version || '"', '') || ',"licenseDeclared":"'
  || CASE WHEN {_TIER} IN ('unknown', 'proprietary') THEN 'NOASSERTION' ELSE trim(license) END || '"}}' AS package FROM external_symbols WHERE ecosystem IS NOT NULL AND name IS NOT NULL""")
def _(s, d):
    return sinks.spdx(table(s, d, "external_symbols"))


@q("s20_pages", f"""WITH {N_SQL}, g AS (SELECT repo_uri AS community, file_path, count(*) AS n FROM n WHERE kind <> 'File' AND repo_uri IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, file_path) AS pos FROM g) WHERE pos <= 10)
  SELECT community AS page, '# ' || community || chr(10) || chr(10) || '| file | symbols |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || file_path || ' | ' || n || ' |', chr(10) ORDER BY pos) AS markdown FROM t GROUP BY 1""")
def _(s, d):
    return sinks.pages(C.file_histogram(nodes(s, d).where("kind <> 'File'").select(F.col("repo_uri").alias("community"), "file_path")))


@q("s22_kept_in_cache", """WITH e AS (SELECT event_id AS key, floor(value * 100)::BIGINT AS bytes, ts AS mtime FROM events WHERE value IS NOT NULL), c AS (SELECT floor(sum(bytes) * 0.6) AS cap FROM e),
  r AS (SELECT *, sum(bytes) OVER (ORDER BY mtime DESC, key ROWS UNBOUNDED PRECEDING) AS upto FROM e) SELECT key, bytes FROM r, c WHERE upto <= cap * 0.9""")
def _(s, d):
    e = table(s, d, "events").where("value is not null").select(F.col("event_id").alias("key"), F.floor(F.col("value") * 100).alias("bytes"), F.col("ts").alias("mtime"))
    cap = e.agg(F.floor(F.sum("bytes") * 0.6)).first()[0] or 0
    return sinks.kept_in_cache(e, cap).select("key", "bytes")


@q("n19_phase_order")
def _(s, d):
    return s.createDataFrame(list(enumerate(ordered(DEPENDENCIES))), "pos int, phase string")


@q("analyze_stats", f"""WITH {NE}, {_DEAD} SELECT 'node' AS what, kind AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'deadness', deadness, count(*) FROM dead GROUP BY 2""")
def _(s, d):
    return ANALYSIS.run({"raw_nodes": table(s, d, "nodes"), "raw_edges": table(s, d, "edges")})["stats"]
