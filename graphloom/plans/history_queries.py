"""Queries over histories and texts: decay, inequality, co-change, trends, retrieval; each with its SQL.

Order lines serve as a history: an order is a commit, a part a file, a supplier an author.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import retrieval as R
from graphloom.operators import temporal as T
from graphloom.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


#: The day all ages count from, in epoch seconds.
NOW = 1_735_689_600
C_SQL = "c AS (SELECT l_orderkey AS sha, l_partkey AS file, l_suppkey AS author, epoch(l_shipdate)::BIGINT AS ct FROM lineitem WHERE l_orderkey IS NOT NULL)"


def commits(s: SparkSession, d: str) -> DataFrame:
    t = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1_000_000).cast("long")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), t.alias("ct"))


@q("t01_churn", f"WITH {C_SQL} SELECT file, floor(sum(exp(-ln(2.0::DOUBLE) / 90.0 * greatest(({NOW}::DOUBLE - ct) / 86400.0, 0.0))) * 1000.0 + 0.5) / 1000.0 AS churn FROM c GROUP BY 1")
def _(s, d):
    return T.churn_decay(commits(s, d), NOW)


@q("t03_type_histogram", "SELECT user_id, list_sort(list(event_type || '=' || n)) AS histogram FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    g = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("user_id").agg(F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string")))).alias("histogram"))


@q("t04_fix_density", """WITH h AS (SELECT DISTINCT f.event_id, f.user_id FROM events f JOIN events g ON g.user_id = f.user_id AND g.event_type = 'signup' AND g.ts < f.ts
  AND f.ts - g.ts <= INTERVAL 172800 SECOND WHERE f.event_type = 'error'), k AS (SELECT user_id, count(*) AS hits FROM h GROUP BY 1)
  SELECT f.user_id, fixes, floor(coalesce(hits, 0) / fixes * 1000.0 + 0.5) / 1000.0 AS density FROM (SELECT user_id, count(*) AS fixes FROM events WHERE event_type = 'error' GROUP BY 1) f LEFT JOIN k USING (user_id)""")
def _(s, d):
    return T.fix_after_feature(table(s, d, "events"))


_GINI = """r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY k) AS i FROM p WHERE k > 0),
  g AS (SELECT file, count(*) AS n, 2.0::DOUBLE * sum(i * k) / (count(*) * sum(k)) - (count(*) + 1.0::DOUBLE) / count(*) AS raw FROM r GROUP BY 1)
  SELECT file, n, greatest(least(raw, 1.0), 0.0)::DOUBLE AS gini, least(greatest(1.0 + floor((1.0 - greatest(least(raw, 1.0), 0.0)) * (n - 1) + 0.5), 1.0), n)::BIGINT AS bus_factor FROM g"""


@q("t07_gini_bus_factor", f"WITH {C_SQL}, p AS (SELECT file, author, count(DISTINCT sha) AS k FROM c GROUP BY 1, 2), {_GINI}")
def _(s, d):
    p = commits(s, d).groupBy("file", "author").agg(F.count_distinct("sha").alias("k"))
    return T.gini(p, "file", "k")


@q("t10_top_contributor", f"""WITH {C_SQL}, a AS (SELECT file, author, count(DISTINCT sha) AS n, max(ct) AS last_ct FROM c GROUP BY 1, 2)
  SELECT file, author, n, last_ct FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS r FROM a) WHERE r = 1""")
def _(s, d):
    return T.top_contributor(commits(s, d))


@q("t12_cochange", f"""WITH {C_SQL}, f0 AS (SELECT DISTINCT sha, file FROM c), f AS (SELECT * FROM f0 WHERE sha IN (SELECT sha FROM f0 GROUP BY 1 HAVING count(*) <= 100)), t AS (SELECT count(DISTINCT sha) AS total FROM c), k AS (SELECT file, count(*) AS k FROM f GROUP BY 1),
  p AS (SELECT a.file AS x, b.file AS y, count(*) AS co FROM f a JOIN f b ON a.sha = b.sha AND a.file < b.file GROUP BY 1, 2)
  SELECT x AS source_file, y AS target_file, co AS cocommit_count, i.k AS total_commits_source, j.k AS total_commits_target, floor(co * total / (i.k * j.k) * 10000.0 + 0.5) / 10000.0 AS lift
  FROM p JOIN k i ON i.file = x JOIN k j ON j.file = y, t""")
def _(s, d):
    return T.cochange(commits(s, d))


@q("t13_drift", f"""WITH {C_SQL}, z AS (SELECT file, author, greatest(0, ceil((ct - {NOW - 13 * 604800}) / 604800.0))::INT AS slot, count(DISTINCT sha) AS n FROM c WHERE ct <= {NOW} GROUP BY 1, 2, 3),
  u AS (SELECT file, tick, author, sum(n) AS n FROM z JOIN (SELECT unnest(range(0, 14)) AS tick) ON tick >= slot GROUP BY 1, 2, 3),
  v AS (SELECT file, n / sum(n) OVER (PARTITION BY file, tick) AS share, row_number() OVER (PARTITION BY file, tick ORDER BY n DESC, author) AS r FROM u)
  SELECT file, floor(stddev_pop(share) * 10000.0 + 0.5) / 10000.0 AS drift FROM v WHERE r <= 3 GROUP BY 1""")
def _(s, d):
    return T.drift(commits(s, d), NOW)


@q("w02_gaps", f"""WITH {C_SQL}, x AS (SELECT DISTINCT file, sha, ct FROM c), g AS (SELECT file, (ct - lag(ct) OVER (PARTITION BY file ORDER BY ct, sha)) / 86400.0 AS gap FROM x)
  SELECT file, floor(max(gap) + 0.5)::BIGINT AS max_gap, floor(avg(gap) * 100.0 + 0.5) / 100.0 AS mean_gap FROM g GROUP BY 1""")
def _(s, d):
    return T.gaps(commits(s, d))


_WEEKLY = "w AS (SELECT user_id, floor(epoch(ts) / 604800)::BIGINT AS week, floor(sum(value) * 100 + 0.5) / 100 AS total FROM events GROUP BY 1, 2)"


@q("w03_trends", f"""WITH {_WEEKLY}, s AS (SELECT *, total - lag(total) OVER (PARTITION BY user_id ORDER BY week) AS step, row_number() OVER (PARTITION BY user_id ORDER BY week DESC) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM w),
  g AS (SELECT user_id, max(n) AS n, min(CASE WHEN coalesce(step, 0) <= 0 THEN i END) - 1 AS streak, max(CASE WHEN i = 1 THEN total END) AS last, max(CASE WHEN i = 1 THEN step END) AS step,
    sum(CASE WHEN i <= 5 THEN step END) AS su, count(*) FILTER (WHERE i <= 5 AND step IS NOT NULL) AS k FROM s GROUP BY 1)
  SELECT user_id, n, streak, floor((last + CASE WHEN k > 0 THEN su / k ELSE 0.0 END * 30) * 1000.0 + 0.5) / 1000.0 AS projected,
    CASE WHEN streak >= 3 THEN 'accelerating' WHEN step > 0 THEN 'degrading' WHEN step < 0 THEN 'improving' ELSE 'stable' END AS trend FROM g""")
def _(s, d):
    week = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000) / 604_800).cast("long")
    w = table(s, d, "events").groupBy("user_id", week.alias("week")).agg(X.round_up(F.sum("value"), 2).alias("total"))
    return T.trends(w, "user_id", "week", "total")


@q("t11_orphan_grade", f"""WITH {C_SQL}, f AS (SELECT file, (max(ct) - min(ct)) / 86400.0 AS history_days, ({NOW} - max(ct)) / 86400.0 AS idle_days, count(*)::DOUBLE AS churn, count(DISTINCT author) - 1 AS coauthors FROM c GROUP BY 1)
  SELECT file, CASE WHEN history_days >= 365 AND idle_days > 730 AND churn <= 3 THEN 'fossilized' WHEN history_days >= 365 AND idle_days > 365 AND NOT churn <= 3 THEN 'abandoned'
    WHEN history_days >= 365 AND idle_days > 180 AND NOT churn <= 3 AND coauthors = 0 THEN 'orphaned' ELSE 'active' END AS grade FROM f""")
def _(s, d):
    c = commits(s, d).groupBy("file").agg(
        ((F.max("ct") - F.min("ct")) / 86400.0).alias("history_days"), ((F.lit(NOW) - F.max("ct")) / 86400.0).alias("idle_days"),
        F.count(F.lit(1)).cast("double").alias("churn"), (F.count_distinct("author") - 1).alias("coauthors"),
    )
    return T.orphan_grade(c, 3.0)


@q("t18_contributor_hash", "SELECT c_custkey, sha256(lower(trim(c_name))) AS hash FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", F.sha2(F.lower(F.trim("c_name")), 256).alias("hash"))


@q("x05_iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


@q("x06_round_up", "SELECT c_custkey, floor(c_acctbal * 10.0 + 0.5) / 10.0 AS rounded FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", X.round_up(F.col("c_acctbal"), 1).alias("rounded"))


@q("x08_json_fields", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@q("m01_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


@q("m01_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, i""")
def _(s, d):
    e = table(s, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n")).select("user_id", "first_ts", "n")


_TOK = "list_filter(string_split(lower(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"


@q("r02_knn", """WITH x AS (SELECT a.vec_id AS qid, b.vec_id AS id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
  SELECT qid, id, round(dist, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS r FROM x) WHERE r <= 10""")
def _(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.knn(v, v.where("id % 20 = 0").select(F.col("id").alias("qid"), "v")).select("qid", "id", F.round("distance", 6).alias("distance"))


@q("r03_fusion", """WITH a AS (SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS pos FROM events),
  b AS (SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
  u AS (SELECT *, 0 AS run FROM a UNION ALL SELECT *, 1 FROM b), g AS (SELECT qid, id, sum(1.0::DOUBLE / (60 + pos)) AS score, min((run, pos)) AS f FROM u GROUP BY 1, 2)
  SELECT qid, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY floor(score * 1e12) DESC, f, id) AS r FROM g) WHERE r <= 50""")
def _(s, d):
    e = table(s, d, "events")
    rank = lambda *o: e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy(*o)).alias("pos"))
    return R.fuse(rank(F.desc("value"), "event_id"), rank("ts", "event_id")).select("qid", "id", F.round("score", 9).alias("score"))
