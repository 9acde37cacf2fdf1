"""Statistics over histories: decay, Gini, bus factor, co-change, drift, trends.

A history is ``commits(sha, file, author, ct)`` with one row per commit and file, ``ct`` in epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import round_up

DAY = 86_400.0


def churn_decay(commits: DataFrame, now: int, half_life: float = 90.0) -> DataFrame:
    """``file, churn``: commits weighted by age; a commit in the future counts as of now."""
    age = F.greatest((F.lit(float(now)) - F.col("ct")) / DAY, F.lit(0.0))
    return commits.groupBy("file").agg(F.sum(F.exp(-F.log(F.lit(2.0)) / half_life * age)).alias("s")).select("file", round_up(F.col("s"), 3).alias("churn"))


def gini(counts: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, gini, bus_factor``: inequality of positive counts per key, and how many carry them."""
    w = Window.partitionBy(key).orderBy(value)
    r = counts.where(F.col(value) > 0).withColumn("i", F.row_number().over(w))
    g = r.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i") * F.col(value)).alias("ix"), F.sum(value).alias("x"))
    raw = F.lit(2.0) * F.col("ix") / (F.col("n") * F.col("x")) - (F.col("n") + 1.0) / F.col("n")
    g = g.withColumn("gini", F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)))
    bus = F.least(F.greatest(F.lit(1.0) + F.floor((F.lit(1.0) - F.col("gini")) * (F.col("n") - 1) + 0.5), F.lit(1.0)), F.col("n").cast("double"))
    return g.select(key, "n", "gini", bus.cast("long").alias("bus_factor"))


def cochange(commits: DataFrame, cap: int = 100) -> DataFrame:
    """``source_file, target_file, cocommit_count, ..., lift``: pairs of files of one commit.

    Pairs arise within a commit only, and a commit above ``cap`` files is skipped there but counted in
    the total, as surveyed (a sweeping commit tells nothing of its pairs), so the pairs of a commit have a
    bound; commits are folded to sorted arrays first.
    """
    c = commits.where("file is not null and sha is not null").groupBy("sha").agg(F.array_sort(F.collect_set("file")).alias("files"), F.max("ct").alias("ct"))
    total = c.count()
    used = c.where(F.size("files") <= cap)
    per = used.select(F.explode("files").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("k"))
    src = used.select("ct", "files", F.posexplode("files").alias("p", "source_file"))
    pairs = src.select("ct", "source_file", F.explode(F.slice("files", F.col("p") + 2, F.size("files"))).alias("target_file"))
    g = pairs.groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("cocommit_count"), F.max("ct").alias("ct"))
    j = g.join(per.select(F.col("file").alias("source_file"), F.col("k").alias("total_commits_source")), "source_file").join(
        per.select(F.col("file").alias("target_file"), F.col("k").alias("total_commits_target")), "target_file"
    )
    lift = F.col("cocommit_count") * F.lit(total) / (F.col("total_commits_source") * F.col("total_commits_target"))
    return j.select("source_file", "target_file", "cocommit_count", "total_commits_source", "total_commits_target", round_up(lift, 4).alias("lift"))


def gaps(commits: DataFrame) -> DataFrame:
    """``file, max_gap, mean_gap`` in days between successive commits; null with fewer than two."""
    w = Window.partitionBy("file").orderBy("ct", "sha")
    d = commits.select("file", "sha", "ct").distinct().withColumn("gap", (F.col("ct") - F.lag("ct").over(w)) / DAY)
    return d.groupBy("file").agg(F.floor(F.max("gap") + 0.5).alias("max_gap"), round_up(F.avg("gap"), 2).alias("mean_gap"))


def top_contributor(commits: DataFrame) -> DataFrame:
    """``file, author, n, last_ct``: most commits, the smaller author on a tie."""
    a = commits.groupBy("file", "author").agg(F.count_distinct("sha").alias("n"), F.max("ct").alias("last_ct"))
    best = a.groupBy("file").agg(F.min(F.struct((-F.col("n")).alias("m"), "author", "n", "last_ct")).alias("b"))
    return best.select("file", "b.author", "b.n", "b.last_ct")


def drift(commits: DataFrame, now: int, weeks: int = 13) -> DataFrame:
    """``file, drift``: deviation of the cumulative top-3 shares over weekly ticks.

    Commits fold to one row per file, author and week first; ticks then sum over at most ``weeks`` rows.
    """
    week = 7 * 86_400
    start = now - weeks * week
    slot = F.greatest(F.lit(0), F.ceil((F.col("ct") - F.lit(start)) / F.lit(float(week)))).cast("int")
    f = commits.where(F.col("ct") <= now).groupBy("file", "author", slot.alias("slot")).agg(F.count_distinct("sha").alias("n"))
    ticks = f.select("file", "author", "n", F.explode(F.sequence(F.col("slot"), F.lit(weeks))).alias("tick"))
    cum = ticks.groupBy("file", "tick", "author").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("file", "tick")
    share = cum.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "author"))).where("r <= 3")
    return share.groupBy("file").agg(round_up(F.stddev_pop("share"), 4).alias("drift"))


def fix_after_feature(events: DataFrame) -> DataFrame:
    """Share of fixes that follow a feature within 48 hours, per user (``error`` after ``signup`` in event tables)."""
    from graphloom.operators.joins import preceded

    hit = preceded(events, "signup", "error", 172_800).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    fixes = events.where(F.col("event_type") == "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("fixes"))
    return fixes.join(hit, "user_id", "left").select("user_id", "fixes", round_up(F.coalesce("hits", F.lit(0)) / F.col("fixes"), 3).alias("density"))


def trends(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, n, streak, projected, trend`` of a series: rising streak at its end, projection of the mean of its last five steps.

    Class: accelerating from three rises on end, else degrading or improving by the last step, else stable.
    """
    w = Window.partitionBy(key).orderBy(order)
    back = Window.partitionBy(key).orderBy(F.desc(order))
    d = series.withColumn("step", F.col(value) - F.lag(value).over(w)).withColumn("i", F.row_number().over(back)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    # the streak ends before the first step from the end that does not rise
    stop = F.min(F.when(F.coalesce(F.col("step"), F.lit(0.0)) <= 0, F.col("i")))
    last5 = F.count_if((F.col("i") <= 5) & F.col("step").isNotNull())
    g = d.groupBy(key).agg(
        F.max("n").alias("n"), (stop - 1).alias("streak"), F.max(F.when(F.col("i") == 1, F.col(value))).alias("last"),
        F.max(F.when(F.col("i") == 1, F.col("step"))).alias("step"),
        F.sum(F.when((F.col("i") <= 5), F.col("step"))).alias("s"), last5.alias("k"),
    )
    mean = F.when(F.col("k") > 0, F.col("s") / F.col("k")).otherwise(0.0)
    trend = F.when(F.col("streak") >= 3, "accelerating").when(F.col("step") > 0, "degrading").when(F.col("step") < 0, "improving").otherwise("stable")
    return g.select(key, "n", "streak", round_up(F.col("last") + mean * 30, 3).alias("projected"), trend.alias("trend"))


def orphan_grade(files: DataFrame, epsilon: float) -> DataFrame:
    """``file, grade`` from ``history_days, idle_days, churn, coauthors``; shorter histories are active."""
    old = F.col("history_days") >= 365
    low = F.col("churn") <= epsilon
    grade = F.when(old & (F.col("idle_days") > 730) & low, "fossilized").when(old & (F.col("idle_days") > 365) & ~low, "abandoned").when(
        old & (F.col("idle_days") > 180) & ~low & (F.col("coauthors") == 0), "orphaned").otherwise("active")
    return files.select("file", grade.alias("grade"))
