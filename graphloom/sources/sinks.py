"""Sinks: bills of materials, packs with a manifest, pages, co-changes, and the bounded parse cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import license_tier


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), name, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))


def cyclonedx(deps: DataFrame) -> DataFrame:
    """``purl, component``: one CycloneDX component as JSON per dependency; a document is these rows in order between its head and foot."""
    p = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    return deps.where("ecosystem is not null and name is not null").select(p.alias("purl"), F.to_json(F.struct(F.lit("library").alias("type"), "name", "version", p.alias("purl"))).alias("component")).distinct()


def spdx(deps: DataFrame) -> DataFrame:
    """``purl, package``: one SPDX package as JSON per dependency; a licence that is no known one is NOASSERTION."""
    p = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    lic = F.when(license_tier(F.col("license")).isin("unknown", "proprietary"), "NOASSERTION").otherwise(F.trim("license"))
    return deps.where("ecosystem is not null and name is not null").select(
        p.alias("purl"), F.to_json(F.struct(F.concat(F.lit("SPDXRef-"), F.substring(F.sha2(p, 256), 1, 12)).alias("SPDXID"), "name", F.col("version").alias("versionInfo"), lic.alias("licenseDeclared"))).alias("package")
    ).distinct()


def write_pack(items: dict[str, DataFrame], out: str) -> DataFrame:
    """Writes each item as lines of JSON below ``out`` and returns its manifest ``item, n_rows, digest``.

    The digest does not hang on the order of rows or files: the sum of the rows' own digests, so it is
    one pass over any number of tasks.
    """
    manifest = None
    for name, df in sorted(items.items()):
        line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
        df.select(line.alias("value")).write.mode("overwrite").text(f"{out}/{name}")
        lines = df.sparkSession.read.text(f"{out}/{name}")
        half = lambda at: F.sum(F.conv(F.substring(F.sha2("value", 256), at, 12), 16, 10).cast("decimal(38,0)"))
        one = lines.agg(F.count(F.lit(1)).alias("n_rows"), half(1).alias("a"), half(13).alias("b")).select(F.lit(name).alias("item"), "n_rows", F.sha2(F.concat_ws(":", "n_rows", "a", "b"), 256).alias("digest"))
        manifest = one if manifest is None else manifest.unionByName(one)
    return manifest


def pages(histogram: DataFrame) -> DataFrame:
    """``page, markdown``: a page per community with its files, from ``community, file_path, n, pos`` of bounded rows per community."""
    row = F.concat(F.lit("| "), "file_path", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    g = histogram.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("pos", row.alias("r")))).alias("rows"))
    return g.select(F.col("community").alias("page"), F.concat(F.lit("# "), "community", F.lit("\n\n| file | symbols |\n| --- | --- |\n"), F.array_join("rows.r", "\n")).alias("markdown"))


def cochange_rows(cochanges: DataFrame) -> DataFrame:
    """What replaces the stored co-changes: one row per pair, the latest by its time, laid out for lookups by either file."""
    best = cochanges.where("source_file is not null and target_file is not null").groupBy("source_file", "target_file").agg(
        F.max(F.struct(F.coalesce("last_cocommit_at", F.lit("")).alias("at"), "cocommit_count", "lift")).alias("b")
    )
    return best.select("source_file", "target_file", "b.cocommit_count", "b.lift", F.nullif("b.at", F.lit("")).alias("last_cocommit_at")).repartition("source_file").sortWithinPartitions("source_file", "target_file")


def kept_in_cache(entries: DataFrame, cap: float, share: float = 0.9) -> DataFrame:
    """Entries that stay: all up to ``cap`` bytes, else the newest that fill at most ``share`` of it.

    ``entries(key, bytes, mtime)``; ties by key.  Bytes are summed per day first, so only the day in which
    the bound falls is put in order row by row, within one task per hour of it.
    """
    e = entries.where("key is not null and bytes is not null and mtime is not null")
    total = e.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")).first()["t"]
    if total <= cap:
        return e
    room = cap * share
    hour = F.date_trunc("hour", "mtime")
    sums = e.groupBy(hour.alias("hour")).agg(F.sum("bytes").alias("b"))
    newer = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    # a row per hour of the cache's life: bounded by time, not by entries
    base = sums.withColumn("before", F.coalesce(F.sum("b").over(newer), F.lit(0))).where(F.col("before") < room)
    within = e.withColumn("hour", hour).join(F.broadcast(base.select("hour", "b", "before")), "hour")
    w = Window.partitionBy("hour").orderBy(F.desc("mtime"), "key").rowsBetween(Window.unboundedPreceding, 0)
    whole = within.where(F.col("before") + F.col("b") <= room)
    edge = within.where(F.col("before") + F.col("b") > room).withColumn("upto", F.col("before") + F.sum("bytes").over(w)).where(F.col("upto") <= room)
    return whole.select(e.columns).unionByName(edge.select(e.columns))
