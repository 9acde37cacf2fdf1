"""Readers that turn repositories, histories and reports into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "c": "c", "h": "c",
    "cpp": "cpp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "sql": "sql",
}
# Folders that no scan enters.
SKIPPED = "(^|/)(\\.git|node_modules|\\.venv|__pycache__|dist|target)/"


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return table[ext]


def scan_repo(spark: SparkSession, root: str, max_bytes: int = 1_000_000) -> DataFrame:
    """``path, size, sha256, language, is_binary, content``: files below a root.

    Files above the cap keep their row without content; a NUL byte in the first 8,000 marks a binary.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(f.sparkSession._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/")
    path = F.element_at(F.split(F.col("path"), base, 2), 2)
    is_binary = F.contains(F.substring("content", 1, 8000), F.lit(bytearray(b"\0")))
    return f.select(path.alias("path"), F.col("length").alias("size"), "content").where(~F.col("path").rlike(SKIPPED)).select(
        "path", "size", F.sha2("content", 256).alias("sha256"), language(F.col("path")).alias("language"), is_binary.alias("is_binary"),
        F.when(~is_binary & (F.col("size") <= max_bytes), F.decode("content", "UTF-8")).alias("content"),
    )


def git_log(lines: DataFrame) -> DataFrame:
    """``sha, ct, author, subject, file`` from ``git log --format=%x01%H%x02%ct%x02%ae%x02%s --name-only`` in a ``text`` column."""
    commit = lines.select(F.explode(F.split("text", "\x01")).alias("c")).where(F.trim("c") != "")
    rows = F.filter(F.split("c", "\r?\n"), lambda x: F.trim(x) != "")
    head = F.split(F.element_at(rows, 1), "\x02")
    return commit.select(rows.alias("r"), head.alias("h")).select(
        F.col("h")[0].alias("sha"), F.col("h")[1].cast("long").alias("ct"), F.lower(F.col("h")[2]).alias("author"), F.col("h")[3].alias("subject"),
        F.explode_outer(F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0)))).alias("file"),
    )


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """``file, start, count``: the new side of every hunk in unified diffs (column ``text``); a missing count is 1."""
    per_file = diffs.select(F.explode(F.split("text", r"(?m)^diff --git ")).alias("d"))
    f = per_file.select(F.regexp_extract("d", r"(?m)^\+\+\+ (?:b/)?(\S+)", 1).alias("file"), F.explode(F.regexp_extract_all("d", F.lit(r"(?m)^@@ -\S+ \+(\d+(?:,\d+)?) @@"), 1)).alias("h"))
    parts = F.split("h", ",")
    return f.where("file <> '' and file <> '/dev/null'").select(
        "file", parts[0].cast("int").alias("start"), F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).cast("int")).otherwise(1).alias("count")
    )


def lcov(reports: DataFrame) -> DataFrame:
    """``file, total, covered, ratio, covered_lines`` from lcov texts (column ``text``)."""
    rec = reports.select(F.explode(F.split("text", r"end_of_record")).alias("r"))
    d = rec.select(F.regexp_extract("r", r"(?m)^SF:(.+?)\r?$", 1).alias("file"), F.explode(F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+,\d+)"), 1)).alias("x")).where("file <> ''")
    hit = F.split("x", ",")
    lines = d.groupBy("file", hit[0].cast("int").alias("line")).agg(F.max(hit[1].cast("long")).alias("n"))
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("covered"), (F.count_if(F.col("n") > 0) / F.count(F.lit(1))).alias("ratio"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("line")))).alias("covered_lines"),
    )


_SARIF = (
    "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,baselineState:string,"
    "suppressions:array<struct<kind:string>>,partialFingerprints:map<string,string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>>>>>"
)


def sarif(logs: DataFrame) -> DataFrame:
    """``scanner, rule_id, level, message, uri, line, suppressed`` from SARIF texts (column ``text``)."""
    r = logs.select(F.explode(F.from_json("text", _SARIF)["runs"]).alias("run")).select(F.col("run.tool.driver.name").alias("scanner"), F.explode("run.results").alias("x"))
    at = F.get(F.col("x.locations"), F.lit(0))["physicalLocation"]
    return r.select(
        "scanner", F.col("x.ruleId").alias("rule_id"), F.coalesce("x.level", F.lit("warning")).alias("level"), F.col("x.message.text").alias("message"),
        at["artifactLocation"]["uri"].alias("uri"), F.coalesce(at["region"]["startLine"], F.lit(1)).alias("line"), (F.coalesce(F.size("x.suppressions"), F.lit(0)) > 0).alias("suppressed"),
    )


def manifest_deps(files: DataFrame) -> DataFrame:
    """``path, ecosystem, name, version``: dependencies of ``files(path, content)`` in package.json, requirements, go.mod and Cargo.toml."""
    name = F.element_at(F.split("path", "/"), -1)
    groups = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    entries = F.flatten(F.array(*[F.coalesce(F.map_entries(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>")) for k in groups]))
    npm = files.where(name == "package.json").select("path", F.explode(entries).alias("e")).select("path", F.col("e.key").alias("name"), F.col("e.value").alias("version"), F.lit("npm").alias("ecosystem"))

    def by_regex(which: Column, rx: str, eco: str) -> DataFrame:
        hits = F.regexp_extract_all("content", F.lit(rx), 0)
        return files.where(which).select("path", F.explode(hits).alias("x")).select(
            "path", F.regexp_extract("x", rx, 1).alias("name"), F.regexp_extract("x", rx, 2).alias("version"), F.lit(eco).alias("ecosystem"))

    py = by_regex(name.rlike(r"^requirements.*\.txt$"), r"(?m)^([A-Za-z0-9][\w.-]*)\s*==\s*([\w.!+]+)", "pypi")
    go = by_regex(name == "go.mod", r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v[\w.+-]+)", "go")
    rs = by_regex(name == "Cargo.lock", r'name = "([^"]+)"\nversion = "([^"]+)"', "cargo")
    cols = ["path", "ecosystem", "name", "version"]
    return npm.select(cols).unionByName(py.select(cols)).unionByName(go.select(cols)).unionByName(rs.select(cols)).distinct()


def sections(files: DataFrame) -> DataFrame:
    """``file_path, line, level, title, parent_line``: headings of Markdown files, each under the nearest heading above with a smaller level.

    Fenced blocks hold no headings.  The parent of a heading of level l is the latest heading of each
    smaller level; six running maxima find it without a self join.
    """
    text = F.regexp_replace("content", "\r\n", "\n")
    lines = files.where(F.lower("file_path").endswith(".md") & F.col("content").isNotNull()).select("file_path", F.posexplode(F.split(text, "\n")).alias("pos", "ln"))
    w = Window.partitionBy("file_path").orderBy("pos")
    fence = F.sum(F.col("ln").rlike(r"^\s*(```|~~~)").cast("int")).over(w)
    h = lines.withColumn("fence", fence).where((F.col("fence") % 2 == 0) & F.col("ln").rlike(r"^#{1,6}\s+\S"))
    h = h.select("file_path", (F.col("pos") + 1).alias("line"), F.length(F.regexp_extract("ln", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("ln", r"^#+\s+|\s+#+\s*$", "")).alias("title"))
    up = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.max(F.when(F.col("level") == k, F.col("line"))).over(up) for k in range(1, 6)]
    parent = F.greatest(*[F.when(F.col("level") > k, a) for k, a in zip(range(1, 6), above)], F.lit(None).cast("int"))
    return h.withColumn("parent_line", parent)


def folders(files: DataFrame) -> DataFrame:
    """``parent, child``: every folder of every path, with ``.`` as the root, once."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.when(i == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), i - 1), "/")).alias("parent"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("child")))
    return files.where("path is not null and path <> ''").select(F.explode(steps).alias("s")).select("s.*").distinct()
