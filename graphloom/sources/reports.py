"""Readers of histories and reports: blame, coverage in four forms, API specifications, lockfiles, legacy sources."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.sources.readers import manifest_deps


def blame(texts: DataFrame) -> DataFrame:
    """``file_path, line, sha, author, name`` from porcelain blame per file (``file_path, text``).

    A commit tells its author only the first time; later groups take it from there.  Lines without an
    author's address give no row.
    """
    head = re.compile(r"([0-9a-f]{7,40}) \d+ (\d+)(?: \d+)?$")

    @F.pandas_udf("array<struct<line:int,sha:string,author:string,name:string>>")
    def parse(blames: pd.Series) -> pd.Series:
        out = []
        for t in blames:
            known: dict[str, list] = {}
            rows, sha, line = [], None, 0
            for ln in (t or "").split("\n"):
                if ln.startswith("\t"):
                    who = known.get(sha)
                    if who and who[1]:
                        rows.append({"line": line, "sha": sha, "author": who[1], "name": who[0]})
                    sha = None
                elif sha is None:
                    m = head.match(ln)
                    if m:
                        sha, line = m[1], int(m[2])
                        known.setdefault(sha, ["", ""])
                elif ln.startswith("author "):
                    known[sha][0] = ln[7:].rstrip("\r")
                elif ln.startswith("author-mail "):
                    known[sha][1] = ln[12:].strip().strip("<>").strip().lower()
            out.append(rows)
        return pd.Series(out)

    return texts.select("file_path", F.explode(parse("text")).alias("x")).select("file_path", "x.*")


def _covered(lines: DataFrame) -> DataFrame:
    """``file, total, covered, ratio, covered_lines`` from ``file, line, hits``; the highest count of a line decides."""
    one = lines.where("file is not null and line is not null").groupBy("file", "line").agg(F.max("hits").alias("hits"))
    hit = F.col("hits") > 0
    return one.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("covered"), (F.count_if(hit) / F.count(F.lit(1))).alias("ratio"), F.array_sort(F.collect_list(F.when(hit, F.col("line")))).alias("covered_lines")
    )


def _xml(c: str) -> Column:
    return F.regexp_replace(c, r"<!DOCTYPE[^>]*>", "")


def cobertura(reports: DataFrame) -> DataFrame:
    """Coverage per file from Cobertura texts (column ``text``)."""
    ddl = "packages struct<package:array<struct<classes:struct<class:array<struct<_filename:string,lines:struct<line:array<struct<_number:int,_hits:bigint>>>>>>>>>"
    c = reports.select(F.explode(F.from_xml(_xml("text"), ddl)["packages"]["package"]).alias("p")).select(F.explode("p.classes.class").alias("c"))
    return _covered(c.select(F.col("c._filename").alias("file"), F.explode("c.lines.line").alias("l")).select("file", F.col("l._number").alias("line"), F.col("l._hits").alias("hits")))


def jacoco(reports: DataFrame) -> DataFrame:
    """Coverage per file from JaCoCo texts: a line counts as covered if any of its instructions ran."""
    ddl = "package array<struct<_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:int,_ci:bigint>>>>>>"
    p = reports.select(F.explode(F.from_xml(_xml("text"), ddl)["package"]).alias("p")).select(F.col("p._name").alias("pkg"), F.explode("p.sourcefile").alias("s"))
    name = F.concat_ws("/", F.nullif("pkg", F.lit("")), "s._name")
    return _covered(p.select(name.alias("file"), F.explode("s.line").alias("l")).select("file", F.col("l._nr").alias("line"), F.col("l._ci").alias("hits")))


def coverage_json(reports: DataFrame) -> DataFrame:
    """Coverage per file from the JSON reports of Python's coverage tool."""
    ddl = "files map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>"
    f = reports.select(F.explode(F.from_json("text", ddl)["files"]).alias("file", "v"))
    one = lambda c, n: f.select("file", F.explode(f"v.{c}").alias("line"), F.lit(n).cast("bigint").alias("hits"))
    return _covered(one("executed_lines", 1).unionByName(one("missing_lines", 0)))


# Methods of an API specification.
METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]


def openapi(specs: DataFrame) -> DataFrame:
    """``file_path, method, path, operation_id, summary`` of each operation in JSON specifications (``file_path, content``)."""
    body = F.from_json("content", "paths map<string,map<string,string>>")["paths"]
    p = specs.select("file_path", F.explode(body).alias("path", "ops")).select("file_path", "path", F.explode("ops").alias("method", "op"))
    return p.where(F.lower("method").isin(METHODS)).select(
        "file_path", F.upper("method").alias("method"), F.regexp_replace("path", r":([A-Za-z_]\w*)", "{$1}").alias("path"),
        F.get_json_object("op", "$.operationId").alias("operation_id"), F.get_json_object("op", "$.summary").alias("summary"),
    ).distinct()


_LOCKS = {"npm": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml"), "cargo": ("Cargo.lock",)}


def lock_deps(files: DataFrame) -> DataFrame:
    """``path, ecosystem, name, version`` of the lockfiles of npm, yarn and pnpm, and of Maven and NuGet project files."""
    last = F.element_at(F.split("path", "/"), -1)
    text = F.regexp_replace("content", "\r\n", "\n")
    cols = ["path", "ecosystem", "name", "version"]
    pk = F.from_json("content", "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>")
    lock = files.where(last == "package-lock.json").select("path", pk.alias("p"))
    v3 = lock.select("path", F.explode("p.packages").alias("k", "v")).where("k <> ''").select("path", F.regexp_replace("k", r"^.*node_modules/", "").alias("name"), "v.version")
    v1 = lock.where("p.packages is null").select("path", F.explode("p.dependencies").alias("name", "v")).select("path", "name", "v.version")

    def by_regex(which: Column, rx: str) -> DataFrame:
        return files.where(which).select("path", F.explode(F.regexp_extract_all(text, F.lit(rx), 0)).alias("x")).select("path", F.regexp_extract("x", rx, 1).alias("name"), F.regexp_extract("x", rx, 2).alias("version"))

    yarn = by_regex(last == "yarn.lock", r'(?m)^"?(@?[^@"\s]+)@[^\n]*:\n  version:? "?([^"\n]+)"?')
    pnpm = by_regex(last == "pnpm-lock.yaml", r"(?m)^  '?/?(@?[^@'(\s:]+)@([\w.+-]+)[^:\n]*:\s*$")
    pom = F.from_xml(_xml("content"), "dependencies struct<dependency:array<struct<groupId:string,artifactId:string,version:string>>>")
    maven = files.where(last == "pom.xml").select("path", F.explode(pom["dependencies"]["dependency"]).alias("d")).select("path", F.concat_ws(":", "d.groupId", "d.artifactId").alias("name"), "d.version")
    nuget = by_regex(last.rlike(r"\.(?:cs|fs|vb)proj$"), r'<PackageReference\s+Include="([^"]+)"\s+Version="([^"]+)"')
    out = None
    for df, eco in ((v3, "npm"), (v1, "npm"), (yarn, "npm"), (pnpm, "npm"), (maven, "maven"), (nuget, "nuget")):
        got = df.withColumn("ecosystem", F.lit(eco)).select(cols)
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of ``files(path, content)``; a manifest next to a lockfile of its ecosystem is left out, as the lockfile tells more."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    locks = lock_deps(files)
    name = F.element_at(F.split("path", "/"), -1)
    locked = None
    for eco, names in _LOCKS.items():
        got = files.where(name.isin(*names)).select(folder.alias("dir"), F.lit(eco).alias("ecosystem")).distinct()
        locked = got if locked is None else locked.unionByName(got)
    is_manifest = name == "package.json"
    told = manifest_deps(files).withColumn("dir", folder)
    kept = told.where(is_manifest).join(locked, ["dir", "ecosystem"], "left_anti").select("path", "ecosystem", "name", "version").unionByName(told.where(~is_manifest).drop("dir"))
    return kept.unionByName(locks).distinct()


def cobol(files: DataFrame) -> DataFrame:
    """``file_path, what, name, type, confidence``: programs, sections and paragraphs (DEFINES 0.6), and copybooks (IMPORTS 0.8) of COBOL sources."""
    text = F.regexp_replace(F.upper("content"), "\r\n", "\n")
    code = F.regexp_replace(text, r"(?m)^.{6}\*[^\n]*$", "")  # comment lines
    src = files.where(F.lower("file_path").rlike(r"\.(?:cbl|cob|cobol|cpy)$")).select("file_path", code.alias("t"))
    pick = lambda rx, what, type_, conf: src.select("file_path", F.lit(what).alias("what"), F.explode(F.regexp_extract_all("t", F.lit(rx), 1)).alias("name"), F.lit(type_).alias("type"), F.lit(conf).alias("confidence"))
    return (
        pick(r"PROGRAM-ID\.\s+([A-Z0-9][A-Z0-9-]*)", "program", "DEFINES", 0.6)
        .unionByName(pick(r"(?m)^.{7}([A-Z0-9][A-Z0-9-]*)\s+SECTION\s*\.", "section", "DEFINES", 0.6))
        .unionByName(pick(r"(?m)^.{7}([A-Z0-9][A-Z0-9-]*)\s*\.\s*$", "paragraph", "DEFINES", 0.6))
        .unionByName(pick(r"\bCOPY\s+['\"]?([A-Z0-9][A-Z0-9-]*)", "copybook", "IMPORTS", 0.8))
        .distinct()
    )


def frameworks(rules: list[tuple[str, str, str, str]], deps: DataFrame, paths: DataFrame) -> DataFrame:
    """``repo_uri, framework, evidence``: what a catalogue of ``(framework, ecosystem, stage, pattern)`` finds in each repository.

    ``manifest`` rules name a dependency (``deps(repo_uri, ecosystem, name)``), ``file`` rules match a path
    (``paths(repo_uri, path)``) and count only where their ecosystem has a dependency; an ecosystem ``*``
    always counts.  Each (stage, source) is evidence once.  The catalogue is a list in the program, so a
    path meets its rules in one pass, without a join.
    """
    spark = paths.sparkSession
    by_name = spark.createDataFrame([(f, e, p) for f, e, s, p in rules if s == "manifest"] or [(None, None, None)], "framework string, ecosystem string, name string").where("framework is not null")
    named = deps.join(F.broadcast(by_name), ["ecosystem", "name"]).select("repo_uri", "framework", F.concat(F.lit("manifest:"), "name").alias("e"))
    marks = F.array(*[F.when(F.col("path").rlike(p), F.struct(F.lit(f).alias("framework"), F.lit(e).alias("ecosystem"))) for f, e, s, p in rules if s == "file"] or [F.lit(None).cast("struct<framework:string,ecosystem:string>")])
    seen = paths.select("repo_uri", "path", F.explode(marks).alias("m")).where("m is not null").select("repo_uri", "m.framework", "m.ecosystem", F.concat(F.lit("file:"), "path").alias("e"))
    active = deps.select("repo_uri", "ecosystem").distinct()
    filed = seen.where("ecosystem = '*'").select("repo_uri", "framework", "e").unionByName(seen.join(active, ["repo_uri", "ecosystem"], "left_semi").select("repo_uri", "framework", "e"))
    return named.unionByName(filed).groupBy("repo_uri", "framework").agg(F.array_sort(F.collect_set("e")).alias("evidence"))
