"""Contracts between repositories: what they offer and use, read from source, and how the two meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import norm_path, norm_topic

# Forms of routes, calls and topics in source, by language; (type, pattern, group of the method or None, group of the path).
_VERB = "get|post|put|delete|patch|head|options"
FORMS = {
    "js": [
        ("http_route", rf"(?:\b|\.)(?:{_VERB})\s*\(\s*['\"`][^'\"`]+['\"`]"),
        ("http_call", r"\bfetch\s*\(\s*['\"`][^'\"`]+['\"`](?:\s*,\s*\{[^}]*\})?"),
        ("http_call", rf"\baxios\.(?:{_VERB})\s*\(\s*['\"`][^'\"`]+['\"`]"),
        ("topic_producer", r"\b(?:producer)\.send\s*\(\s*\{[^}]*topic\s*:\s*['\"`][^'\"`]+['\"`]"),
        ("topic_consumer", r"\b(?:consumer)\.subscribe\s*\(\s*\{[^}]*topic\s*:\s*['\"`][^'\"`]+['\"`]"),
    ],
    "py": [
        ("http_route", rf"@\s*[A-Za-z_]\w*\.(?:{_VERB}|route)\s*\(\s*['\"][^'\"]+['\"](?:\s*,\s*methods\s*=\s*\[[^\]]+\])?"),
        ("http_call", rf"\brequests\.(?:{_VERB})\s*\(\s*['\"][^'\"]+['\"]"),
        ("topic_producer", r"\bproducer\.send\s*\(\s*['\"][^'\"]+['\"]"),
        ("topic_consumer", r"\bconsumer\.subscribe\s*\(\s*(?:topics\s*=\s*)?\[\s*['\"][^'\"]+['\"]"),
    ],
    "proto": [("grpc_service", r"\bservice\s+\w+")],
}
LANGUAGES = {"js": ["js", "jsx", "ts", "tsx", "mjs", "cjs"], "py": ["py"], "proto": ["proto"]}


def extract(files: DataFrame) -> DataFrame:
    """``type, signature, repo_uri, file_path, line``: the contracts that a file's text shows, each once.

    ``files(file_path, repo_uri, content)``.  The whole text is searched, a form may run over lines; the
    line is that on which it begins.  Everything stays inside the engine's own regular expressions.
    """
    ext = F.lower(F.element_at(F.split("file_path", r"\."), -1))
    src = files.where("content is not null and file_path is not null").select("file_path", "repo_uri", "content", ext.alias("ext"))
    out = None
    for lang, forms in FORMS.items():
        mine = src.where(F.col("ext").isin(LANGUAGES[lang]))
        for kind, rx in forms:
            # what stands before each match gives its line: the text is cut at the matches
            hit = mine.where(F.col("content").rlike(rx)).select(
                "file_path", "repo_uri", F.posexplode(F.regexp_extract_all("content", F.lit(f"({rx})"), 1)).alias("i", "m"), F.split("content", rx).alias("gaps"), F.regexp_extract_all("content", F.lit(f"({rx})"), 1).alias("all")
            )
            before = F.concat(F.array_join(F.slice("gaps", F.lit(1), F.col("i") + 1), ""), F.array_join(F.slice("all", F.lit(1), F.col("i")), ""))
            line = F.size(F.split(before, "\n"))
            value = F.regexp_extract("m", r"['\"`]([^'\"`]+)['\"`]", 1)
            if kind.startswith("http"):
                told = F.regexp_extract("m", r"method\s*:\s*['\"`]([A-Za-z]+)['\"`]", 1)
                verb = F.regexp_extract("m", rf"\b({_VERB})\s*\(", 1)
                listed = F.regexp_extract_all(F.regexp_extract("m", r"methods\s*=\s*\[([^\]]+)\]", 1), F.lit(r"(\w+)"), 1)
                method = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.when(told != "", told).when(verb != "", verb).otherwise("GET")))
                hit = hit.select("file_path", "repo_uri", line.alias("line"), value.alias("v"), F.explode(method).alias("method"))
                sig = F.concat(F.upper("method"), F.lit(" "), norm_path(F.trim("v")))
            else:
                hit = hit.select("file_path", "repo_uri", line.alias("line"), (value if kind != "grpc_service" else F.regexp_extract("m", r"service\s+(\w+)", 1)).alias("v"))
                sig = norm_topic(F.trim("v")) if kind.startswith("topic") else F.col("v")
            got = hit.select(F.lit(kind).alias("type"), sig.alias("signature"), "repo_uri", "file_path", "line")
            out = got if out is None else out.unionByName(got)
    return out.distinct()


PRODUCERS = {"http_route": "http", "grpc_service": "grpc", "topic_producer": "topic"}
CONSUMERS = {"http_call": "http", "grpc_client": "grpc", "topic_consumer": "topic"}
_SIDE = ["repo_uri", "file_path", "line", "signature"]


def _side(contracts: DataFrame, kinds: dict[str, str], p: str) -> DataFrame:
    family = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])[F.col("type")]
    return contracts.where(F.col("type").isin(list(kinds))).select(family.alias("family"), *[F.col(c).alias(f"{p}_{c}") for c in _SIDE])


def cross_links(contracts: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Producers with the consumers of other repositories that use them, by signature or by a manifest's word.

    HTTP and topic signatures must be equal; a gRPC consumer may name one part of the producer's, split at
    ``.`` and ``/``, so producers are joined once per part and no family is crossed.  ``manifest(family,
    producer_repo, consumer_repo, contract)`` links what holds its contract; a signature beats it.  Each
    pair of places counts once.
    """
    p, c = _side(contracts, PRODUCERS, "p"), _side(contracts, CONSUMERS, "c")
    parts = F.when(F.col("family") == "grpc", F.array_union(F.array("p_signature"), F.split("p_signature", "[./]"))).otherwise(F.array("p_signature"))
    keyed = p.select("*", F.explode(parts).alias("key")).where("key <> ''")
    signed = keyed.join(c.withColumn("key", F.col("c_signature")), ["family", "key"]).where("p_repo_uri <> c_repo_uri").drop("key").withColumn("reason", F.lit("signature"))
    if manifest is not None:
        m = F.broadcast(manifest)
        ps = p.join(m, (p["family"] == m["family"]) & (p["p_repo_uri"] == m["producer_repo"]) & p["p_signature"].contains(m["contract"])).select(p["*"], "consumer_repo", "contract")
        told = ps.join(c, (ps["family"] == c["family"]) & (ps["consumer_repo"] == c["c_repo_uri"]) & c["c_signature"].contains(ps["contract"])).select(
            ps["family"], *[ps[f"p_{x}"] for x in _SIDE], *[c[f"c_{x}"] for x in _SIDE], F.lit("manifest").alias("reason")
        )
        signed = signed.unionByName(told)
    places = ["p_repo_uri", "p_file_path", "p_line", "c_repo_uri", "c_file_path", "c_line"]
    return signed.groupBy(*places).agg(F.min(F.struct(F.when(F.col("reason") == "signature", 0).otherwise(1).alias("o"), "family", "p_signature", "c_signature", "reason")).alias("b")).select(
        *places, "b.family", "b.p_signature", "b.c_signature", "b.reason"
    )


def fetched_routes(fetches: DataFrame, routes: DataFrame) -> DataFrame:
    """``consumer, route, consumer_repo, route_repo``: calls that meet a route of another repository by method and path.

    ``fetches(id, repo_uri, method, url)``, ``routes(id, repo_uri, method, url)``.
    """
    f = fetches.select(F.col("id").alias("consumer"), F.col("repo_uri").alias("consumer_repo"), F.upper("method").alias("m"), norm_path(F.col("url")).alias("u"))
    r = routes.select(F.col("id").alias("route"), F.col("repo_uri").alias("route_repo"), F.upper("method").alias("m"), norm_path(F.col("url")).alias("u"))
    return f.join(r, ["m", "u"]).where("consumer_repo <> route_repo").select("consumer", "route", "consumer_repo", "route_repo")


def matched_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``call_id, target, confidence``: the first route by id with the call's method and path, else a placeholder."""
    key = [F.upper("method").alias("m"), norm_path(F.col("url")).alias("u")]
    r = routes.select(F.col("id").alias("route"), *key).groupBy("m", "u").agg(F.min("route").alias("route"))
    j = calls.select(F.col("id").alias("call_id"), *key).join(r, ["m", "u"], "left")
    return j.select("call_id", F.coalesce("route", F.concat(F.lit("<unresolved>:"), "m", F.lit(" "), "u")).alias("target"), F.when(F.col("route").isNull(), 0.5).otherwise(0.8).alias("confidence"))


def first_handlers(routes: DataFrame) -> DataFrame:
    """``id, file_path, type, confidence, n_alike``: HANDLES_ROUTE from the file; how many files hold the same method and path."""
    rid = F.concat(F.lit("Route:"), "file_path", F.lit(":"), F.coalesce(F.upper("method"), F.lit("ANY")), F.lit(" "), norm_path(F.col("url")))
    r = routes.select(rid.alias("id"), "file_path", F.coalesce(F.upper("method"), F.lit("ANY")).alias("m"), norm_path(F.col("url")).alias("u")).distinct()
    alike = r.groupBy("m", "u").agg(F.count_distinct("file_path").alias("n_alike"))
    return r.join(alike, ["m", "u"]).select("id", "file_path", F.lit("HANDLES_ROUTE").alias("type"), F.lit(0.9).alias("confidence"), "n_alike")

