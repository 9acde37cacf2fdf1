"""Scalar functions as column expressions: paths, topics, licences, tests, rounding, identities."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licence tiers, tried in this order.
LICENSE_TIERS = [
    ("strong-copyleft", r"(^|\b)(AGPL|GPL)(-|$)"),
    ("weak-copyleft", r"(^|\b)(LGPL|MPL|EPL|CDDL|CC-BY-SA)(-|$)"),
    ("permissive", r"(^|\b)(MIT(\b|-|$)|APACHE(-|$)|BSD(-|$)|ISC(\b|-|$)|0BSD(\b|$)|UNLICENSE(\b|$)|CC0(\b|-|$)|ZLIB(\b|$))"),
    ("proprietary", r"(^|\b)(PROPRIETARY|COMMERCIAL|SEE LICENSE)(\b|$)"),
]
COPYLEFT = r"^(GPL|AGPL|SSPL|EUPL|CPAL|OSL|RPL)"
# Path segments of tests.
TEST_SEGMENTS = ["test", "tests", "spec", "specs", "__tests__"]
# Reasons of edges that an indexer confirmed begin so.
CONFIRMED_PREFIX = "scip:"


def round_up(c: Column, digits: int) -> Column:
    """Half is rounded towards plus infinity, at any sign."""
    k = 10**digits
    return F.floor(c * F.lit(float(k)) + F.lit(0.5)) / F.lit(float(k))


def is_test_path(p: Column) -> Column:
    low = F.lower(p)
    parts = F.split(low, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(s) for s in TEST_SEGMENTS])) | low.contains(".test.") | low.contains(".spec.")


def license_tier(c: Column) -> Column:
    up = F.upper(F.trim(c))
    out = F.when(c.isNull() | (F.trim(c) == ""), F.lit("unknown"))
    for tier, rx in LICENSE_TIERS:
        out = out.when(up.rlike(rx), F.lit(tier))
    return out.otherwise(F.lit("unknown"))


def norm_path(c: Column, root: str = "/", lead: bool = True) -> Column:
    """An HTTP path without query, with ``:id`` as ``{id}`` and no slash at its end."""
    s = F.regexp_replace(c, r"[?#].*$", "")
    s = F.regexp_replace(s, r":([A-Za-z_]\w*)", "{$1}")
    s = F.regexp_replace(s, r"/+$", "")
    if lead:
        s = F.when(s.startswith("/") | (s == ""), s).otherwise(F.concat(F.lit("/"), s))
    return F.when(s == "", F.lit(root)).otherwise(s)


def norm_topic(c: Column) -> Column:
    """The last part of an ARN, or the last segment of a URL."""
    return F.when(c.startswith("arn:"), F.element_at(F.split(c, ":"), -1)).when(
        c.contains("/"), F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    ).otherwise(c)


def node_id(kind: Column, path: Column, qualified: Column, arity: Column) -> Column:
    return F.concat(kind, F.lit(":"), path, F.lit(":"), qualified, F.when(arity.isNotNull(), F.concat(F.lit("#"), arity.cast("string"))).otherwise(F.lit("")))


def edge_id(src: Column, type_: Column, dst: Column, step: Column) -> Column:
    return F.concat(src, F.lit("->"), type_, F.lit("->"), dst, F.lit(":"), F.coalesce(step, F.lit(0)).cast("string"))


def short_hash(c: Column, n: int = 6) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def iso(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def name_words(c: Column) -> Column:
    """The lower-case words of an identifier: split at case changes and separators."""
    s = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(s, r"[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


def glob_regex(glob: str, braces: bool = True) -> str:
    """A glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` do not; ``{a,b}`` is a choice if ``braces``."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif braces and glob[i] == "{" and "}" in glob[i:]:
            j = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1:j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"
