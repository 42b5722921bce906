"""Text, hash, path and estimate functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens; a lower-to-upper step inside a word splits it."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z0-9]+"), 0)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def short_hash(text: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def module_name(path: Column) -> Column:
    """pkg/mod.py -> pkg.mod; a package's own file names the package."""
    return F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def short_path(path: Column, n: int = 3) -> Column:
    parts = F.split(path, "/")
    return F.concat_ws("/", F.when(F.size(parts) > n, F.slice(parts, -n, n)).otherwise(parts))


def squeeze(text: Column, limit: int = 800) -> Column:
    """White space collapsed; cut at ``limit`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("..."))).otherwise(t)


def savings(used: Column, base: Column) -> Column:
    """1 - used / base; 0 without a base."""
    return F.coalesce(1 - used / F.nullif(base, F.lit(0).cast("double")), F.lit(0.0))


def ratio(used: Column, base: Column) -> Column:
    """base / used; 0 without a base, infinite when nothing was used."""
    return F.when(base <= 0, 0.0).when(used <= 0, F.lit(float("inf"))).otherwise(base / used)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hex64(ref: Column) -> Column:
    """The object hash of a blob reference, or null."""
    h = F.regexp_extract(ref, r"^(?:vhs://)?([0-9a-f]{64})$", 1)
    return F.when(h != "", h)
