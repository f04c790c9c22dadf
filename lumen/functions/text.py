"""Scalar functions on strings as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """Last component; both separators count."""
    return F.regexp_extract(path, "([^/\\\\]+)$", 1)


def stem(path: Column) -> Column:
    """Basename without its last extension (a leading dot is none), trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(basename(path), "(?<=.)\\.[^.]*$", "")))


def clean_text(text: Column) -> Column:
    """White space collapsed to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The pair in canonical order, by lower-case basenames."""
    a, b = F.lower(basename(a)), F.lower(basename(b))
    return F.least(a, b), F.greatest(a, b)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(",", a, b)


def as_count(x: Column) -> Column:
    """Numbers are truncated, anything else is 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0)).cast("int")


def split_list(text: Column) -> Column:
    """Comma-separated parts, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def dimensions(width: Column, height: Column) -> Column:
    """"WxH", or empty if either is missing."""
    return F.coalesce(F.concat(width.cast("string"), F.lit("x"), height.cast("string")), F.lit(""))


def width_height(text: Column) -> Column:
    parts = F.split(text, "x")
    return F.when(F.size(parts) == 2, F.struct(parts[0].cast("int").alias("w"), parts[1].cast("int").alias("h")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, although lambdas inside refer to it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "\\s+"), lambda t: t != "")


def token_overlap(candidate: Column, reference: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of greedy token matching with one-hot token vectors (the provider without a model)."""

    def scores(s: Column) -> Column:
        a, b = s["a"], s["b"]
        p = F.coalesce(F.try_divide(F.size(F.filter(a, lambda t: F.array_contains(b, t))), F.size(a)), F.lit(0.0))
        r = F.coalesce(F.try_divide(F.size(F.filter(b, lambda t: F.array_contains(a, t))), F.size(b)), F.lit(0.0))
        return F.struct(p.alias("p"), r.alias("r"))

    both = bound(F.struct(tokens(candidate).alias("a"), tokens(reference).alias("b")), scores)
    p, r = both["p"], both["r"]
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def hashed_vector(text: Column, size: int = 64) -> Column:
    """Signed counts of the words by the hash of each (the sentence vector without a model); no words: no vector."""
    number = lambda w, at, n: F.conv(F.substring(F.md5(w), at, n), 16, 10).cast("int")
    cells = F.transform(tokens(text), lambda w: F.struct((number(w, 1, 4) % size).alias("at"), F.when(number(w, 5, 1) >= 8, 1.0).otherwise(-1.0).alias("x")))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    return bound(cells, lambda cs: F.when(F.size(cs) > 0, F.transform(places, lambda k: F.aggregate(F.filter(cs, lambda c: c["at"] == k), F.lit(0.0), lambda s, c: s + c["x"]))))
