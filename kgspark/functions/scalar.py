"""Scalar expressions whose exact meaning matters to results, on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole, rounded half to even; null without a whole or where it is zero."""
    return F.bround(F.try_divide(F.lit(100.0) * part, whole), 0)


def either(*values: Column) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def path(url: Column) -> Column:
    """The decoded path of a URL."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("PATH")))


def route(path_: Column) -> Column:
    """A route with its inserted values written ':id' and without slashes at its ends."""
    return F.regexp_replace(F.regexp_replace(path_, r"\$\{[^}]*\}", ":id"), "^/+|/+$", "")


def bucket(text: Column, n: int) -> Column:
    """A stable number below n for a text."""
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint") % n


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of a row's columns as JSON with sorted keys, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def whole_or_real(value: Column) -> Column:
    """A double as text: whole ones without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))


def clamp(value: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def day(text: Column) -> Column:
    """The date that a text starts with, as 2025-01-02; null where it doesn't start with one."""
    return F.date_format(F.left(F.trim(text), F.lit(10)).try_cast("date"), "yyyy-MM-dd")
