"""Integrity rules: each is a DataFrame of its violations (rule, severity, subject, detail); a gate counts errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violation(bad: DataFrame, rule: str, subject: Column, detail: Column | str = "", severity: str = "ERROR") -> DataFrame:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return bad.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), d.cast("string").alias("detail"))


def references(rows: DataFrame, column: str, known: DataFrame, key: str, rule: str, subject: Column, severity: str = "ERROR") -> DataFrame:
    bad = rows.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return violation(bad, rule, subject, F.col(column), severity)


def domain(rows: DataFrame, column: str, allowed: list, rule: str, subject: Column, severity: str = "ERROR") -> DataFrame:
    return violation(rows.where(F.col(column).isNull() | ~F.col(column).isin(allowed)), rule, subject, F.col(column), severity)


def within(rows: DataFrame, column: str, lo, hi, rule: str, subject: Column, severity: str = "ERROR") -> DataFrame:
    return violation(rows.where(~F.col(column).between(lo, hi)), rule, subject, F.col(column), severity)


def required(rows: DataFrame, column: str, when: Column, rule: str, subject: Column, severity: str = "ERROR") -> DataFrame:
    return violation(rows.where(when & F.col(column).isNull()), rule, subject, "missing", severity)


def unique(rows: DataFrame, keys: list[str], rule: str, severity: str = "ERROR") -> DataFrame:
    bad = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return violation(bad, rule, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.col("n"), severity)


def capacity(rows: DataFrame, keys: list[str], amount: str, limit: DataFrame, limit_col: str, rule: str) -> DataFrame:
    bad = rows.groupBy(*keys).agg(F.sum(amount).alias("used")).join(limit, keys).where(F.col("used") > F.col(limit_col))
    return violation(bad, rule, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.col("used"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def passes(violations: DataFrame) -> DataFrame:
    """One row: errors, warnings, passed."""
    return violations.agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") != "ERROR").alias("warnings")).withColumn("passed", F.col("errors") == 0)


def stale(stored: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys whose stored digest isn't the current one, either missing included."""
    j = stored.select(key, F.col("digest").alias("stored")).join(current.select(key, F.col("digest").alias("now")), key, "full")
    return violation(j.where("stored is distinct from now"), "stale", F.col(key), F.coalesce("stored", F.lit("none")))


#: Media that a cable can carry between unlike jacks.
COMPATIBLE = [["audio", "cv", "gate", "clock"], ["midi", "usb"]]


def patch_warnings(cables: DataFrame, ports: DataFrame) -> DataFrame:
    """Of cables(id, from_node, from_port, to_node, to_port) and ports(node, name, dir, medium, hidden): missing or hidden jacks,
    media that don't go together, and inputs with two cables."""
    known = ports.select(F.col("node").alias("_n"), F.col("name").alias("_p"), "medium", F.coalesce("hidden", F.lit(False)).alias("hidden"))
    j = cables
    for side in ("from", "to"):
        k = known.select(F.col("_n").alias(f"{side}_node"), F.col("_p").alias(f"{side}_port"), F.col("medium").alias(f"_{side}m"), F.col("hidden").alias(f"_{side}h"))
        j = j.join(k, [f"{side}_node", f"{side}_port"], "left")
    group = lambda c: F.when(F.col(c).isin(COMPATIBLE[0]), 0).when(F.col(c).isin(COMPATIBLE[1]), 1).otherwise(F.col(c))
    parts = [violation(j.where(F.col(f"_{s}m").isNull()), "missing jack", F.col("id"), F.col(f"{s}_port"), "WARN") for s in ("from", "to")]
    parts += [violation(j.where(F.col(f"_{s}h")), "hidden jack", F.col("id"), F.col(f"{s}_port"), "WARN") for s in ("from", "to")]
    parts.append(violation(j.where((F.col("_fromm") != F.col("_tom")) & (group("_fromm").cast("string") != group("_tom").cast("string"))), "media differ", F.col("id"), F.concat_ws("-", "_fromm", "_tom"), "WARN"))
    parts.append(unique(cables, ["to_node", "to_port"], "several cables into one input", "WARN"))
    return together(parts)
