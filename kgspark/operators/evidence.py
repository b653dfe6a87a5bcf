"""Values with several sources: resolution, agreement, support, weakest status, attestation, load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses from the strongest to the weakest.
STATUS_RANK = ["confirmed", "single", "override", "inferred", "missing", "conflict"]


def resolve(evidence: DataFrame, keys: list[str], wanted: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """keys, value, status for evidence(keys..., value), one row a source.

    An override (keys..., value, and a status where it has one of its own) wins, a null value too. No source: missing. One distinct value: confirmed with two sources or more, else
    single. Otherwise conflict: the value of a strict majority of sources, else the largest, which errs to the safe side.
    """
    per = evidence.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    whole = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max("value").alias("most"), F.max(F.struct("n", "value")).alias("top"))
    value = F.when((F.col("kinds") > 1) & (F.col("top.n") * 2 > F.col("n")), F.col("top.value")).otherwise(F.col("most"))
    status = F.when(F.col("kinds") > 1, "conflict").when(F.col("n") > 1, "confirmed").otherwise("single")
    out = whole.select(*keys, value.alias("value"), status.alias("status"))
    if wanted is not None:
        out = wanted.select(*keys).distinct().join(out, keys, "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    if overrides is not None:
        own = F.col("status") if "status" in overrides.columns else F.lit(None).cast("string")
        o = overrides.groupBy(*keys).agg(F.min(F.struct(F.coalesce(own, F.lit("override")).alias("s"), F.col("value").alias("v"))).alias("_o"))
        won = F.col("_o").isNotNull()
        out = out.join(o, keys, "full").select(*keys, F.when(won, F.col("_o.v")).otherwise(F.col("value")).alias("value"), F.when(won, F.col("_o.s")).otherwise(F.col("status")).alias("status"))
    return out


def agreement(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: none, single (one source), agree or DISAGREE, over raw values."""
    g = evidence.groupBy(*keys).agg(F.count("value").alias("n"), F.count_distinct("value").alias("kinds"))
    return g.select(*keys, F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "single").when(F.col("kinds") == 1, "agree").otherwise("DISAGREE").alias("status"))


def status_rank(status: Column) -> Column:
    ladder = F.when(status == STATUS_RANK[0], 0)
    for i, s in enumerate(STATUS_RANK[1:], 1):
        ladder = ladder.when(status == s, i)
    return ladder


def worst_status(resolved: DataFrame, keys: list[str], absent: Column | None = None) -> DataFrame:
    """keys, worst, n_confirmed over a group's fields. Where `absent` holds, a missing field doesn't count for the worst; null if
    nothing else is left."""
    names = F.array(*map(F.lit, STATUS_RANK))
    rank = status_rank(F.col("status"))
    if absent is not None:
        rank = F.when(~((F.col("status") == "missing") & F.coalesce(absent, F.lit(False))), rank)
    return resolved.groupBy(*keys).agg(F.get(names, F.max(rank)).alias("worst"), F.count_if(F.col("status") == "confirmed").alias("n_confirmed"))


def support(specs: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, support: 0, the tier of a single source, or 2+, specs without any source included."""
    per = sources.groupBy(*keys).agg(F.count("*").alias("n"), F.min("tier").alias("tier"))
    j = specs.select(*keys).distinct().join(per, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select(*keys, "n", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, F.concat(F.lit("one "), "tier")).otherwise("two or more").alias("support"))


def attest(specs: DataFrame, rules: DataFrame, id_cols: list[str]) -> DataFrame:
    """specs(field, status, role, ...) with the id of the first rule(rule_ord, id, fields, statuses, roles) that fits."""
    fits = F.array_contains("fields", F.col("field")) & F.array_contains("statuses", F.col("status")) & F.array_contains("roles", F.col("role"))
    hit = specs.join(rules, fits).groupBy(*id_cols).agg(F.min(F.struct("rule_ord", "id")).alias("_r")).select(*id_cols, F.col("_r.id").alias("attested"))
    return specs.join(hit, id_cols, "left")


def load(draws: DataFrame, capacity: DataFrame, keys: list[str]) -> DataFrame:
    """keys, modules, draw, n_missing, n_attested, capacity, pct for every key of capacity(keys..., capacity).

    draws(keys..., draw, attested): a null draw is unknown, neither zero nor left out: it is counted in n_missing. pct is
    rounded half to even, null without a capacity. Keys that nothing draws from still have a row.
    """
    d = draws.groupBy(*keys).agg(F.count("*").alias("modules"), F.sum("draw").alias("draw"), F.count_if(F.col("draw").isNull()).alias("n_missing"), F.count_if(F.col("attested")).alias("n_attested"))
    j = capacity.join(d, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    draw = F.coalesce("draw", F.lit(0.0))
    return j.select(*keys, zero("modules").alias("modules"), draw.alias("draw"), zero("n_missing").alias("n_missing"), zero("n_attested").alias("n_attested"), "capacity", F.bround(F.try_divide(F.lit(100.0) * draw, F.col("capacity")), 0).alias("pct"))
