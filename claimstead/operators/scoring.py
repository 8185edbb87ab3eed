"""Coverage-aware scores: a ratio over decided flags, withheld where too little could be decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.banks import PASSED, TRIGGERED
from claimstead.operators.flags import FLAGS, flag_specs

# Levels in order of severity with the score that each stays below, and the least coverage.
LEVELS = [("GREEN", 20), ("YELLOW", 40), ("ORANGE", 65), ("RED", 101)]
NO_LEVEL, LEAST_COVERAGE = "INSUFFICIENT DATA", 0.35
TOTAL = sum(f[2] for f in FLAGS)


def level_of(score: Column) -> Column:
    return F.coalesce(*(F.when(score < cut, F.lit(name)) for name, cut in LEVELS))


def severity(level: Column) -> Column:
    """1 for the mildest level; null for none."""
    return F.nullif(F.array_position(F.array(*(F.lit(name) for name, _ in LEVELS)), level).cast("int"), F.lit(0))


def verdict(triggered: Column, decided: Column, floor: Column) -> Column:
    """struct from the weights of triggered and decided flags and the strictest floor among the triggered (or null)."""
    coverage = decided / TOTAL
    raw = F.coalesce(F.bround(F.try_divide(100 * triggered, decided)), F.lit(0)).cast("int")
    scored = coverage >= LEAST_COVERAGE
    plain = level_of(raw)
    held = severity(floor) > severity(plain)
    level = F.when(~scored, NO_LEVEL).when(held, floor).otherwise(plain)
    return F.struct(
        F.when(scored, raw).alias("score"), raw.alias("raw_score"), scored.alias("scored"), F.bround(coverage * 100).cast("int").alias("coverage"),
        level.alias("level"), F.coalesce(scored & held, F.lit(False)).alias("held"),
    )


def with_verdict(audited: DataFrame) -> DataFrame:
    """Adds `verdict` from the array of flags, without a shuffle."""
    pairs = lambda values: F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    weight = pairs({i: w for i, _, w, *_ in FLAGS})
    floors = pairs({i: floor for i, *_, floor in FLAGS if floor})

    def total(*statuses: str) -> Column:
        chosen = F.filter("flags", lambda f: f["status"].isin(*statuses))
        return F.aggregate(chosen, F.lit(0.0), lambda a, f: a + weight[f["id"]])

    hit = F.filter("flags", lambda f: f["status"] == TRIGGERED)
    strict = F.array_max(F.transform(hit, lambda f: severity(F.try_element_at(floors, f["id"]))))
    floor = F.get(F.array(*(F.lit(name) for name, _ in LEVELS)), strict - 1)
    return audited.withColumn("verdict", verdict(total(TRIGGERED), total(TRIGGERED, PASSED), floor))


def score_table(flags: DataFrame, *by: str) -> DataFrame:
    """The same from rows of flag_id and status, as one aggregation."""
    rows = flags.join(F.broadcast(flag_specs(flags.sparkSession)), "flag_id")
    hit = F.col("status") == TRIGGERED
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("weight")).otherwise(0.0)).alias("triggered_weight"),
        F.sum(F.when(F.col("status").isin(TRIGGERED, PASSED), F.col("weight")).otherwise(0.0)).alias("decided_weight"),
        F.max(F.when(hit, severity(F.col("floor")))).alias("strict"),
        F.count_if(hit).alias("n_triggered"),
        F.count_if(F.col("status").isin(TRIGGERED, PASSED)).alias("n_decided"),
    )
    floor = F.get(F.array(*(F.lit(name) for name, _ in LEVELS)), F.col("strict") - 1)
    return sums.withColumn("v", verdict(F.col("triggered_weight"), F.col("decided_weight"), floor)).select(*by, "triggered_weight", "decided_weight", "n_triggered", "n_decided", "v.*")


def category_scores(flags: DataFrame, *by: str) -> DataFrame:
    """For each category with a decided flag its own score and the number of those flags."""
    rows = flags.where(F.col("status").isin(TRIGGERED, PASSED)).join(F.broadcast(flag_specs(flags.sparkSession)), "flag_id")
    hit = F.sum(F.when(F.col("status") == TRIGGERED, F.col("weight")).otherwise(0.0))
    return rows.groupBy(*by, "category").agg(F.bround(100 * hit / F.sum("weight")).cast("int").alias("score"), F.count("*").alias("flags_decided"))


def status_counts(flags: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("TRIGGERED", "PASSED", "UNKNOWN")]
    return flags.groupBy(*by).agg(*counts)
