"""The whole audit of a corpus: claims, registries, flags, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.operators import claims as cl
from claimstead.operators import registries as rg
from claimstead.operators.flags import with_features, with_flags
from claimstead.operators.scoring import with_verdict
from claimstead.sources.shared import durable


def with_statuses(subjects: DataFrame, responses: DataFrame) -> DataFrame:
    """subjects with claims -> the same, claims with status where the subject is to be verified.

    Only claims that have a registry leave the row: they are looked up and come back by subject and what is
    claimed, once for all rows that claim it, so that ids may repeat.
    """
    asked = cl.exploded(subjects.where("verified"), "subject_id", "subject_name").where(F.col("subtype").isin(*rg.CHECKED))
    found = rg.verify_identifiers(asked, responses).unionByName(rg.verify_institutions(asked, responses))
    found = found.groupBy("subject_id").agg(F.map_from_entries(F.collect_set(F.struct(F.struct("subject_name", "subtype", "value"), F.struct("status", "detail", "source")))).alias("_found"))
    rows = subjects.join(found, "subject_id", "left")
    said = lambda c: F.struct("subject_name", c["subtype"].alias("subtype"), c["value"].alias("value"))
    of = lambda c, field, none: F.coalesce(F.when(F.col("verified"), F.try_element_at(F.col("_found"), said(c))[field]), F.lit(none))
    marked = lambda c: c.withField("status", of(c, "status", rg.UNCHECKED)).withField("detail", of(c, "detail", "")).withField("source", of(c, "source", ""))
    return rows.withColumn("claims", F.transform("claims", marked)).drop("_found")


def audit(subjects: DataFrame, now_year: int, responses: DataFrame | None = None, banks: dict | None = None) -> DataFrame:
    """subjects (text, and what flags.OPTIONAL names) -> the same with claims, domains, flags and verdict.

    With responses the claims are extracted once and kept, unless they are there already: the lookups and the
    audit itself both read them.
    """
    rows = subjects
    if responses is not None:
        extracted = subjects if "claims" in subjects.columns else durable(cl.with_claims(subjects))
        rows = with_statuses(extracted, responses)
    return with_verdict(with_flags(with_features(rows, banks), now_year))


def summary(audited: DataFrame, target: str = "subject_name") -> DataFrame:
    """The seven columns of a batch, but for the time of the run, which is the caller's."""
    hit = F.size(F.filter("flags", lambda f: f["status"] == "TRIGGERED"))
    return audited.select(
        F.col(target).alias("target"), F.col("verdict.level").alias("level"), F.col("verdict.score").alias("score"), F.col("verdict.coverage").alias("coverage_pct"),
        cl.specificity(F.col("text")).alias("specificity"), hit.cast("long").alias("triggered_flags"),
    )
