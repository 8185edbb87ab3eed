"""What is audited besides plain text: names with the answers of providers, profile pages, pasted profiles, profile records.

Each gives rows of subject_id, subject_name, text, source_urls and signals, ready for audit().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.operators import paste as ps
from claimstead.operators import profiles as pf
from claimstead.operators import providers as pv
from claimstead.sources.shared import durable

_NO_URLS = "CAST(array() AS array<string>)"


def _ordered(rows: DataFrame, name: str, value: str) -> DataFrame:
    """subject_id and an array of distinct values in order of place."""
    first = rows.groupBy("subject_id", value).agg(F.min("place").alias("place"))
    listed = F.array_sort(F.collect_list(F.struct("place", value)))
    return first.groupBy("subject_id").agg(F.transform(listed, lambda x: x[value]).alias(name))


def from_web(subjects: DataFrame, answers: DataFrame, all_urls: bool = False) -> DataFrame:
    """subjects (subject_id, subject_name) and provider answers -> what is about each subject, with its signals.

    all_urls: the sources are all addresses found, not only those about the subject.
    """
    found = durable(pv.gather(answers))
    alex = pv.openalex_signal(answers).select("subject_id", F.col("works").alias("openalex_works"), F.when(F.col("ambiguous"), F.col("matches").cast("int")).alias("ambiguous_identity"))
    failed = answers.where("body is null").groupBy("subject_id").agg(F.array_sort(F.collect_set("provider")).alias("providers_failed"))
    shared = pv.shared_name_evidence(found).groupBy("subject_id").agg(F.array_sort(F.collect_set("reason")).alias("shared_name"))
    parts = [
        pv.corpus(found), _ordered(pv.urls(found, used=not all_urls), "source_urls", "url"), _ordered(found.where("provider = 'wikipedia' and about_subject"), "wikipedia_about", "title"),
        alex, pv.health(answers).select("subject_id", "search_ok"), failed, shared, pv.discarded(found).groupBy("subject_id").agg(F.count("*").alias("n_discarded")),
    ]
    rows = reduce(lambda a, b: a.join(b, "subject_id", "left"), parts, subjects.select("subject_id", "subject_name"))
    none = lambda c: F.coalesce(c, F.expr(_NO_URLS)).alias(c)
    return rows.select("subject_id", "subject_name", F.coalesce("text", F.lit("")).alias("text"), none("source_urls"), none("wikipedia_about"), "openalex_works", "ambiguous_identity", F.coalesce("search_ok", F.lit(False)).alias("search_ok"), none("providers_failed"), none("shared_name"), "n_discarded")


def _pasted(text: Column, prose: Column) -> Column:
    return F.when(ps.is_paste(text), prose).otherwise(text)


def from_pastes(subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    """subjects with text: a pasted profile page is read as a profile, and its name serves where there is none; other texts stay."""
    some = subjects.where(ps.is_paste(F.col("text")))
    read = ps.parsed(some, key).select(key, ps.prose(F.col("profile")).alias("_prose"), F.col("profile.name").alias("_name"))
    rows = subjects.join(read, key, "left")
    return rows.withColumns({"text": F.coalesce("_prose", "text"), "subject_name": F.coalesce(F.nullif("subject_name", F.lit("")), F.nullif("_name", F.lit("")))}).drop("_prose", "_name")


def from_urls(refs: DataFrame, bodies: DataFrame) -> DataFrame:
    """refs (subject_id, subject_name, url, text: pasted besides) and bodies (url, body) -> subjects anchored to their profile.

    Addresses that are no profile are left out; an address without a body counts as out of reach.
    """
    rows = refs.withColumn("r", pf.profile_ref(F.col("url"))).where("r.platform is not null").select("subject_id", "subject_name", F.col("text").alias("pasted"), "r.platform", "r.handle", "r.url")
    read = pf.read_profiles(rows.join(bodies.select("url", "body"), "url", "left"))
    said = F.nullif(F.col("subject_name"), F.lit(""))
    name = F.coalesce(said, F.nullif(F.col("name"), F.lit("")), pf.name_from_handle(F.col("handle")))
    text = F.array_join(F.filter(F.array(F.coalesce("text", F.lit("")), F.coalesce("pasted", F.lit(""))), lambda x: x != ""), "\n")
    return read.select("subject_id", name.alias("subject_name"), text.alias("text"), F.array("url").alias("source_urls"), F.concat("platform", F.lit(":"), "handle").alias("profile_anchor"), F.col("reachable").alias("profile_reachable"))


def from_records(profiles: DataFrame) -> DataFrame:
    """profiles (subject_id, profile) -> subjects with the profile in prose."""
    return profiles.select("subject_id", F.col("profile.name").alias("subject_name"), ps.prose(F.col("profile")).alias("text"))
