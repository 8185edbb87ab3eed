"""The thirteen flags, each TRIGGERED, PASSED or UNKNOWN, as one array column of a subject's row.

No flag aggregates over rows, so auditing a corpus needs no shuffle beyond that of the registry lookups,
and the same projection serves a stream.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimstead.functions.banks import BANKS, PASSED, TRIGGERED, UNKNOWN
from claimstead.functions.terms import find_many, find_non_overlapping, find_terms, terms_of, word_count
from claimstead.functions.text import host_matches
from claimstead.operators import claims as cl
from claimstead.operators import domains as dm
from claimstead.operators.names import fold, tokens

# Id, name, weight, category, level that a triggered flag holds the verdict at.
FLAGS = [
    (1, "Education ≠ Claimed Domain", 1.5, "credentials", None),
    (2, "Experience ≠ Declared Title", 1.5, "credentials", None),
    (3, "Self-Referential Partners", 2.0, "relationships", None),
    (4, "Buzzword Density", 1.0, "rhetoric", None),
    (5, "Vague Partnerships Only", 1.0, "relationships", None),
    (6, "No Verifiable Output", 1.5, "track record", None),
    (7, "Fundraising Without Traction", 1.5, "track record", None),
    (8, "Unverifiable Credentials", 1.0, "credentials", None),
    (9, "Logo Wall Syndrome", 1.0, "relationships", None),
    (10, "No Independent Validation", 1.0, "validation", None),
    (11, "Contradicted Verifiable Claim", 2.5, "track record", "ORANGE"),
    (12, "Timeline Implausibility", 1.5, "credentials", None),
    (13, "Self-Applied Doctoral Title Without a Matching Credential", 1.5, "credentials", None),
]
# Honorifics beside a name, degrees that are doctorates.
HONORIFIC = r"(?U)(?<!\w)(?:Professor|Prof|Dr)\.?(?=\s)(?=([^\n]{0,60}))"
DOCTORATE = r"(?iU)\bDoctor\s+of\s+(?:Medicine|Education|Business Administration|Psychology|Philosophy)\b"
DOCTORATE_DEGREES = "phd|ph\\.d|doctorate|doctor"

#: Columns of an audit's input that may be left out, and what stands for them.
OPTIONAL = {
    "subject_name": "CAST(NULL AS STRING)",
    "source_urls": "CAST(array() AS array<string>)",
    "verified": "false",
    "openalex_works": "CAST(NULL AS INT)",
    "wikipedia_about": "CAST(array() AS array<string>)",
    "search_ok": "CAST(NULL AS BOOLEAN)",
}


@F.pandas_udf(T.BooleanType())
def _addressed(name: pd.Series, tails: pd.Series) -> pd.Series:
    """Whether one of the texts after an honorific has a word of the name; null where the name has no telling word."""

    def one(n: str | None, texts) -> bool | None:
        own = tokens(n)
        return any(own & set(re.findall(r"\w+", fold(t))) for t in texts) if own else None

    return pd.Series([one(n, t) for n, t in zip(name, tails, strict=True)], dtype="object")


def with_defaults(subjects: DataFrame) -> DataFrame:
    return subjects.withColumns({c: F.expr(e) for c, e in OPTIONAL.items() if c not in subjects.columns})


def with_features(subjects: DataFrame, banks: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds what the flags look at. Claims are extracted here unless they are there already (with status)."""
    b = BANKS if banks is None else banks
    rows = with_defaults(subjects).withColumn("text", F.coalesce("text", F.lit("")))
    if "claims" not in rows.columns:
        rows = cl.with_claims(rows)
    if "status" not in rows.schema["claims"].dataType.elementType.names:
        rows = rows.withColumn("claims", F.transform("claims", lambda c: c.withField("status", F.lit("UNCHECKED")).withField("detail", F.lit("")).withField("source", F.lit(""))))
    rows = dm.with_domains(rows)
    text = F.col("text")
    asserted = ("vague_partnership", "concrete_partnership", "building_claims", "traction", "funding_ask", "deep_collab", "external_validation", "press_outlets")
    rows = rows.withColumn("_asserted", find_many(text, {k: b[k] for k in asserted}))
    terms = {f"_{k}": terms_of(F.col("_asserted"), k) for k in asserted}
    rows = rows.withColumns({"_titles": find_terms(text, b["leadership_titles"]), "_tech": find_terms(text, b["tech_claims"]), "_hype": find_non_overlapping(text, b["buzzwords"]), **terms})
    sets = {"_owned": cl.owned_orgs(F.col("claims")), "_partners": cl.partner_orgs(F.col("claims"))}
    outside = F.filter("source_urls", lambda u: ~host_matches(u, b["self_published_domains"]) & ~host_matches(u, b["aggregator_domains"]))
    claimed = dm.claimed_domain(F.col("domains"))
    rows = rows.withColumns({**sets, "_outside": outside, "_words": word_count(text), "_claimed": claimed, "_training": dm.supporting(F.col("domains"), "credentials"), "_roles": dm.supporting(F.col("domains"), "roles")})
    rows = rows.withColumn("_tails", F.regexp_extract_all(text, F.lit(HONORIFIC), F.lit(1)))
    return rows.withColumn("_addressed", _addressed(F.col("subject_name"), F.col("_tails")))


def _n(column: str) -> Column:
    return F.size(F.col(column))


def _claims(*subtypes: str) -> Column:
    return cl.claims_by(F.col("claims"), None, *subtypes)


def _some(claims: Column, *statuses: str) -> Column:
    return F.exists(claims, lambda c: c["status"].isin(*statuses))


def flag_statuses(now_year: int) -> dict[int, Column]:
    """The status of each flag over a row of with_features()."""
    claimed, training, roles = F.col("_claimed"), F.col("_training"), F.col("_roles")
    degrees, schools = _claims("degree"), _claims("degree_institution")
    nobody = F.coalesce(F.col("subject_name"), F.lit("")) == ""
    out: dict[int, Column] = {}
    other_field = F.exists(roles, lambda r: (r != claimed) & dm.backed_by(r, training).isNotNull())
    out[1] = (
        F.when(claimed.isNull(), UNKNOWN)
        .when((F.size(training) == 0) & (F.size(degrees) == 0), UNKNOWN)
        .when(dm.backed_by(claimed, training).isNotNull(), PASSED)
        .when(~dm.gated(claimed), PASSED)
        .when(F.size(training) == 0, UNKNOWN)
        .when((_n("_titles") == 0) & other_field, PASSED)
        .otherwise(TRIGGERED)
    )
    out[2] = (
        F.when((_n("_titles") == 0) | claimed.isNull(), UNKNOWN)
        .when(F.size(roles) == 0, UNKNOWN)
        .when(dm.backed_by(claimed, roles).isNotNull() | ~dm.gated(claimed), PASSED)
        .otherwise(TRIGGERED)
    )
    out[3] = F.when(F.arrays_overlap("_owned", "_partners"), TRIGGERED).when((_n("_owned") > 0) & (_n("_partners") > 0), PASSED).otherwise(UNKNOWN)
    hype, words = F.size("_hype.terms"), F.col("_words")
    dense = (hype >= 4) & (F.col("_hype.hits") * 100 >= 2 * words)
    out[4] = F.when(words == 0, UNKNOWN).when(words < 25, F.when(hype == 0, PASSED).otherwise(UNKNOWN)).when(dense, TRIGGERED).otherwise(PASSED)
    vague, firm = _n("_vague_partnership"), _n("_concrete_partnership")
    out[5] = F.when(vague + firm == 0, UNKNOWN).when((vague >= 2) & (vague > firm), TRIGGERED).otherwise(PASSED)
    hard = _claims(*cl.HARD)
    out[6] = F.when((F.coalesce(F.col("openalex_works"), F.lit(0)) > 0) | (F.size(hard) > 0), PASSED).when(_n("_building_claims") > 0, TRIGGERED).otherwise(UNKNOWN)
    figures = F.exists("claims", lambda c: (c["kind"] == "traction") & ~c["negated"])
    out[7] = F.when(_n("_funding_ask") == 0, UNKNOWN).when(figures | (_n("_traction") > 0), PASSED).otherwise(TRIGGERED)
    out[8] = F.when((F.size(degrees) == 0) | (F.size(schools) == 0), UNKNOWN).when(F.col("verified") & _some(schools, "NOT_FOUND"), TRIGGERED).otherwise(PASSED)
    deep = _n("_deep_collab") > 0
    out[9] = F.when((_n("_partners") >= 4) & ~deep, TRIGGERED).when(deep | (_n("_partners") > 0), PASSED).otherwise(UNKNOWN)
    about = F.coalesce(F.size("wikipedia_about"), F.lit(0)) > 0
    out[10] = (
        F.when(about | (_n("_press_outlets") > 0) | (_n("_outside") > 0), PASSED)
        .when(F.col("search_ok").eqNullSafe(False), UNKNOWN)
        .when(_n("source_urls") > 0, TRIGGERED)
        .when(_n("_external_validation") > 0, PASSED)
        .when((words >= 40) & (_n("_titles") + _n("_tech") > 0), TRIGGERED)
        .otherwise(UNKNOWN)
    )
    out[11] = (
        F.when((F.size(hard) == 0) | ~F.col("verified"), UNKNOWN)
        .when(_some(hard, "NOT_FOUND", "MISMATCH"), TRIGGERED)
        .when(_some(hard, "VERIFIED") & ~nobody, PASSED)
        .otherwise(UNKNOWN)
    )
    years = F.transform(_claims("year"), lambda c: c["value"].cast("int"))
    spans = F.filter(F.transform(_claims("claimed_experience_years"), lambda c: cl.experience_years(c["value"])), lambda n: n > 0)
    both = (F.size(spans) > 0) & (F.size(years) > 0)
    wrong = (F.array_max(years) > now_year) | (both & (F.array_max(spans) > now_year - F.array_min(years) + 3))
    out[12] = F.when(F.coalesce(wrong, F.lit(False)), TRIGGERED).when(both, PASSED).otherwise(UNKNOWN)
    doctor = F.exists(degrees, lambda c: F.lower(c["value"]).rlike(DOCTORATE_DEGREES)) | F.col("text").rlike(DOCTORATE)
    titled = F.coalesce(F.col("_addressed"), F.lit(False)) & ~nobody
    out[13] = F.when(~titled, UNKNOWN).when(doctor, PASSED).when(F.size(degrees) == 0, UNKNOWN).otherwise(TRIGGERED)
    return out


def _evidence() -> dict[int, Column]:
    """What a flag rests on, a few items each."""
    col, claimed = F.col, F.col("_claimed")
    values = lambda *s: cl.values_of(F.col("claims"), *s)
    out = {
        1: F.concat(F.array_compact(F.array(claimed)), col("_training")), 2: F.concat(col("_titles"), col("_roles")), 3: F.array_intersect("_owned", "_partners"),
        4: col("_hype.terms"), 5: F.concat(col("_vague_partnership"), col("_concrete_partnership")), 6: F.concat(values(*cl.HARD), col("_building_claims")),
        7: F.concat(col("_funding_ask"), col("_traction")), 8: values("degree_institution", "degree"), 9: F.concat(col("_partners"), col("_deep_collab")),
        10: F.concat(col("_press_outlets"), col("_outside"), col("_external_validation")), 11: values(*cl.HARD), 12: values("claimed_experience_years", "year"), 13: values("degree"),
    }
    return {i: F.slice(x, 1, 4) for i, x in out.items()}


#: For each flag what it asks, and what its three answers say; {} stands for the evidence.
WORDING = {
    1: ("Does the training fit the domain that is claimed?", "The claimed domain and the training named are far apart: {}.", "Nothing speaks against the training behind the claimed domain.", "No domain is claimed, or no training is named to hold against it."),
    2: ("Do earlier roles support the title held?", "The title is not backed by any role in the claimed domain: {}.", "Earlier roles fit the title, or the domain is open to all.", "There is no title with a domain, or no earlier role."),
    3: ("Are the partners the subject's own organisations?", "Organisations that the subject leads are named as partners: {}.", "Partners and own organisations are different ones.", "Partners or own organisations are missing."),
    4: ("Does the language promise more than it says?", "Many big words for so short a text: {}.", "The language is sober enough.", "The text is too short to weigh its big words."),
    5: ("Are there firm agreements, or only intentions?", "The deals named bind nobody: {}.", "Firm agreements are named, or no pattern of mere intentions.", "No deals are named."),
    6: ("Is there any work that can be looked up?", "Work is announced, but nothing of it can be looked up: {}.", "There is work that can be looked up: {}.", "No work is announced that could be looked up."),
    7: ("Is money sought without any figure of use?", "Money is sought and no customer, user or income is named: {}.", "Money is sought and use or income is named: {}.", "No money is sought."),
    8: ("Is each degree tied to a school that can be found?", "The register of research organisations lists no such school (small ones may be missing): {}.", "The degree is tied to a named school: {}.", "No degree is named, or none with its school."),
    9: ("Are many partners named without any joint work?", "Several partners and no sign of joint work: {}.", "There is joint work, or there are few partners.", "No partners are named."),
    10: ("Has anybody independent written about the subject?", "No voice but the subject's own was found: {}.", "Somebody independent is named: {}.", "Too little is said, or nobody could be asked."),
    11: ("Does a register contradict a claim?", "A register doesn't have an identifier, or has it for somebody else: {}.", "Registers confirm the identifiers: {}.", "No identifier was checked against a register, or none could be."),
    12: ("Do the dates and durations fit one life?", "The dates and durations can't all be true: {}.", "The dates and durations fit.", "Too few dates and durations are given."),
    13: ("Is a doctor's title used without a doctorate?", "The title is used and no degree named is a doctorate: {}.", "The title is backed by a doctorate.", "The title isn't used for the subject, or no degree is named."),
}


def _description(flag: int, status: Column, evidence: Column) -> Column:
    listed = F.when(F.size(evidence) > 0, F.array_join(evidence, ", ")).otherwise("nothing is named")
    texts = {name: F.lit(text) if "{}" not in text else F.concat(F.lit(text.split("{}")[0]), listed, F.lit(text.split("{}")[1])) for name, text in zip((TRIGGERED, PASSED, UNKNOWN), WORDING[flag][1:], strict=True)}
    return F.coalesce(*(F.when(status == name, text) for name, text in texts.items()))


def with_flags(features: DataFrame, now_year: int) -> DataFrame:
    """Adds `flags`: array of id, status, description, evidence in order of id."""
    status, evidence = flag_statuses(now_year), _evidence()
    rows = features.withColumn("_status", F.array(*(status[i] for i, *_ in FLAGS))).withColumn("_evidence", F.array(*(evidence[i] for i, *_ in FLAGS)))
    at = lambda name, i: F.get(F.col(name), F.lit(i - 1))
    each = [F.struct(F.lit(i).alias("id"), at("_status", i).alias("status"), _description(i, at("_status", i), at("_evidence", i)).alias("description"), at("_evidence", i).alias("evidence")) for i, *_ in FLAGS]
    return rows.withColumn("flags", F.array(*each)).drop("_status", "_evidence")


def flag_table(audited: DataFrame, *keep: str) -> DataFrame:
    """A row for each subject and flag."""
    return audited.select(*keep, F.explode("flags").alias("f")).select(*keep, F.col("f.id").alias("flag_id"), "f.status", "f.evidence")


def flag_specs(spark) -> DataFrame:
    return spark.createDataFrame(FLAGS, "flag_id int, name string, weight double, category string, floor string")
