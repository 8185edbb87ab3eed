"""Domains of expertise: what is claimed, what training and roles there are, and whether they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.taxonomy import DOMAINS, EDUCATION_TAIL, EDUCATION_TRIGGERS, FACETS, GATED, SENTENCE_ENDS, SUPPORTS
from claimstead.functions.terms import find_many, matches, terms_of


def education_spans(text: Column) -> Column:
    """The sentences around words of education; one that no mark ends is cut after EDUCATION_TAIL characters."""
    inside = SENTENCE_ENDS.replace("[", "[^", 1)

    def span(m: Column) -> Column:
        left = F.regexp_extract(F.substring(text, F.lit(1), m["start"]), f"{inside}*$", 0)
        rest = F.substring(text, m["end"] + 1, F.length(text))
        right = F.regexp_extract(rest, f"^{inside}*", 0)
        right = F.when(F.length(right) == F.length(rest), F.substring(rest, 1, EDUCATION_TAIL)).otherwise(right)
        return F.concat(left, m["match"], right)

    return F.when(text.rlike(EDUCATION_TRIGGERS), F.transform(matches(text, EDUCATION_TRIGGERS), span)).otherwise(F.expr("CAST(array() AS array<string>)"))


def education_text(text: Column) -> Column:
    return F.array_join(education_spans(text), " ; ")


def with_domains(subjects: DataFrame) -> DataFrame:
    """Adds `domains`: of each domain with any asserted marker its name, claims, credentials and roles."""
    rows = subjects.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_edu", education_text(F.col("_text")))
    on_text = {f"{d}/{f}": x[f] for d, x in DOMAINS.items() for f in FACETS if f != "credentials"}
    on_training = {f"{d}/credentials": x["credentials"] for d, x in DOMAINS.items()}
    rows = rows.withColumn("_hits", F.concat(find_many(F.col("_text"), on_text), find_many(F.col("_edu"), on_training)))
    each = [F.struct(F.lit(d).alias("domain"), *(terms_of(F.col("_hits"), f"{d}/{f}").alias(f) for f in FACETS)) for d in DOMAINS]
    some = F.filter(F.array(*each), lambda d: F.size(d["claims"]) + F.size(d["credentials"]) + F.size(d["roles"]) > 0)
    return rows.withColumn("domains", some).drop("_text", "_edu", "_hits")


def claimed_domain(domains: Column) -> Column:
    """The domain with the most claims; of equal ones that with more roles, then more credentials, then by name."""
    ranked = F.transform(F.filter(domains, lambda d: F.size(d["claims"]) > 0), lambda d: F.struct(-F.size(d["claims"]), -F.size(d["roles"]), -F.size(d["credentials"]), d["domain"].alias("domain")))
    return F.get(F.array_sort(ranked), F.lit(0))["domain"]


def supporting(domains: Column, facet: str) -> Column:
    """Names of the domains with a marker of the facet, in order of declaration."""
    return F.transform(F.filter(domains, lambda d: F.size(d[facet]) > 0), lambda d: d["domain"])


def _edges() -> Column:
    return F.create_map(*(x for k, v in SUPPORTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))


def backed_by(claimed: Column, training: Column) -> Column:
    """The training that backs a claim: the same domain, or else the first by name whose reach has it; null if none."""
    reach = F.filter(F.array_sort(training), lambda t: F.array_contains(F.try_element_at(_edges(), t), claimed))
    return F.when(F.array_contains(training, claimed), claimed).otherwise(F.get(reach, F.lit(0)))


def gated(domain: Column) -> Column:
    return domain.isin(*GATED)


def markers_table(spark) -> DataFrame:
    rows = [(d, i, f, j, m) for i, (d, x) in enumerate(DOMAINS.items()) for f in FACETS for j, m in enumerate(x[f])]
    return spark.createDataFrame(rows, "domain string, domain_ord int, facet string, ord int, marker string")


def supports_table(spark) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, x in SUPPORTS.items() for b in x], "training string, claimed string")
