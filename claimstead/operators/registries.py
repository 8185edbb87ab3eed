"""Claims against tables of registry responses: confirmed, contradicted, absent, or impossible to say.

responses: registry, key, http_status, body. 404 and 410 answer that there is nothing; a missing row or any
other status but 200 means that the registry could not be asked, and is never evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.text import unescaped_all
from claimstead.operators.names import name_matches, org_tokens_of, org_tokens_of_all

VERIFIED, MISMATCH, NOT_FOUND, UNCHECKABLE, UNCHECKED = "VERIFIED", "MISMATCH", "NOT_FOUND", "UNCHECKABLE", "UNCHECKED"
#: Subtypes with a registry; a degree's institution is looked up under `ror`.
CHECKED = ["doi", "orcid", "github", "arxiv", "nct", "patent", "degree_institution"]

# Where each kind of identifier is looked up; {} stands for it.
SOURCES = {
    "doi": "https://api.crossref.org/works/{}", "orcid": "https://pub.orcid.org/v3.0/{}/person", "github": "https://api.github.com/{}", "arxiv": "https://export.arxiv.org/api/query?id_list={}",
    "nct": "https://clinicaltrials.gov/api/v2/studies/{}", "patent": "https://patents.google.com/patent/{}/en", "degree_institution": "https://api.ror.org/v2/organizations?query={}",
}
UNREACHED = "the registry could not be asked"

_PERSON = "struct<given:string, family:string>"
_SCHEMAS = {
    "doi": f"message struct<title:array<string>, author:array<{_PERSON}>>",
    "orcid": "name struct<`given-names`:struct<value:string>, `family-name`:struct<value:string>>",
    "github": "name string, owner struct<login:string>, stargazers_count int, public_repos int",
    "nct": "protocolSection struct<identificationModule:struct<briefTitle:string>>",
}


def _full(given: Column, family: Column) -> Column:
    return F.trim(F.concat(F.coalesce(given, F.lit("")), F.lit(" "), F.coalesce(family, F.lit(""))))


def _candidates(subtype: str, body: Column, value: Column) -> tuple[Column, Column, Column]:
    """(the record can be read, it says that there is nothing, names it publishes)."""
    none = F.expr("CAST(array() AS array<string>)")
    if subtype == "doi":
        x = F.from_json(body, _SCHEMAS["doi"])
        return x["message"].isNotNull(), F.lit(False), F.coalesce(F.transform(x["message"]["author"], lambda a: _full(a["given"], a["family"])), none)
    if subtype == "orcid":
        x = F.from_json(body, _SCHEMAS["orcid"])
        return F.get_json_object(body, "$").isNotNull(), F.lit(False), F.array(_full(x["name"]["given-names"]["value"], x["name"]["family-name"]["value"]))
    if subtype == "github":
        x = F.from_json(body, _SCHEMAS["github"])
        # a repository's owner isn't its author, a handle or one word isn't a name
        person = ~F.contains(F.btrim(value, F.lit("/")), F.lit("/")) & F.trim(x["name"]).rlike(r"\S\s+\S")
        return F.get_json_object(body, "$").isNotNull(), F.lit(False), F.when(person, F.array(F.trim(x["name"]))).otherwise(none)
    if subtype == "arxiv":
        at = "//*[local-name()='entry']"
        xml = body.rlike(r"^\s*<")
        title = F.lower(F.trim(F.when(xml, F.xpath_string(body, F.lit(f"{at}/*[local-name()='title']/text()")))))
        link = F.when(xml, F.xpath_string(body, F.lit(f"{at}/*[local-name()='id']/text()")))
        names = F.when(xml, F.xpath(body, F.lit(f"{at}/*[local-name()='author']/*[local-name()='name']/text()")))
        empty = F.coalesce(link, F.lit("")).isin("") & F.coalesce(title, F.lit("")).isin("")
        return xml, empty | F.contains(link, F.lit("api/errors")) | (title == "error"), F.coalesce(names, none)
    if subtype == "nct":
        return F.from_json(body, _SCHEMAS["nct"])["protocolSection"]["identificationModule"].isNotNull(), F.lit(False), none
    title = F.trim(F.regexp_extract(body, "(?is)<title>(.*?)</title>", 1))
    inventors = F.transform(unescaped_all(F.regexp_extract_all(body, F.lit('<dd itemprop="inventor"[^>]*>([^<]+)</dd>'), F.lit(1))), lambda v: F.trim(v))
    return F.lit(True), (title == "") | F.contains(F.lower(title), F.lit("not found")), inventors


def source_of(subtype: Column, value: Column) -> Column:
    """The address a claim is looked up at; null for those without a registry."""
    slash = F.contains(F.btrim(value, F.lit("/")), F.lit("/"))
    asked = {
        "github": F.concat(F.when(slash, "repos/").otherwise("users/"), value), "patent": F.regexp_replace(value, r"\s", ""),
        "degree_institution": F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")),
    }
    parts = {k: x.split("{}") for k, x in SOURCES.items()}
    return F.coalesce(*(F.when(subtype == k, F.concat(F.lit(a), asked.get(k, value), F.lit(b))) for k, (a, b) in parts.items()))


def verify_identifiers(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """claims (subject_name, subtype, value and others) of the six identifier kinds -> the same with status, detail and source."""
    kinds = CHECKED[:-1]
    r = responses.select(F.col("registry").alias("subtype"), F.col("key").alias("value"), "http_status", "body")
    rows = claims.where(F.col("subtype").isin(*kinds)).join(r, ["subtype", "value"], "left")
    got = {k: _candidates(k, F.col("body"), F.col("value")) for k in kinds}
    pick = lambda i: F.coalesce(*(F.when(F.col("subtype") == k, got[k][i]) for k in kinds))
    answered = F.col("http_status") == 200
    rows = rows.withColumns({"_read": answered & pick(0), "_nothing": answered & pick(1), "_names": F.when(answered, F.filter(pick(2), lambda n: F.trim(n) != ""))})
    rows = rows.withColumn("_match", name_matches(F.col("subject_name"), F.col("_names")))
    nobody = F.coalesce(F.trim("subject_name"), F.lit("")) == ""
    status = (
        F.when(F.col("http_status").isin(404, 410), NOT_FOUND)
        .when(~F.coalesce(F.col("_read"), F.lit(False)), UNCHECKABLE)
        .when(F.col("_nothing"), NOT_FOUND)
        .when((F.col("subtype") == "nct") | (F.col("subtype") == "github") & F.contains(F.btrim("value", F.lit("/")), F.lit("/")), UNCHECKABLE)
        .when((F.col("subtype") == "patent") & (F.size("_names") == 0), UNCHECKABLE)
        .when(nobody, VERIFIED)
        .when(F.col("_match").isNull(), UNCHECKABLE)
        .when(F.col("_match"), VERIFIED)
        .otherwise(MISMATCH)
    )
    some = F.size("_names") > 0
    listed = F.array_join(F.slice("_names", 1, 4), ", ")
    said = (
        F.when(F.col("status") == NOT_FOUND, "the registry has no such record")
        .when(F.col("status") == VERIFIED, F.when(some, F.concat(F.lit("the record names "), listed)).otherwise("the record exists"))
        .when(F.col("status") == MISMATCH, F.concat(F.lit("the record names "), listed, F.lit(" and not the subject")))
        .when(~F.coalesce(F.col("_read"), F.lit(False)), UNREACHED)
        .otherwise("the record exists, but names nobody who could be compared with the subject")
    )
    rows = rows.withColumn("status", status).withColumns({"detail": said, "source": source_of(F.col("subtype"), F.col("value"))})
    return rows.drop("http_status", "body", "_read", "_nothing", "_names", "_match")


def verify_institutions(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """claims with subtype degree_institution -> the same with status, detail and source: every telling word has to be in one listed name.

    Of the names listed, a hit comes first, then the one with the largest share of common words, then the first.
    """
    wanted = claims.where("subtype = 'degree_institution'").withColumn("wanted", org_tokens_of("value"))
    r = responses.where("registry = 'ror'").select(F.col("key").alias("value"), "http_status", "body")
    items = F.slice(F.from_json("body", "items array<struct<id:string, names:array<struct<value:string>>>>")["items"], 1, 25)
    rows = wanted.join(r, "value", "left").withColumn("listed", F.flatten(F.transform(items, lambda x: x["names"]["value"])))
    rows = rows.withColumn("pairs", F.arrays_zip(F.col("listed").alias("name"), org_tokens_of_all("listed").alias("have")))

    def judged(x: Column, i: Column) -> Column:
        hit = (F.size("wanted") > 0) & (F.size(F.array_except("wanted", x["have"])) == 0)
        near = F.size(F.array_intersect("wanted", x["have"])) / F.size(F.array_union("wanted", x["have"]))
        return F.struct(F.when(hit, 0).otherwise(1).alias("miss"), F.when(hit, F.lit(0.0)).otherwise(-near).alias("less"), i.alias("i"), x["name"].alias("name"))

    best = F.get(F.array_sort(F.transform(F.filter("pairs", lambda x: F.size(x["have"]) > 0), judged)), F.lit(0))
    rows = rows.withColumn("best", best)
    status = (
        F.when(F.col("http_status").isin(404, 410), NOT_FOUND)
        .when(F.coalesce(F.col("http_status"), F.lit(0)) != 200, UNCHECKABLE)
        .when(F.get_json_object("body", "$").isNull(), UNCHECKABLE)
        .when(F.col("best.miss") == 0, VERIFIED)
        .otherwise(NOT_FOUND)
    )
    said = (
        F.when(F.col("status") == UNCHECKABLE, UNREACHED)
        .when(F.col("status") == VERIFIED, F.concat(F.lit("listed as "), F.col("best.name")))
        .when(F.col("best").isNotNull(), F.concat(F.lit("not listed; the nearest name is "), F.col("best.name")))
        .otherwise("not listed")
    )
    rows = rows.withColumn("status", status).withColumns({"detail": said, "source": source_of(F.col("subtype"), F.col("value"))})
    return rows.drop("wanted", "http_status", "body", "listed", "pairs", "best")


def verify_all(claims: DataFrame, responses: DataFrame) -> DataFrame:
    """Every claim with its status; those without a registry stay unchecked."""
    known = verify_identifiers(claims, responses).unionByName(verify_institutions(claims, responses))
    rest = claims.where(~F.col("subtype").isin(*CHECKED)).withColumns({"status": F.lit(UNCHECKED), "detail": F.lit(""), "source": F.lit("")})
    return known.unionByName(rest)


def skipped_subtypes(claims: DataFrame) -> DataFrame:
    return claims.where(~F.col("subtype").isin(*CHECKED)).groupBy("subtype").agg(F.count("*").alias("n"))
