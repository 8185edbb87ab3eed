"""Findings of search providers from tables of their raw answers, and what is drawn from them.

answers: subject_id, subject_name, provider, body (null: no answer). A finding is about the subject if its
title or authors match the subject's name; only such findings may speak for the subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimstead.functions.banks import CONTROLLED_HOSTS, DIRECTORY_PAGE, SHARED_NAME_HOSTS
from claimstead.functions.text import host_matches, host_of
from claimstead.operators.names import name_matches

_ID = ["subject_id", "subject_name"]
FINDING = [*_ID, "provider", "kind", "ord", "url", "title", "snippet", "independent", "about_subject"]
_ORDER = {"wikipedia": 0, "openalex": 1, "crossref": 2, "duckduckgo": 3}


def _finding(rows: DataFrame, provider: str, kind: str, independent: Column | None = None) -> DataFrame:
    return rows.withColumns({"provider": F.lit(provider), "kind": F.lit(kind), "independent": F.lit(True) if independent is None else independent}).select(*FINDING)


def _of(answers: DataFrame, provider: str) -> DataFrame:
    return answers.where((F.col("provider") == provider) & (F.coalesce("body", F.lit("")) != "")).drop("provider")


def wikipedia(answers: DataFrame) -> DataFrame:
    hits = F.from_json("body", "query struct<search:array<struct<title:string, snippet:string>>>")["query"]["search"]
    rows = _of(answers, "wikipedia").select(*_ID, F.posexplode(hits).alias("ord", "h"))
    page = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.url_encode(F.replace("h.title", F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20")))
    rows = rows.withColumns({"title": F.col("h.title"), "snippet": F.regexp_replace("h.snippet", "<[^>]+>", ""), "url": page})
    return _finding(rows.withColumn("about_subject", F.coalesce(name_matches(F.col("subject_name"), F.array("title")), F.lit(False))), "wikipedia", "encyclopedia")


def openalex_authors(answers: DataFrame) -> DataFrame:
    """Authors whose name matches: works, citations, institutions."""
    schema = "results array<struct<id:string, display_name:string, works_count:int, cited_by_count:int, orcid:string, last_known_institutions:array<struct<display_name:string>>>>"
    rows = _of(answers, "openalex").select(*_ID, F.posexplode(F.from_json("body", schema)["results"]).alias("ord", "a"))
    rows = rows.where(name_matches(F.col("subject_name"), F.array("a.display_name")))
    places = F.filter(F.coalesce(F.col("a.last_known_institutions.display_name"), F.expr("CAST(array() AS array<string>)")), lambda x: x.isNotNull())
    return rows.select(*_ID, "ord", F.col("a.id").alias("url"), F.col("a.display_name").alias("display_name"), F.coalesce("a.works_count", F.lit(0)).alias("works"), F.coalesce("a.cited_by_count", F.lit(0)).alias("citations"), places.alias("institutions"))


def openalex(answers: DataFrame) -> DataFrame:
    said = F.concat(F.col("works").cast("string"), F.lit(" works, "), F.col("citations").cast("string"), F.lit(" citations"))
    said = F.concat(said, F.when(F.size("institutions") > 0, F.concat(F.lit(", affiliated with "), F.array_join("institutions", ", "))).otherwise(""))
    rows = openalex_authors(answers).withColumns({"title": F.concat("display_name", F.lit(" — scholarly record")), "snippet": said, "about_subject": F.lit(True)})
    return _finding(rows, "openalex", "publication")


def openalex_signal(answers: DataFrame) -> DataFrame:
    """For each subject the author with the most works (the first of equals), and how many match."""
    a = openalex_authors(answers)
    w = Window.partitionBy("subject_id")
    best = a.withColumns({"at": F.row_number().over(w.orderBy(F.desc("works"), "ord")), "matches": F.count("*").over(w)}).where("at = 1")
    return best.select("subject_id", "display_name", "works", "citations", "matches", (F.col("matches") > 1).alias("ambiguous"))


def crossref(answers: DataFrame) -> DataFrame:
    schema = "message struct<items:array<struct<title:array<string>, DOI:string, author:array<struct<given:string, family:string>>>>>"
    rows = _of(answers, "crossref").select(*_ID, F.posexplode(F.from_json("body", schema)["message"]["items"]).alias("ord", "x"))
    name = lambda a: F.trim(F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), F.coalesce(a["family"], F.lit(""))))
    rows = rows.withColumn("authors", F.coalesce(F.transform("x.author", name), F.expr("CAST(array() AS array<string>)")))
    rows = rows.where(name_matches(F.col("subject_name"), F.col("authors")))
    link = F.when(F.coalesce("x.DOI", F.lit("")) != "", F.concat(F.lit("https://doi.org/"), "x.DOI")).otherwise("")
    shown = F.concat(F.lit("authors: "), F.array_join(F.slice("authors", 1, 5), ", "))
    return _finding(rows.withColumns({"url": link, "title": F.coalesce(F.get("x.title", F.lit(0)), F.lit("untitled")), "snippet": shown, "about_subject": F.lit(True)}), "crossref", "publication")


def duckduckgo(answers: DataFrame) -> DataFrame:
    rx = '(?s)<a[^>]+class="result__a"[^>]+href="([^"]+)"[^>]*>(.*?)</a>'
    found = F.arrays_zip(F.regexp_extract_all("body", F.lit(rx), F.lit(1)).alias("href"), F.regexp_extract_all("body", F.lit(rx), F.lit(2)).alias("label"))

    def hit(x: Column) -> Column:
        target = F.regexp_extract(x["href"], "uddg=([^&]+)", 1)
        link = F.when(target != "", F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)).otherwise(x["href"])
        return F.struct(link.alias("url"), F.trim(F.regexp_replace(x["label"], "<[^>]+>", "")).alias("title"))

    kept = F.slice(F.filter(F.transform(found, hit), lambda x: F.startswith(x["url"], F.lit("http")) & (x["title"] != "")), 1, 8)
    rows = _of(answers, "duckduckgo").select(*_ID, F.posexplode(kept).alias("ord", "x")).withColumns({"url": F.col("x.url"), "title": F.col("x.title"), "snippet": F.lit("")})
    rows = rows.withColumn("about_subject", F.coalesce(name_matches(F.col("subject_name"), F.array("title")), F.lit(False)))
    return _finding(rows, "duckduckgo", "web", ~host_matches(F.col("url"), CONTROLLED_HOSTS))


def gather(answers: DataFrame) -> DataFrame:
    """All findings; place: their order over all providers."""
    rows = wikipedia(answers).unionByName(openalex(answers)).unionByName(crossref(answers)).unionByName(duckduckgo(answers))
    rank = F.create_map(*(F.lit(x) for p in _ORDER.items() for x in p))[F.col("provider")]
    return rows.withColumn("place", rank * 1000 + F.col("ord"))


def corpus(findings: DataFrame) -> DataFrame:
    """subject_id, text: titles and snippets of what is about the subject, in order."""
    line = F.trim(F.concat("title", F.lit(". "), "snippet"))
    return findings.where("about_subject").groupBy("subject_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def urls(findings: DataFrame, used: bool = False) -> DataFrame:
    """Distinct addresses of each subject with the place of their first finding; used: of findings about the subject."""
    rows = findings.where("about_subject") if used else findings
    return rows.where(F.coalesce("url", F.lit("")) != "").groupBy("subject_id", "url").agg(F.min("place").alias("place"))


def discarded(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("about_subject"))


def health(answers: DataFrame) -> DataFrame:
    """For each subject whether the search layer could look: nothing failed, or some provider answered with something."""
    some = gather(answers).groupBy("subject_id", "provider").agg(F.count("*").alias("n"))
    rows = answers.join(some, ["subject_id", "provider"], "left")
    ok = F.coalesce(F.col("n"), F.lit(0)) > 0
    return rows.groupBy("subject_id").agg(F.count_if(F.col("body").isNull()).alias("failures"), F.count_if(ok).alias("providers_ok")).withColumn("search_ok", (F.col("failures") == 0) | (F.col("providers_ok") > 0))


def shared_name_evidence(findings: DataFrame) -> DataFrame:
    """subject_id, reason, url: the first finding that shows the name to be several people's."""
    host = host_of(F.col("url"))
    known = F.array_compact(F.array(*(F.when((host == h) | F.endswith(host, F.lit("." + h)), F.lit(why)) for h, why in SHARED_NAME_HOSTS.items())))
    listing = F.when(F.contains(host, F.lit("linkedin.com")) & F.contains("url", F.lit("/pub/dir/")), F.array(F.lit(DIRECTORY_PAGE))).otherwise(F.expr("CAST(array() AS array<string>)"))
    rows = findings.select("subject_id", "place", "url", F.explode(F.array_distinct(F.concat(known, listing))).alias("reason"))
    return rows.groupBy("subject_id", "reason").agg(F.min_by("url", "place").alias("url"))


def deep_filter(findings: DataFrame) -> DataFrame:
    """What may be read in full: of the first eight findings those about the subject at a public web address."""
    first = findings.withColumn("at", F.row_number().over(Window.partitionBy("subject_id").orderBy("place"))).where(F.col("at") <= 8).drop("at")
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    scheme = F.lower(F.try_parse_url("url", F.lit("PROTOCOL")))
    return first.where(scheme.isin("http", "https") & (host != "") & ~host.isin("localhost", "127.0.0.1", "::1", "[::1]", "169.254.169.254") & F.col("about_subject"))
