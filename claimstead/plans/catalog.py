"""Every query over the driver's tables, with its DuckDB equivalent where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.functions import text as tx
from claimstead.functions.banks import BANKS
from claimstead.functions.taxonomy import DOMAINS, FACETS, GATED, SUPPORTS
from claimstead.functions.terms import body_of, count_occurrences, find_non_overlapping, find_terms, matches, negated, pattern_of, word_count
from claimstead.operators import claims as cl
from claimstead.operators import domains as dm
from claimstead.operators import flags as fl
from claimstead.operators import names as nm
from claimstead.operators import paste as ps
from claimstead.operators import profiles as pf
from claimstead.operators import providers as pv
from claimstead.operators import registries as rg
from claimstead.operators import report as rp
from claimstead.operators import scoring as sc
from claimstead.plans import audit as au
from claimstead.plans import modes as mo
from claimstead.plans.expected import EXPECTED
from claimstead.sources import corpus as co
from claimstead.sources.shared import durable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
STAMP = "2026-01-01T00:00:00"


def _text() -> Column:
    return F.col("text")


_S = f"WITH subjects AS ({co.subjects_sql()}) "


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def on_subjects(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, _S + sql if sql else None)(lambda s, d: f(co.subjects(s, d)))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_has(term: str, text: str = "text") -> str:
    body = body_of(term).replace(r"\-]", "-]")
    return f"regexp_matches({text}, {_q(r'(^|[^\pL\pN_])' + body + r'([^\pL\pN_]|$)')}, 'i')"


def _sql_list(terms: list[str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {_sql_has(t)} THEN {_q(t)} END" for t in terms) + ")"


# ── sources ──────────────────────────────────────────────────────────────
on_subjects("src_text", "SELECT subject_id, subject_name, text, source_url, verified FROM subjects", lambda s: s)
on_subjects(
    "src_tsv", "SELECT subject_name AS target, nullif(trim(text), '') AS text FROM subjects",
    lambda s: co.tsv_lines(s.select(F.concat_ws("\t", "subject_name", "text").alias("value"))),
)


@query("src_jsonl", _S + "SELECT CASE WHEN subject_id % 3 = 0 THEN 'T' || subject_id WHEN subject_id % 3 = 1 THEN 'unknown' ELSE subject_name END AS target, text FROM subjects")
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = co.subjects(spark, sf_dir)
    k = F.col("subject_id") % 3
    name, target = F.when(k == 2, F.col("subject_name")).otherwise(""), F.when(k == 0, F.concat(F.lit("T"), F.col("subject_id").cast("string")))
    rows = s.select(F.from_json(F.to_json(F.struct(name.alias("name"), target.alias("target"), "text")), "name string, target string, text string").alias("x")).select("x.*")
    return rows.select(F.coalesce(F.nullif("name", F.lit("")), "target", F.lit("unknown")).alias("target"), "text")


on_subjects(
    "src_profile_json", "SELECT subject_name AS name, CASE WHEN subject_id % 2 = 0 THEN 'Physics' ELSE 'Law' END AS study FROM subjects",
    lambda s: co.profiles_of(s.select(F.to_json(F.struct(F.col("subject_name").alias("name"), F.array(F.struct(F.when(F.col("subject_id") % 2 == 0, "Physics").alias("field_of_study"), F.lit("Law").alias("field"))).alias("educations"))).alias("value"))).select("profile.name", F.col("profile.educations")[0]["field_of_study"].alias("study")),
)


@query("src_banks", "SELECT * FROM (VALUES " + ", ".join(f"({_q(b)}, CAST({len(t)} AS BIGINT))" for b, t in BANKS.items()) + ") v(bank, n)")
def src_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(b, i, t) for b, terms in BANKS.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "bank string, ord int, term string").groupBy("bank").agg(F.count("*").alias("n"))


@query("src_cache", "SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAY")
def src_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("fetched_at"))
    return co.fresh(e, "2024-01-15 00:00:00", 7).select("event_id", "event_type")


# ── terms ────────────────────────────────────────────────────────────────
on_subjects(
    "term_regex", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {_sql_has(t)}) AS {a}" for t, a in (("machine learning", "a"), ("world class", "b"), ("co-founder", "c"), ("arr", "d"))) + " FROM subjects",
    lambda s: s.agg(*(F.count_if(_text().rlike(pattern_of(t))).alias(a) for t, a in (("machine learning", "a"), ("world class", "b"), ("co-founder", "c"), ("arr", "d")))),
)
on_subjects("is_negated", None, lambda s: s.select("subject_id", "text", F.explode(matches(_text(), pattern_of("customers"))).alias("m")).select("subject_id", F.col("m.start").alias("start"), negated(_text(), F.col("m.start")).alias("negated")))
on_subjects("has_term", f"SELECT subject_id, {_sql_has('raising')} AS raising FROM subjects", lambda s: s.select("subject_id", _text().rlike(pattern_of("raising")).alias("raising")))
for _bank in ("leadership_titles", "tech_claims", "buzzwords", "funding_ask", "external_validation"):
    on_subjects(f"find_terms_{_bank}", f"SELECT subject_id, {_sql_list(BANKS[_bank])} AS terms FROM subjects", lambda s, b=_bank: s.select("subject_id", F.array_join(find_terms(_text(), BANKS[b]), "; ").alias("terms")))
on_subjects("find_terms", None, lambda s: s.select("subject_id", *(F.array_join(find_terms(_text(), BANKS[b], asserted=True), "; ").alias(b) for b in ("traction", "vague_partnership", "concrete_partnership", "press_outlets"))))
on_subjects(
    "count_occurrences", "SELECT subject_id, CAST(" + " + ".join(f"len(regexp_extract_all(regexp_replace(text, '([^\\pL\\pN_])', '\\1\\1', 'g'), {_q('(?i)(^|[^' + chr(92) + 'pL' + chr(92) + 'pN_])' + body_of(t).replace(chr(92) + '-]', '-]') + '([^' + chr(92) + 'pL' + chr(92) + 'pN_]|$)')}))" for t in BANKS["traction"]) + " AS BIGINT) AS hits FROM subjects",
    lambda s: s.select("subject_id", count_occurrences(_text(), BANKS["traction"]).cast("long").alias("hits")),
)
on_subjects("find_non_overlapping", None, lambda s: s.select("subject_id", find_non_overlapping(_text(), BANKS["buzzwords"]).alias("x")).select("subject_id", F.array_join("x.terms", "; ").alias("terms"), F.col("x.hits").cast("long").alias("hits")))
_SQL_HOST = "coalesce(regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', ''), '')"
query("host_of", f"SELECT page_id, {_SQL_HOST.format(u='url')} AS host FROM pages")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", tx.host_of(F.col("url")).alias("host")))
on_subjects(
    "host_matches", "SELECT subject_id, coalesce(" + " OR ".join(f"h = {_q(x)} OR h LIKE {_q('%.' + x)}" for x in BANKS["self_published_domains"]) + f", false) AS own FROM (SELECT subject_id, {_SQL_HOST.format(u='source_url')} AS h FROM subjects) x",
    lambda s: s.select("subject_id", tx.host_matches(F.col("source_url"), BANKS["self_published_domains"]).alias("own")),
)
query("word_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS words FROM documents")(lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", word_count(F.coalesce(_text(), F.lit(""))).cast("long").alias("words")))

# ── claims ───────────────────────────────────────────────────────────────
_SQL_RX = {"doi": r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", "arxiv": r"arxiv\.org/abs/(\d{4}\.\d{4,5})", "orcid": r"\b(?:orcid\.org/)?(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])\b", "github": r"github\.com/([A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?(?:/[\w.-]+)?)", "nct": r"\b(NCT\d{8})\b", "patent": r"\b((?:US|EP|WO)\s?\d{7,11}(?:\s?[ABC]\d?)?)\b"}
for _sub, _rx in _SQL_RX.items():
    on_subjects(
        f"ext_{_sub}", f"SELECT subject_id, v AS value FROM (SELECT subject_id, regexp_replace(trim(unnest(regexp_extract_all(text, {_q(_rx)}, 1))), '[.,;)]+$', '') AS v FROM subjects) x",
        lambda s, k=_sub: s.select("subject_id", F.explode(cl.artifacts(_text(), k)).alias("value")),
    )
_SQL_ASSERT = {"regulatory clearance": r"\b(?:FDA|CE)[\s-](?:cleared|approved|marking|marked|certified)\b", "peer-review claim": r"\bpeer[\s-]reviewed\b", "ISO certification": r"\bISO\s?\d{4,5}\b"}
on_subjects("ext_assertion", "SELECT subject_id, concat_ws('; ', " + ", ".join(f"CASE WHEN regexp_matches(text, {_q(r)}, 'i') THEN {_q(v)} END" for v, r in _SQL_ASSERT.items()) + ") AS labels FROM subjects", lambda s: s.select("subject_id", F.array_join(cl.assertions(_text()), "; ").alias("labels")))
on_subjects("ext_degree", None, lambda s: s.select("subject_id", F.explode(cl.degrees(_text())).alias("d")).select("subject_id", "d.value"))
on_subjects("ext_degree_institution", None, lambda s: s.select("subject_id", F.explode(cl.degrees(_text())).alias("d")).where("d.inst <> ''").select("subject_id", F.col("d.inst").alias("value")))
on_subjects("ext_mentioned_institution", None, lambda s: _claims_of(s, "mentioned_institution"))
_SQL_CAPS = r"([A-Z][\w&-]*(?:[ \t][A-Z][\w&-]*){0,3})"
_SQL_LED = r"\b(CEO|CTO|President|Founder|Co-founder|Chairman|Managing Director|Head of [A-Z]\w+)\b\s*(?:of|at|@)\s+" + _SQL_CAPS
on_subjects(
    "ext_leadership", f"SELECT subject_id, unnest(list_transform(list_zip(regexp_extract_all(text, {_q(_SQL_LED)}, 1), regexp_extract_all(text, {_q(_SQL_LED)}, 2)), lambda x: x[1] || ' of ' || x[2])) AS value FROM subjects",
    lambda s: s.select("subject_id", F.explode(cl.leadership(_text())).alias("value")),
)
on_subjects("ext_owned_org", "SELECT subject_id, unnest(regexp_extract_all(text, " + _q(r"(?i:founder|co-founder|founded|president|created|established|my company|chairman|owner|ceo|cto)\s+(?i:(?:and\s+\w+\s+)?(?:of|at|@))\s+" + _SQL_CAPS) + ", 1)) AS value FROM subjects", lambda s: s.select("subject_id", F.explode(cl.owned(_text())).alias("value")))
on_subjects("ext_partner_org", "SELECT subject_id, unnest(regexp_extract_all(text, " + _q(r"(?i:partner(?:ship|ed|s)?|collaborat\w+|mou|alliance|consortium|agreement|teamed\s+up)\s+(?i:with|between)\s+" + _SQL_CAPS) + ", 1)) AS value FROM subjects", lambda s: s.select("subject_id", F.explode(cl.partners(_text())).alias("value")))
on_subjects("ext_traction", None, lambda s: s.select("subject_id", F.explode(cl.traction(_text())).alias("t")).select("subject_id", "t.value", "t.noun", "t.negated"))
on_subjects("ext_experience_years", None, lambda s: s.select("subject_id", F.explode(cl.experience(_text())).alias("value")))
on_subjects("experience_years", None, lambda s: s.select("subject_id", F.explode(cl.experience(_text())).alias("v")).select("subject_id", cl.experience_years(F.col("v")).alias("years")))
on_subjects("ext_year", None, lambda s: _claims_of(s, "year"))
on_subjects("ext_year_target", None, lambda s: _claims_of(s, "year_target"))
on_subjects("mask_non_dates", None, lambda s: s.select("subject_id", cl.masked(_text()).alias("masked")))
on_subjects("claims_by", None, lambda s: cl.exploded(cl.with_claims(s), "subject_id").groupBy("kind", "subtype").agg(F.count("*").alias("n")))
on_subjects("norm_org", None, lambda s: s.select("subject_id", F.explode(F.concat(cl.owned(_text()), cl.partners(_text()))).alias("org")).select("subject_id", tx.norm_org(F.col("org")).alias("org")))
on_subjects("owned_partner_overlap", None, lambda s: cl.with_claims(s).select("subject_id", F.explode_outer(cl.overlap(F.col("claims"))).alias("org")).where("org is not null"))
on_subjects("specificity_index", None, lambda s: s.select("subject_id", cl.specificity(_text()).alias("specificity")))


def _claims_of(s: DataFrame, subtype: str) -> DataFrame:
    return cl.exploded(cl.with_claims(s), "subject_id").where(F.col("subtype") == subtype).select("subject_id", "value")


# ── domains ──────────────────────────────────────────────────────────────
on_subjects("education_spans", None, lambda s: s.select("subject_id", F.explode(dm.education_spans(_text())).alias("span")))
on_subjects("education_text", None, lambda s: s.select("subject_id", dm.education_text(_text()).alias("education")))
on_subjects("domain_profile", None, lambda s: dm.with_domains(s).select("subject_id", F.explode_outer("domains").alias("d")).where("d is not null").select("subject_id", "d.domain", *(F.array_join(f"d.{f}", "; ").alias(f) for f in FACETS)))
on_subjects("claimed_domain", None, lambda s: dm.with_domains(s).select("subject_id", dm.claimed_domain(F.col("domains")).alias("claimed")))
on_subjects("supporting_domains", None, lambda s: dm.with_domains(s).select("subject_id", *(F.array_join(dm.supporting(F.col("domains"), f), "; ").alias(f) for f in ("credentials", "roles"))))
on_subjects("is_supported", None, lambda s: dm.with_domains(s).select("subject_id", dm.backed_by(dm.claimed_domain(F.col("domains")), dm.supporting(F.col("domains"), "credentials")).alias("via")))
query("domain_gated", "SELECT * FROM (VALUES " + ", ".join(f"({_q(d)}, {str(d in GATED).lower()})" for d in DOMAINS) + ") v(domain, gated)")(lambda s, d: dm.markers_table(s).select("domain").distinct().select("domain", dm.gated(F.col("domain")).alias("gated")))
query("transfer_map", "SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, x in SUPPORTS.items() for b in x) + ") v(training, claimed)")(lambda s, d: dm.supports_table(s))


# ── flags and scores ─────────────────────────────────────────────────────
def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = co.subjects(spark, sf_dir)
    urls = F.when(F.col("source_url").isNull(), F.expr("CAST(array() AS array<string>)")).otherwise(F.array("source_url"))
    s = durable(cl.with_claims(s.withColumn("source_urls", urls)))
    return au.audit(s, co.NOW_YEAR, co.registry_response(cl.exploded(s, "subject_name")))


for _id, *_ in fl.FLAGS:
    query(f"flag_{_id:02d}")(lambda s, d, i=_id: audited(s, d).select("subject_id", F.col("flags")[i - 1]["status"].alias("status")))

#: Flags by arithmetic, for comparing scores with SQL.
_STATUS = "CASE (subject_id * 7 + flag_id * (subject_id % 5 + 1) + subject_id // 11) % 3 WHEN 0 THEN 'TRIGGERED' WHEN 1 THEN 'PASSED' ELSE 'UNKNOWN' END"
_SPECS = "(VALUES " + ", ".join(f"({i}, {w}, {_q(c)}, {_q(fl_) if fl_ else 'NULL'})" for i, _n, w, c, fl_ in fl.FLAGS) + ") v(flag_id, weight, category, floor)"
_F = f"WITH flags AS (SELECT c_custkey AS subject_id, flag_id, weight, category, floor, {_STATUS.replace('subject_id', 'c_custkey')} AS status FROM customer CROSS JOIN {_SPECS}), sums AS (SELECT subject_id, CAST(coalesce(sum(weight) FILTER (WHERE status = 'TRIGGERED'), 0) AS DOUBLE) AS t, CAST(coalesce(sum(weight) FILTER (WHERE status <> 'UNKNOWN'), 0) AS DOUBLE) AS dec, max(CASE WHEN status = 'TRIGGERED' AND floor = 'ORANGE' THEN 3 END) AS strict FROM flags GROUP BY subject_id), v AS (SELECT *, CASE WHEN dec > 0 THEN CAST(round_even(100 * t / dec, 0) AS INT) ELSE 0 END AS raw, dec / 18.5 >= 0.35 AS scored FROM sums), w AS (SELECT *, CASE WHEN raw < 20 THEN 1 WHEN raw < 40 THEN 2 WHEN raw < 65 THEN 3 ELSE 4 END AS sev FROM v) "
_LEVEL = "CASE WHEN NOT scored THEN 'INSUFFICIENT DATA' ELSE ['GREEN','YELLOW','ORANGE','RED'][greatest(sev, coalesce(strict, 0))] END"


def flags_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("subject_id"))
    rows = c.withColumn("flag_id", F.explode(F.array(*(F.lit(i) for i, *_ in fl.FLAGS))))
    return rows.withColumn("status", F.expr(_STATUS.replace("subject_id // 11", "(subject_id - subject_id % 11) / 11").replace("CASE (", "CASE CAST((").replace(") % 3", ") AS BIGINT) % 3")))


def on_flags(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, _F + sql)(lambda s, d: f(flags_by_rule(s, d)))


on_flags("score_weighted", "SELECT subject_id, t AS triggered_weight, dec AS decided_weight, raw AS raw_score FROM v", lambda x: sc.score_table(x, "subject_id").select("subject_id", "triggered_weight", "decided_weight", "raw_score"))
on_flags("score_gate", "SELECT subject_id, scored, CASE WHEN scored THEN raw END AS score, CAST(round_even(100 * dec / 18.5, 0) AS INT) AS coverage FROM v", lambda x: sc.score_table(x, "subject_id").select("subject_id", "scored", "score", "coverage"))
on_flags("score_level", f"SELECT {_LEVEL} AS level, count(*) AS n FROM w GROUP BY 1", lambda x: sc.score_table(x, "subject_id").groupBy("level").agg(F.count("*").alias("n")))
on_flags("score_floor", f"SELECT subject_id, {_LEVEL} AS level, scored AND coalesce(strict, 0) > sev AS held FROM w", lambda x: sc.score_table(x, "subject_id").select("subject_id", "level", "held"))
on_flags("score_categories", "SELECT subject_id, category, CAST(round_even(100 * coalesce(sum(weight) FILTER (WHERE status = 'TRIGGERED'), 0) / sum(weight), 0) AS INT) AS score, count(*) AS flags_decided FROM flags WHERE status <> 'UNKNOWN' GROUP BY 1, 2", lambda x: sc.category_scores(x, "subject_id"))
on_flags("flag_status_counts", "SELECT flag_id, count(*) FILTER (WHERE status = 'TRIGGERED') AS n_triggered, count(*) FILTER (WHERE status = 'PASSED') AS n_passed, count(*) FILTER (WHERE status = 'UNKNOWN') AS n_unknown FROM flags GROUP BY 1", lambda x: sc.status_counts(x, "flag_id"))
on_flags("score_rollup", "SELECT category, status, count(*) AS n, CAST(sum(weight) AS DOUBLE) AS weight FROM flags GROUP BY ROLLUP (category, status)", lambda x: x.join(F.broadcast(fl.flag_specs(x.sparkSession)), "flag_id").rollup("category", "status").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")))
query("verdict")(lambda s, d: audited(s, d).select("subject_id", "verdict.score", "verdict.raw_score", "verdict.scored", "verdict.coverage", "verdict.level", "verdict.held"))
query("batch_summary")(lambda s, d: au.summary(audited(s, d)))
query("claim_status_counts")(lambda s, d: cl.exploded(audited(s, d), "subject_id").groupBy("status").agg(F.count("*").alias("n")))
on_subjects("skipped_subtypes", None, lambda s: rg.skipped_subtypes(cl.exploded(cl.with_claims(s), "subject_id")))

# ── names ────────────────────────────────────────────────────────────────
on_subjects("name_normalize", "SELECT subject_id, strip_accents(lower(subject_name)) AS folded FROM subjects", lambda s: s.select("subject_id", nm.name_normalize("subject_name").alias("folded")))
on_subjects("name_tokens", "SELECT subject_id, array_to_string(list_sort(string_split(strip_accents(lower(subject_name)), ' ')), ' ') AS tokens FROM subjects", lambda s: s.select("subject_id", F.array_join(nm.name_tokens("subject_name"), " ").alias("tokens")))
on_subjects("name_initials", "SELECT subject_id, array_to_string(list_sort(list_distinct([x[1:1] for x in string_split(strip_accents(lower(subject_name)), ' ')])), '') AS initials FROM subjects", lambda s: s.select("subject_id", F.array_join(nm.name_initials(nm.name_normalize("subject_name")), "").alias("initials")))
on_subjects(
    "name_matches", "SELECT subject_id, CASE subject_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE NULL END AS is_subject FROM subjects",
    lambda s: s.select("subject_id", nm.name_matches(F.col("subject_name"), F.when(F.col("subject_id") % 4 == 0, F.array(F.upper("subject_name"))).when(F.col("subject_id") % 4 == 1, F.array(F.lit("Oda Ruiz"))).when(F.col("subject_id") % 4 == 2, F.array(F.lit("Oda Ruiz"), F.concat(F.substring("subject_name", 1, 1), F.lit(". "), F.split("subject_name", " ")[1]))).otherwise(F.array(F.lit("王伟")))).alias("is_subject")),
)
on_subjects("org_tokens", None, lambda s: s.select("subject_id", F.explode(cl.institutions(_text())).alias("v")).select("subject_id", F.array_join(nm.org_tokens_of("v"), " ").alias("tokens")))
query("ambiguous_acronym", "SELECT n_name, length(substr(n_name, 1, CAST(n_nationkey % 7 + 1 AS INT))) <= 5 AND contains(substr(n_name, 1, CAST(n_nationkey % 7 + 1 AS INT)), ' ') = false AND upper(substr(n_name, 1, CAST(n_nationkey % 7 + 1 AS INT))) = substr(n_name, 1, CAST(n_nationkey % 7 + 1 AS INT)) AS ambiguous FROM nation")(lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_name", nm.ambiguous_acronym(F.substring("n_name", F.lit(1), (F.col("n_nationkey") % 7 + 1).cast("int"))).alias("ambiguous")))


# ── registries and providers ─────────────────────────────────────────────
def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(cl.exploded(cl.with_claims(co.subjects(spark, sf_dir)), "subject_id", "subject_name"))
    return rg.verify_all(rows, co.registry_response(rows))


for _sub in rg.CHECKED:
    query("ver_institution" if _sub == "degree_institution" else f"ver_{_sub}")(lambda s, d, k=_sub: _checked(s, d).where(F.col("subtype") == k).select("subject_id", "ord", "value", "status"))
query("ver_dispatch")(lambda s, d: _checked(s, d).groupBy("subtype", "status").agg(F.count("*").alias("n")))
query("org_match")(lambda s, d: _checked(s, d).where("subtype = 'degree_institution'").groupBy("value", "status").agg(F.count("*").alias("n")))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = co.subjects(spark, sf_dir)
    n, k = F.col("subject_name"), F.col("subject_id")
    j = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    bodies = {
        "wikipedia": F.when(k % 3 == 0, j('{"query":{"search":[{"title":"', n, '","snippet":"<b>born</b> in 1970"},{"title":"Oda Ruiz","snippet":"other"}]}}')).when(k % 3 == 1, '{"query":{"search":[]}}'),
        "openalex": F.when(k % 4 < 2, j('{"results":[{"id":"https://openalex.org/A1","display_name":"', n, '","works_count":3,"cited_by_count":5,"last_known_institutions":[{"display_name":"Brabel"}]},{"id":"https://openalex.org/A2","display_name":"', n, '","works_count":', (k % 9).cast("string"), "}]}")),
        "crossref": F.when(k % 5 == 0, j('{"message":{"items":[{"title":["On things"],"DOI":"10.1/', k.cast("string"), '","author":[{"given":"Oda","family":"Ruiz"},{"given":"', F.split(n, " ")[0], '","family":"', F.split(n, " ")[1], '"}]}]}}')),
        "duckduckgo": F.when(k % 2 == 0, j('<a rel="x" class="result__a" href="//d/?uddg=https%3A%2F%2Fwww.spokeo.com%2Fn&amp;r=1"><b>', n, '</b></a><a class="result__a" href="https://linkedin.com/pub/dir/a/b">People</a><a class="result__a" href="http://localhost/x">', n, "</a>")),
    }
    rows = [s.select("subject_id", "subject_name", F.lit(p).alias("provider"), b.alias("body")) for p, b in bodies.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


for _p in ("wikipedia", "openalex", "crossref", "duckduckgo"):
    query(f"prov_{_p}")(lambda s, d, p=_p: getattr(pv, p)(_answers(s, d)).drop("subject_name"))
query("prov_openalex_best")(lambda s, d: pv.openalex_signal(_answers(s, d)))
query("prov_gather")(lambda s, d: pv.gather(_answers(s, d)).groupBy("provider", "about_subject", "independent").agg(F.count("*").alias("n")))
query("prov_corpus")(lambda s, d: pv.corpus(pv.gather(_answers(s, d))))
query("prov_urls")(lambda s, d: pv.urls(pv.gather(_answers(s, d))))
query("prov_used_urls")(lambda s, d: pv.urls(pv.gather(_answers(s, d)), used=True))
query("prov_discarded")(lambda s, d: pv.discarded(pv.gather(_answers(s, d))).groupBy("subject_id").agg(F.count("*").alias("n")))
query("prov_health")(lambda s, d: pv.health(_answers(s, d)))
query("shared_name_evidence")(lambda s, d: pv.shared_name_evidence(pv.gather(_answers(s, d))))
query("deep_filter")(lambda s, d: pv.deep_filter(pv.gather(_answers(s, d))).select("subject_id", "provider", "url"))
query("page_text")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", tx.page_text(F.coalesce("html", F.lit(""))).alias("text")))
_KEYED = "(c_custkey % 6)"
_ADDRESS = "CASE {k} WHEN 0 THEN 'https://www.linkedin.com/in/jan-fictief-1a2b' WHEN 1 THEN 'github.com/user' || c_custkey WHEN 2 THEN 'https://orcid.org/0000-0002-1825-009x' WHEN 3 THEN 'https://linkedin.com/pub/dir/a/b' WHEN 4 THEN 'ftp://github.com/a' ELSE 'https://github.com/settings/' END".format(k=_KEYED)
query(
    "profile_url", f"SELECT c_custkey AS subject_id, CASE {_KEYED} WHEN 0 THEN 'linkedin' WHEN 1 THEN 'github' WHEN 2 THEN 'orcid' END AS platform, CASE {_KEYED} WHEN 0 THEN 'jan-fictief-1a2b' WHEN 1 THEN 'user' || c_custkey WHEN 2 THEN '0000-0002-1825-009X' END AS handle, CASE {_KEYED} WHEN 0 THEN 'https://www.linkedin.com/in/jan-fictief-1a2b' WHEN 1 THEN 'https://github.com/user' || c_custkey WHEN 2 THEN 'https://orcid.org/0000-0002-1825-009X' END AS url FROM customer",
)(lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("subject_id"), pf.profile_ref(F.expr(_ADDRESS)).alias("r")).select("subject_id", "r.platform", "r.handle", "r.url"))
query("name_from_handle", "SELECT c_custkey AS subject_id, CASE c_custkey % 3 WHEN 0 THEN 'Jan Fictief' WHEN 1 THEN 'Ana Maria' ELSE 'Bo' END AS name FROM customer")(lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("subject_id"), pf.name_from_handle(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'jan-fictief-1a2b' WHEN 1 THEN 'ANA_maria.' || c_custkey ELSE 'bo-12-0f9' END")).alias("name")))
query("og_meta")(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", pf.og_meta(F.coalesce("html", F.lit("")), "og:title").alias("title"), pf.og_meta(F.coalesce("html", F.lit("")), "og:description").alias("description")))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = co.subjects(spark, sf_dir)
    k, n = F.col("subject_id"), F.col("subject_name")
    platform = F.element_at(F.array(F.lit("linkedin"), F.lit("github"), F.lit("orcid")), (k % 3 + 1).cast("int"))
    body = F.when(k % 7 == 0, None).when(k % 3 == 0, F.concat(F.lit('<meta property="og:title" content="'), n, F.lit(' - Builder | LinkedIn"><meta content="About &amp; more" name="og:description">')))
    body = body.when(k % 3 == 1, F.concat(F.lit('{"login":"u","name":"'), n, F.lit('","bio":"Builds.","company":"Corvel"}'))).otherwise(F.concat(F.lit('{"name":null,"biography":{"content":"'), n, F.lit('"}}')))
    return s.select("subject_id", platform.alias("platform"), F.lit("jan-fictief-1a2b").alias("handle"), body.alias("body"))


for _p in ("linkedin", "github", "orcid"):
    query(f"read_{_p}")(lambda s, d, p=_p: pf.read_profiles(_profiles(s, d).where(F.col("platform") == p)).drop("body"))


# ── names, profiles and pastes as audits ──────────────────────
def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.from_web(co.subjects(spark, sf_dir), _answers(spark, sf_dir))


def _addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _profiles(spark, sf_dir)
    url = F.when(F.col("platform") == "linkedin", F.concat(F.lit("https://www.linkedin.com/in/p"), F.col("subject_id").cast("string"))).when(F.col("platform") == "github", F.concat(F.lit("https://github.com/p"), F.col("subject_id").cast("string"))).otherwise("https://example.org/none")
    rows = rows.withColumn("url", url)
    return mo.from_urls(rows.select("subject_id", F.lit(None).cast("string").alias("subject_name"), "url", F.lit("Pasted besides.").alias("text")), rows.where("platform <> 'orcid'").select("url", "body"))


query("web_signals")(lambda s, d: _web(s, d).select("subject_id", "openalex_works", "ambiguous_identity", "search_ok", "n_discarded", F.array_join("providers_failed", "; ").alias("failed"), F.array_join("shared_name", "; ").alias("shared"), F.array_join("wikipedia_about", "; ").alias("about"), F.array_join("source_urls", " ").alias("urls")))
query("web_audit")(lambda s, d: (r := au.audit(_web(s, d), co.NOW_YEAR)).select("subject_id", F.col("flags")[5]["status"].alias("output"), F.col("flags")[9]["status"].alias("validation")))
query("profile_subjects")(lambda s, d: _addressed(s, d).select("subject_id", "profile_anchor", "profile_reachable", F.col("source_urls")[0].alias("url"), F.endswith("text", F.lit("Pasted besides.")).alias("pasted")))


# ── pasted profiles ──────────────────────────────────────────────────────
_PASTE = (
    "concat(subject_name, '\\nBuilder of things\\nBrabel, Nowhere\\n500+ connections\\nConnect\\nMessage\\n\\nAbout\\nMakes things.…see more\\n\\nExperience\\nEngineer\\nCorvel · Full-time\\n"
    "Jan 2015 - Present · 6 yrs 6 mos\\nBrabel, Nowhere\\n\\nLed a team of five.\\n\\nClerk\\nDunmere\\nFeb 2010 - Dec 2014 · 1 yr\\n\\nEducation\\nUniversity of Brabel\\nMSc, Physics\\n2005 - 2009\\n\\n"
    "Skills\\nPython · SQL\\nEducation\\nPlanning · 12 endorsements\\n')"
)


def _pastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.subjects(spark, sf_dir).withColumn("text", F.when(F.col("subject_id") % 3 < 2, F.expr(_PASTE)).otherwise(F.col("text")))


query("paste_detect", _S + "SELECT subject_id, subject_id % 3 < 2 AS pasted FROM subjects")(lambda s, d: _pastes(s, d).select("subject_id", ps.is_paste(_text()).alias("pasted")))
query("paste_sections")(lambda s, d: ps.sectioned(_pastes(s, d), "subject_id").groupBy("section").agg(F.count("*").alias("n")))
query("paste_chrome")(lambda s, d: _pastes(s, d).select("subject_id", F.size(F.filter(ps.lines_of(_text()), ps.is_chrome)).alias("n")))
query("paste_experience")(lambda s, d: ps.parsed(_pastes(s, d), "subject_id").select("subject_id", F.posexplode("profile.experiences").alias("at", "e")).select("subject_id", "at", "e.*"))
query("paste_education")(lambda s, d: ps.parsed(_pastes(s, d), "subject_id").select("subject_id", F.posexplode("profile.educations").alias("at", "e")).select("subject_id", "at", "e.*"))
query("paste_skills")(lambda s, d: ps.parsed(_pastes(s, d), "subject_id").select("subject_id", F.array_join("profile.skills", "; ").alias("skills")))
query("paste_subjects")(lambda s, d: mo.from_pastes(_pastes(s, d)).select("subject_id", "subject_name", "text"))
query("profile_prose")(lambda s, d: ps.parsed(_pastes(s, d), "subject_id").select("subject_id", ps.prose(F.col("profile")).alias("prose")))
query("duration_fmt", "SELECT c_custkey AS subject_id, CASE c_custkey % 4 WHEN 0 THEN '6 years 6 months' WHEN 1 THEN '1 year' WHEN 2 THEN '3 months' ELSE '' END AS said FROM customer")(lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("subject_id"), ps.duration_text(F.expr("CASE c_custkey % 4 WHEN 0 THEN '6 yrs 6 mos' WHEN 1 THEN '1 yr' WHEN 2 THEN '3 mos' ELSE 'now' END")).alias("said")))


# ── reports ──────────────────────────────────────────────────────────────
def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.with_report(audited(spark, sf_dir), STAMP)


query("report_json")(lambda s, d: rp.report_json(_reported(s, d)))
query("report_caveats")(lambda s, d: (r := _reported(s, d)).select("subject_id", F.array_join(rp.caveats(r), "\n").alias("caveats")))
query("report_terminal")(lambda s, d: (r := _reported(s, d)).select("subject_id", rp.terminal(r).alias("text")))
query("report_markdown")(lambda s, d: (r := _reported(s, d)).select("subject_id", rp.markdown(r).alias("markdown")))
query("report_html")(lambda s, d: (r := _reported(s, d)).select("subject_id", rp.html(r).alias("html")))
query("batch_csv")(lambda s, d: au.summary(audited(s, d)).withColumn("timestamp", F.lit(STAMP)).select(F.to_csv(F.struct("target", "level", "score", "coverage_pct", "specificity", "triggered_flags", "timestamp")).alias("line")))
query("audit_list", "SELECT 'f' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS file_name FROM orders ORDER BY 1 DESC LIMIT 20")(lambda s, d: rp.latest(s.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("file_name"))))
query("slug", "SELECT c_custkey AS subject_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), ''), 'audit') AS slug FROM customer")(lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("subject_id"), tx.slug(F.col("c_name")).alias("slug")))

ORACLE_SQL.update(EXPECTED)
