"""Reports and summaries of audits, rendered where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimstead.functions.terms import word_count
from claimstead.functions.text import slug
from claimstead.operators import claims as cl
from claimstead.functions.banks import PASSED, TRIGGERED, UNKNOWN
from claimstead.operators.flags import FLAGS, WORDING
from claimstead.operators.registries import CHECKED, MISMATCH, NOT_FOUND, UNCHECKABLE, UNCHECKED, UNREACHED, VERIFIED
from claimstead.operators.scoring import category_scores

# Kinds of claims without a registry.
UNLISTED = [
    "assertion", "degree", "mentioned_institution", "leadership", "owned_org", "partner_org", "customers", "clients", "users", "subscribers", "revenue", "arr", "mrr", "employees", "units",
    "installations", "claimed_experience_years", "year", "year_target",
]
SCHEMA, VERSION = 3, "1.0"
#: What a level means to a reader.
SUMMARIES = {
    "GREEN": "What is claimed hangs together with what can be seen.", "YELLOW": "Some claims deserve a second look.", "ORANGE": "Several claims are not borne out; ask before relying on them.",
    "RED": "Most of what could be decided speaks against the claims.", "INSUFFICIENT DATA": "Too little could be decided for a score.",
}
#: Signals an audit's input may carry besides its text, with their types.
SIGNALS = {
    "openalex_works": "int", "wikipedia_about": "array<string>", "search_ok": "boolean", "ambiguous_identity": "int", "profile_anchor": "string", "profile_reachable": "boolean",
    "shared_name": "array<string>", "n_discarded": "long", "providers_failed": "array<string>",
}


def categories_of(flags: Column) -> Column:
    """array<struct<category, score, flags_decided>> by name, of categories with a decided flag."""
    names = sorted({c for *_, c, _ in FLAGS})

    def one(category: str) -> Column:
        ids = {i: w for i, _, w, c, _ in FLAGS if c == category}
        weight = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
        decided = F.filter(flags, lambda f: f["id"].isin(*ids) & f["status"].isin(TRIGGERED, PASSED))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, f: acc + weight[f["id"]])
        score = F.bround(100 * total(F.filter(decided, lambda f: f["status"] == TRIGGERED)) / total(decided)).cast("int")
        return F.when(F.size(decided) > 0, F.struct(F.lit(category).alias("category"), score.alias("score"), F.size(decided).alias("flags_decided")))

    return F.array_compact(F.array(*map(one, names)))


def counted(values: Column, names: list[str]) -> Column:
    """map of the names that occur to how often they do."""
    n = lambda x: F.size(F.filter(values, lambda v: v == x))
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(n, names))), lambda _, v: v > 0)


def with_report(audited: DataFrame, timestamp: str, mode: str = "batch-text", target: str = "subject_name") -> DataFrame:
    """Adds `report`: a struct of schema 3; timestamp is the caller's."""
    specs = F.create_map(*(x for i, name, w, cat, _ in FLAGS for x in (F.lit(i), F.struct(F.lit(name).alias("name"), F.lit(w).alias("weight"), F.lit(cat).alias("category"), F.lit(WORDING[i][0]).alias("question")))))
    flag = lambda f: F.struct(f["id"].alias("id"), *(specs[f["id"]][x].alias(x) for x in ("name", "weight", "category", "question")), *(f[x].alias(x) for x in ("status", "description", "evidence")))
    v, claims = F.col("verdict"), F.col("claims")
    statuses = F.transform(claims, lambda c: c["status"])
    said = F.create_map(*(F.lit(x) for pair in SUMMARIES.items() for x in pair))
    asked = F.filter(claims, lambda c: c["subtype"].isin(*CHECKED))
    stats = F.struct(
        F.size(asked).alias("lookups"), F.size(F.filter(asked, lambda c: c["detail"] == UNREACHED)).alias("failures"),
        counted(F.transform(F.filter(claims, lambda c: ~c["subtype"].isin(*CHECKED)), lambda c: c["subtype"]), UNLISTED).alias("skipped_subtypes"),
    )
    signals = F.struct(*((F.col(name) if name in audited.columns else F.lit(None).cast(kind)).alias(name) for name, kind in SIGNALS.items()))
    report = F.struct(
        F.lit(VERSION).alias("version"), F.lit(SCHEMA).alias("schema"), F.col(target).alias("target"), F.lit(mode).alias("mode"), F.lit(timestamp).alias("timestamp"), F.col("verified"), v["level"].alias("level"),
        v["score"].alias("score"), v["raw_score"].alias("raw_score"), v["scored"].alias("scored"), v["coverage"].alias("evidence_coverage_pct"),
        cl.specificity(F.col("text")).alias("specificity_index"), said[v["level"]].alias("summary"), categories_of(F.col("flags")).alias("categories"), word_count(F.col("text")).alias("word_count"),
        F.transform("flags", flag).alias("flags"), claims.alias("claims"), counted(statuses, [VERIFIED, MISMATCH, NOT_FOUND, UNCHECKABLE, UNCHECKED]).alias("claim_status_counts"),
        signals.alias("signals"), F.col("source_urls").alias("sources"), F.when(F.col("verified"), stats).alias("verifier_stats"),
    )
    return audited.withColumn("report", report)


def report_json(reported: DataFrame) -> DataFrame:
    """file_name, json: the name is time, slug and the subject's number, so that equal slugs don't meet."""
    stamp = F.regexp_replace(F.regexp_replace("report.timestamp", "[-:]", ""), "T", "_")
    name = F.concat(stamp, F.lit("_"), slug(F.col("report.target")), F.lit("_"), F.lpad(F.col("subject_id").cast("string"), 3, "0"), F.lit(".json"))
    return reported.select("subject_id", name.alias("file_name"), F.to_json("report").alias("json"))


def caveats(reported: DataFrame) -> Column:
    """What a reader has to know before acting on a report, in order."""
    r = F.col("report")
    hard = F.size(F.filter(r["claims"], lambda c: c["subtype"].isin(*cl.HARD)))
    has = reported.columns
    signal = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    return F.array_compact(F.array(
        F.when(signal("ambiguous_identity", "int") > 1, F.concat(signal("ambiguous_identity", "int").cast("string"), F.lit(" researchers share this name; make sure that this is the right one."))),
        F.when(signal("profile_anchor", "string").isNotNull(), F.concat(F.lit("Anchored to "), signal("profile_anchor", "string"), F.lit("; other sources were found by name and may be someone else's."))),
        F.when(signal("profile_reachable", "boolean").eqNullSafe(False), "The platform gave no profile text; only what was pasted was looked at."),
        F.when(F.size(signal("shared_name", "array<string>")) > 0, F.concat(F.lit("The name is several people's: "), F.array_join(F.array_sort(signal("shared_name", "array<string>")), ", "), F.lit("."))),
        F.when(signal("n_discarded", "long") > 0, F.concat(signal("n_discarded", "long").cast("string"), F.lit(" results were left out as not clearly about the subject."))),
        F.when(F.size(signal("providers_failed", "array<string>")) > 0, F.concat(F.lit("No data from: "), F.array_join(signal("providers_failed", "array<string>"), ", "), F.lit("."))),
        F.when((hard > 0) & ~r["verified"], F.concat(hard.cast("string"), F.lit(" identifiers could be checked with a registry but were not."))),
        F.when(r["level"].isin("GREEN", "YELLOW") & ~r["verified"] & (F.size("wikipedia_about") <= 0), "Nothing was checked outside the text: no contradiction found is not corroboration."),
        F.when(r["evidence_coverage_pct"] < 50, F.concat(F.lit("Only "), r["evidence_coverage_pct"].cast("string"), F.lit("% of the weight could be decided; the score is provisional."))),
        F.when((r["specificity_index"] < 2) & (r["word_count"] >= 40), "The text is short of details that can be checked."),
    ))


def escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _score(r: Column) -> Column:
    return F.coalesce(F.concat(r["score"].cast("string"), F.lit("/100")), F.lit("n/a"))


#: Headings of the flags by status, in order.
GROUPS = [(TRIGGERED, "Triggered"), (PASSED, "Passed"), (UNKNOWN, "Undecidable, left out of the score")]


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _lines(items: Column, line) -> Column:
    return F.transform(items, line)


def _section(items: Column, head: list[str], body: Column) -> Column:
    """Head and body, if there are items."""
    return F.when(F.size(items) > 0, F.concat(F.array(*map(F.lit, head)), body, F.array(F.lit("")))).otherwise(F.expr("CAST(array() AS array<string>)"))


def _with_status(r: Column, status: str) -> Column:
    return F.filter(r["flags"], lambda f: f["status"] == status)


def _checked(r: Column) -> Column:
    return F.filter(r["claims"], lambda c: c["status"] != UNCHECKED)


def _cell(text: Column, most: int) -> Column:
    return F.replace(F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit("|"), F.lit("\\|"))


def markdown(reported: DataFrame) -> Column:
    r = F.col("report")
    head = F.array(
        F.lit("---"), _text("created: ", r["timestamp"]), _text("level: ", r["level"]), _text("score: ", F.coalesce(r["score"].cast("string"), F.lit("null"))), F.lit("---"), F.lit(""),
        _text("# Audit: ", r["target"]), F.lit(""), _text("**Level:** ", r["level"], "  "), _text("**Score:** ", _score(r), "  "), _text("**Coverage:** ", r["evidence_coverage_pct"], "%  "),
        _text("**Specificity:** ", r["specificity_index"], "  "), _text("**Checked with registries:** ", F.when(r["verified"], "yes").otherwise("no"), "  "), _text("**Summary:** ", r["summary"]), F.lit(""),
    )
    row = lambda c: _text("| ", c["category"], " | ", c["score"], " | ", c["flags_decided"], " |")
    parts = [head, _section(r["categories"], ["## Dimensions", "", "| Dimension | Score | Flags decided |", "|-|-|-|"], _lines(r["categories"], row))]
    item = lambda f: _text("- **[", f["id"], "] ", f["name"], "** *(weight ", f["weight"], ", ", f["category"], ")* ", f["description"])
    under = lambda f: F.concat(F.array(item(f)), F.transform(F.slice(f["evidence"], 1, 3), lambda e: _text("    - ", e)))
    parts += [_section(_with_status(r, status), [f"## {name}", ""], F.flatten(F.transform(_with_status(r, status), under))) for status, name in GROUPS]
    claim = lambda c: _text("| ", c["subtype"], " | ", _cell(c["value"], 50), " | ", c["status"], " | ", _cell(c["detail"], 80), " |")
    parts.append(_section(_checked(r), ["## Claims", "", "| Type | Claim | Status | Detail |", "|-|-|-|-|"], _lines(_checked(r), claim)))
    notes = caveats(reported)
    parts.append(_section(notes, ["## Before acting on this", ""], _lines(notes, lambda x: _text("- ", x))))
    parts.append(_section(r["sources"], ["## Sources", ""], _lines(F.slice(r["sources"], 1, 20), lambda u: _text("- ", u))))
    return F.array_join(F.concat(*parts, F.array(F.lit("*Leads to check by hand, not a verdict.*"))), "\n")


def _bar(score: Column, width: int = 24) -> Column:
    n = F.bround(F.lit(width) * score / 100).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def terminal(reported: DataFrame) -> Column:
    r = F.col("report")
    head = F.array(
        _text(r["target"], ": ", r["level"], ", score ", _score(r), ", coverage ", r["evidence_coverage_pct"], "%, ", F.when(r["verified"], "checked").otherwise("not checked")),
        r["summary"], _text("Specificity: ", r["specificity_index"], " details for 100 words (", F.when(r["specificity_index"] < 2, "low").otherwise("reasonable"), ")"), F.lit(""),
    )
    row = lambda c: _text("  ", F.rpad(c["category"], 14, " "), " ", _bar(c["score"]), " ", F.lpad(c["score"].cast("string"), 4, " "), "  (", c["flags_decided"], " flags)")
    parts = [head, _section(r["categories"], ["Dimensions"], _lines(r["categories"], row))]
    item = lambda f: _text("  [", F.lpad(f["id"].cast("string"), 2, " "), "] ", f["name"], ": ", f["description"])
    under = lambda f: F.concat(F.array(item(f)), F.transform(F.slice(f["evidence"], 1, 3), lambda e: _text("       -> ", e)))
    parts += [_section(_with_status(r, status), [name], F.flatten(F.transform(_with_status(r, status), under)) if status == TRIGGERED else _lines(_with_status(r, status), item)) for status, name in GROUPS]
    claim = lambda c: _text("  ", F.rpad(c["subtype"], 18, " "), " ", F.rpad(c["value"], 38, " "), " ", c["status"], F.when(c["detail"] != "", _text("\n      ", F.substring(c["detail"], 1, 90))).otherwise(""))
    parts.append(_section(_checked(r), ["Claims looked up"], _lines(F.slice(_checked(r), 1, 14), claim)))
    parts.append(_section(r["sources"], ["Sources"], _lines(F.slice(r["sources"], 1, 5), lambda u: _text("  - ", F.substring(u, 1, 88)))))
    notes = caveats(reported)
    parts.append(_section(notes, ["Before acting on this"], _lines(notes, lambda x: _text("  - ", x))))
    return F.array_join(F.concat(*parts, F.array(F.lit("Leads to check by hand, not a verdict."))), "\n")


STYLE = "body{max-width:50em;margin:2em auto;font:15px/1.5 sans-serif}table{border-collapse:collapse}td,th{padding:.3em .6em;border-bottom:1px solid #ccc;text-align:left}meter{width:14em}.TRIGGERED{border-left:4px solid #b33}.PASSED{border-left:4px solid #2a7}section{padding-left:.8em;margin:.8em 0}"


def html(reported: DataFrame) -> Column:
    r = F.col("report")
    many = lambda items, line: F.array_join(F.transform(items, line), "")
    block = lambda items, title, before, body, after: F.when(F.size(items) > 0, F.concat(F.lit(f"<h2>{title}</h2>{before}"), body, F.lit(after))).otherwise("")
    row = lambda c: _text("<tr><td>", escaped(c["category"]), '</td><td><meter max="100" value="', c["score"], '"></meter></td><td>', c["score"], "</td></tr>")
    item = lambda f: _text('<section class="', f["status"], '"><h3>[', f["id"], "] ", escaped(f["name"]), "</h3><p>weight ", f["weight"], ", ", escaped(f["category"]), "</p><p>", escaped(f["description"]), "</p><ul>", many(F.slice(f["evidence"], 1, 4), lambda e: _text("<li>", escaped(e), "</li>")), "</ul></section>")
    claim = lambda c: _text("<tr><td>", c["subtype"], "</td><td>", escaped(F.substring(c["value"], 1, 60)), "</td><td>", c["status"], "</td><td>", escaped(c["detail"]), "</td></tr>")
    link = lambda u: F.when(F.lower(u).rlike("^https?://"), _text('<li><a rel="noreferrer noopener" href="', escaped(u), '">', escaped(F.substring(u, 1, 100)), "</a></li>")).otherwise(_text("<li>", escaped(F.substring(u, 1, 100)), "</li>"))
    notes, sources = caveats(reported), F.slice(r["sources"], 1, 25)
    return F.concat(
        F.lit(f'<!doctype html><html lang="en"><head><meta charset="utf-8"><style>{STYLE}</style><title>'), escaped(r["target"]), F.lit("</title></head><body><h1>"), escaped(r["target"]), F.lit("</h1><p>"),
        _text(r["timestamp"], ", ", r["mode"], ", ", F.when(r["verified"], "checked with registries").otherwise("not checked with registries"), ", ", r["word_count"], " words</p><p><b>"), r["level"], F.lit(" "), _score(r), F.lit("</b></p><p>"),
        escaped(r["summary"]), _text("</p><p>coverage ", r["evidence_coverage_pct"], "%, specificity ", r["specificity_index"], "</p>"),
        block(notes, "Before acting on this", "<ul>", many(notes, lambda x: _text("<li>", escaped(x), "</li>")), "</ul>"),
        block(r["categories"], "Dimensions", "<table>", many(r["categories"], row), "</table>"),
        *(block(_with_status(r, status), name, "", many(_with_status(r, status), item), "") for status, name in GROUPS),
        block(_checked(r), "Claims", "<table><tr><th>Type</th><th>Claim</th><th>Status</th><th>Result</th></tr>", many(_checked(r), claim), "</table>"),
        block(sources, "Sources", "<ul>", many(sources, link), "</ul>"), F.lit("<footer>Leads to check by hand, not conclusions about a person.</footer></body></html>"),
    )


def latest(reports: DataFrame, most: int = 20) -> DataFrame:
    """The newest reports by file name."""
    return reports.orderBy(F.desc("file_name")).limit(most)


def dimensions(flags: DataFrame) -> DataFrame:
    """Category scores in order of name, numbered for each subject."""
    rows = category_scores(flags, "subject_id")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("subject_id").orderBy("category")))
