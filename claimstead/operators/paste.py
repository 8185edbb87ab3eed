"""Pasted profiles: recognising one, finding its sections and entries, and writing it as prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Section headers with their place in a profile's layout.
SECTIONS = {
    "about": 1, "activity": 2, "experience": 3, "education": 4, "licenses & certifications": 5, "certifications": 5, "volunteer experience": 6, "volunteer": 6, "skills": 7,
    "recommendations": 8, "publications": 9, "patents": 9, "courses": 9, "projects": 9, "honors & awards": 9, "test scores": 9, "languages": 9, "organizations": 9, "interests": 10,
}
# Dates, forms of employment, and lines of the page's furniture.
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = rf"(?i){_MONTH}\s+\d{{4}}\s*[-–—]\s*(?:{_MONTH}\s+\d{{4}}|Present)(?:\s*·\s*\d+\s*(?:yr|mo|year|month)s?(?:\s+\d+\s*(?:yr|mo|year|month)s?)?)?"
YEARS = r"(?i)^\d{4}\s*[-–—]\s*(?:\d{4}|Present)$"
EMPLOYMENT = r"(?i)\s*·\s*(?:Full-time|Part-time|Self-employed|Freelance|Contract|Internship|Apprenticeship|Seasonal|Temporary)\s*$"
# Lines that are the page's and not the profile's; each pattern begins where the line does.
CHROME_LINES = [
    r"(?i)(?:Message|Follow|Connect|More)$",
    r"(?i)\d+\+?\s*connections?$",
    r"(?:1st|2nd|3rd)$",
    r"(?i)See all\b",
    r"(?i)Show \d+ more\b",
    r"(?i)\d+\+?\s*endorsements?$",
    r"(?i)People also viewed$",
    r"(?i)Show credential",
    r"(?i)Open to\b",
    r"(?i)Report\s*/\s*Block$",
    r"(?i)(?:Like|Comment|Repost|Send|Agree)$",
    r"(?i)(?:Reactions?|Comments?|Reposts?)$",
    r"(?i)Mutual connections?$",
    r"(?i)\d+\s*(?:Like|Comment|Repost)s?$",
    r"(?i)(?:\.{2,}|…)see more$",
]
CHROME = "^(?:" + "|".join(f"(?:{p})" for p in CHROME_LINES) + ")"
DURATION = r"(?i)(?:(\d+)\s*(?:yr|year)s?(?:\s+(\d+)\s*(?:mo|month)s?)?|(\d+)\s*(?:mo|month)s?)"
_LEVEL = (
    r"MSc|M\.Sc\.|BSc|B\.Sc\.|PhD|Ph\.D\.|MBA|MEng|BEng|LLM|LLB|Master(?:'s)?(?:\s+of\s+\w+)?|Bachelor(?:'s)?(?:\s+of\s+\w+)?|Master of Science|Master of Arts"
    r"|Master of Business Administration|Bachelor of Science|Bachelor of Arts|Bachelor of Engineering|Doctor of Philosophy|Doctorate|Doctor"
)
DEGREE_LEVEL = rf"(?i)^({_LEVEL})$"
DEGREE_FIELD = rf"(?i)^({_LEVEL})(?:\s*[,·]\s*|\s+in\s+|\s+of\s+)(.+)$"
ENDORSED = r"(?i)\s*·?\s*\d+\+?\s*endorsements?\s*$"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")


def is_chrome(line: Column) -> Column:
    return F.trim(line).rlike(CHROME)


def paste_score(text: Column) -> Column:
    lines = F.transform(lines_of(text), lambda x: F.trim(x))
    has = lambda word: F.exists(lines, lambda x: F.lower(x) == word)
    points = [(has("experience"), 2), (has("education"), 2), (has("skills"), 1), (has("about"), 1), (text.rlike(DATES), 2), (text.rlike("(?m)" + EMPLOYMENT), 1)]
    points += [(F.exists(lines, lambda x: x.rlike(YEARS)), 1), (F.size(F.filter(lines, is_chrome)) >= 2, 1)]
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


def is_paste(text: Column) -> Column:
    named = F.exists(lines_of(text), lambda x: F.lower(F.trim(x)).isin("experience", "education"))
    return F.coalesce((F.length(text) >= 50) & (paste_score(text) >= 4) & named, F.lit(False))


def duration_text(said: Column) -> Column:
    """'6 yrs 6 mos' as '6 years 6 months'; empty where there is none."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(said, DURATION, i), F.lit("")).cast("int"), F.lit(0))
    y = part(1)
    m = F.when(y == 0, F.greatest(part(2), part(3))).otherwise(part(2))
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    whole = F.concat(y.cast("string"), F.lit(" years "), m.cast("string"), F.lit(" months"))
    return F.when((y > 0) & (m > 0), whole).when(y > 0, plural(y, "year")).when(m > 0, plural(m, "month")).otherwise("")


def sectioned(pastes: DataFrame, *keep: str) -> DataFrame:
    """A row for each content line: section and place. A header counts only where it goes on in the layout.

    What has been passed is the largest rank so far, so acceptance is a running maximum, and a line's section
    is the last accepted header above it.
    """
    rank = F.try_element_at(F.create_map(*(F.lit(x) for p in SECTIONS.items() for x in p)), F.lower(F.trim("line")))
    rows = pastes.select(*keep, F.posexplode(lines_of(F.col("text"))).alias("place", "line")).withColumn("rank", rank)
    w = Window.partitionBy(*keep).orderBy("place")
    before = F.coalesce(F.max("rank").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("opens", F.coalesce(F.col("rank") >= before, F.lit(False)))
    section = F.last(F.when(F.col("opens"), F.lower(F.trim("line"))), ignorenulls=True).over(w)
    return rows.withColumn("section", F.coalesce(section, F.lit("_preamble"))).where(~F.col("opens")).select(*keep, "section", "place", "line")


def section_lines(pastes: DataFrame, key: str) -> DataFrame:
    """For each paste a map of its sections to their lines in order."""
    lines = sectioned(pastes, key).groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    return lines.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", "lines"))).alias("sections"))


def _groups(lines: Column) -> Column:
    """Lines between blank ones, without furniture; groups left empty go."""
    start = F.expr("CAST(array(array()) AS array<array<string>>)")

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        head = F.slice(acc, 1, F.size(acc) - 1)
        grown = F.concat(head, F.array(F.concat(last, F.array(F.trim(line)))))
        return F.when(F.trim(line) == "", F.concat(acc, F.expr("CAST(array(array()) AS array<array<string>>)"))).when(is_chrome(line), acc).otherwise(grown)

    return F.filter(F.aggregate(F.coalesce(lines, F.expr("CAST(array() AS array<string>)")), start, step), lambda g: F.size(g) > 0)


def _line(lines: Column, i: int) -> Column:
    return F.coalesce(F.get(lines, F.lit(i)), F.lit(""))


def experiences(lines: Column) -> Column:
    """Entries of an experience section: title, company, date_range, duration, location, description."""
    dated = lambda g: F.exists(g, lambda x: x.rlike(DATES))
    none = F.expr("CAST(array() AS array<array<string>>)")

    def join(acc: Column, g: Column) -> Column:  # what has no date belongs to the entry before
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), g)))
        return F.when((F.size(acc) > 0) & ~dated(g), joined).otherwise(F.concat(acc, F.array(g)))

    def entry(g: Column) -> Column:
        at = F.array_position(F.transform(g, lambda x: x.rlike(DATES)), True).cast("int")
        pre = F.when(at > 0, F.slice(g, 1, F.greatest(at - 1, F.lit(0)))).otherwise(F.slice(g, 1, 2))
        post = F.when(at > 0, F.slice(g, at + 1, F.size(g))).otherwise(F.expr("CAST(array() AS array<string>)"))
        said = F.regexp_extract(F.when(at > 0, F.get(g, at - 1)).otherwise(""), DATES, 0)
        first = _line(post, 0)
        place = (first != "") & (F.length(first) < 60) & (F.contains(first, F.lit(",")) | F.lower(first).rlike("remote|hybrid|area"))
        company = F.when(at > 0, F.trim(F.regexp_replace(_line(pre, 1), EMPLOYMENT, ""))).otherwise(_line(pre, 1))
        duration = F.when(F.contains(said, F.lit("·")), duration_text(F.regexp_extract(said, "·(.*)$", 1))).otherwise("")
        rest = F.array_join(F.when(place, F.slice(post, 2, F.size(post))).otherwise(post), " ")
        return F.struct(
            _line(pre, 0).alias("title"), company.alias("company"), F.trim(F.regexp_replace(said, "·.*$", "")).alias("date_range"),
            duration.alias("duration"), F.when(place, first).otherwise("").alias("location"), rest.alias("description"),
        )

    return F.filter(F.transform(F.aggregate(_groups(lines), none, join), entry), lambda e: e["title"] != "")


def educations(lines: Column) -> Column:
    """Entries of an education section: institution, degree, field_of_study, years, description."""
    blank = F.struct(*(F.lit("").alias(c) for c in ("degree", "field_of_study", "years", "description")))

    def step(e: Column, x: Column) -> Column:
        field = (e["degree"] == "") & x.rlike(DEGREE_FIELD)
        level = (e["degree"] == "") & x.rlike(DEGREE_LEVEL)
        study = (e["field_of_study"] == "") & (F.length(x) < 60) & F.substring(x, 1, 1).rlike(r"\p{Lu}") & ~F.startswith(F.lower(x), F.lit("activities"))
        more = e.withField("description", F.trim(F.concat(e["description"], F.lit(" "), x)))
        both = e.withField("degree", F.trim(F.regexp_extract(x, DEGREE_FIELD, 1))).withField("field_of_study", F.trim(F.regexp_extract(x, DEGREE_FIELD, 2)))
        return F.when(x.rlike(YEARS), e.withField("years", x)).when(field, both).when(level, e.withField("degree", x)).when(study, e.withField("field_of_study", x)).otherwise(more)

    def entry(g: Column) -> Column:
        e = F.aggregate(F.slice(g, 2, F.size(g)), blank, step)
        return F.struct(_line(g, 0).alias("institution"), e["degree"].alias("degree"), e["field_of_study"].alias("field_of_study"), e["years"].alias("years"), e["description"].alias("description"))

    return F.transform(_groups(lines), entry)


def skills(lines: Column) -> Column:
    kept = F.filter(F.coalesce(lines, F.expr("CAST(array() AS array<string>)")), lambda x: ~is_chrome(x))
    bare = F.transform(kept, lambda x: F.regexp_replace(F.trim(x), ENDORSED, ""))
    return F.filter(F.flatten(F.transform(bare, lambda x: F.transform(F.split(x, " · "), lambda s: F.regexp_replace(F.trim(s), ENDORSED, "")))), lambda s: s != "")


def parsed(pastes: DataFrame, key: str) -> DataFrame:
    """pastes (key, text) -> key and profile, as sources.corpus.PROFILE has it."""
    rows = section_lines(pastes, key)
    lines = lambda s: F.try_element_at("sections", F.lit(s))
    content = lambda s: F.filter(F.coalesce(lines(s), F.expr("CAST(array() AS array<string>)")), lambda x: (F.trim(x) != "") & ~is_chrome(x))
    top = F.transform(content("_preamble"), lambda x: F.trim(x))
    place = F.filter(F.slice(top, 3, F.greatest(F.size(top), F.lit(1))), lambda x: ~x.rlike(r"(?i)^\d+\+?\s*connections?$") & (F.length(x) < 60))
    about = F.trim(F.regexp_replace(F.trim(F.array_join(content("about"), "\n")), r"(?i)\s*(?:\.{2,}|…)see more\s*$", ""))
    return rows.select(key, F.struct(
        _line(top, 0).alias("name"), _line(top, 1).alias("headline"), about.alias("about"), _line(place, 0).alias("location"), F.lit("linkedin-paste").alias("source"),
        skills(lines("skills")).alias("skills"), experiences(lines("experience")).alias("experiences"), educations(lines("education")).alias("educations"),
    ).alias("profile"))


def prose(p: Column) -> Column:
    """A profile as sentences: degrees beside their institution, titles beside their company."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    pre = lambda mark, c, end="": F.when(has(c), F.concat(F.lit(mark), c, F.lit(end))).otherwise("")

    def job(e: Column) -> Column:
        at = F.when(has(e["title"]), F.concat(e["title"], pre(" at ", e["company"]))).otherwise(F.coalesce(e["company"], F.lit("")))
        return F.concat(at, pre(", ", e["date_range"]), pre(" (", e["duration"], ")"), F.lit("."), pre(" ", e["description"]))

    def study(e: Column) -> Column:
        what = F.array_join(F.filter(F.array(e["degree"], e["field_of_study"]), has), " ")
        where = F.array_join(F.filter(F.array(what, e["institution"]), has), " at ")
        line = F.trim(F.concat(where, pre(" (", e["years"], ")")))
        return F.filter(F.array(F.when(has(line), F.concat(line, F.lit("."))).otherwise(""), F.coalesce(e["description"], F.lit(""))), has)

    ends = F.when(F.size(p["skills"]) > 0, F.array(F.concat(F.lit("Skills: "), F.array_join(p["skills"], ", "), F.lit(".")))).otherwise(F.expr("CAST(array() AS array<string>)"))
    head = F.filter(F.array(pre("", p["headline"], "."), F.coalesce(p["about"], F.lit(""))), has)
    return F.array_join(F.concat(head, F.transform(p["experiences"], job), F.flatten(F.transform(p["educations"], study)), ends), "\n")
