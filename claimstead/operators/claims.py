"""Typed claims in free text: identifiers, degrees, roles, partnerships, traction and dates.

A text's claims are one array column in order of emission, built from the built-in regular-expression and
array functions alone, so extraction is a projection. Whoever reads the claims more than once keeps them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimstead.functions.terms import matches, negated, word_count
from claimstead.functions.text import norm_org

# Identifier patterns in order of emission; the group is the identifier.
ARTIFACTS = {
    "doi": r"(?iU)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)",
    "arxiv": r"(?iU)arxiv\.org/abs/(\d{4}\.\d{4,5})",
    "orcid": r"(?iU)\b(?:orcid\.org/)?(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\b",
    "github": r"(?iU)github\.com/([A-Za-z0-9](?:[\w.-]*[A-Za-z0-9])?(?:/[\w.-]+)?)",
    "nct": r"(?iU)\b(NCT\d{8})\b",
    "patent": r"(?U)\b((?:US|EP|WO)\s?\d{7,11}(?:\s?[ABC]\d?)?)\b",
}
# Unsourced assertions of evidence.
ASSERTIONS = {
    "regulatory clearance": r"(?iU)\b(?:FDA|CE)[\s-](?:cleared|approved|marking|marked|certified)\b",
    "peer-review claim": r"(?iU)\bpeer[\s-]reviewed\b",
    "ISO certification": r"(?iU)\bISO\s?\d{4,5}\b",
}
# Institutions in several languages, degrees, organisations, figures and dates.
_TYPES = (
    r"Universit\w*|Uniwersytet\w*|Universidad\w*|Universidade\w*|Institut\w*|Hochschule\w*|Fachhochschule\w*|Hogeschool\w*|Polytechni\w*|Politecnico\w*"
    r"|Coll[eè]g\w*|Colegio\w*|Escuela\w*|[EÉ]cole\w*|Lyc[eé]e\w*|Facult[eé]\w*|Conservatoire\w*|Akadem\w*|Academ\w*|Gymnasi\w*|School\w*"
)
_NAME = r"(?:[A-Z][\w-]*\s+){0,3}(?:" + _TYPES + r")(?:\s+(?:of|de|des|der|van|voor|di|du|und|et|en|för|für)\s+[A-Z][\w-]*(?:\s+[A-Z][\w-]*){0,2})?"
INSTITUTION = rf"(?U)\b({_NAME})\b"
DEGREE = (
    r"(?iU)\b(MSc|M\.Sc\.|BSc|B\.Sc\.|PhD|Ph\.D\.|MBA|MEng|BEng|LLM|LLB|Master(?:'s)?|Bachelor(?:'s)?|Doctorate|Doctor)\b"
    r"(?:[\s,]+(?:of\s+|in\s+)?(?!from\b|at\b|and\b|with\b)([A-Za-z][A-Za-z&\- ]{1,60}?)(?=\s*(?:[,;.]|\bat\b|\bfrom\b|\band\b|$)))?"
    rf"(?:\s*(?:,|\bat\b|\bfrom\b)\s*({_NAME})\b)?"
)
_CAPS = r"([A-Z][\w&-]*(?:[ \t][A-Z][\w&-]*){0,3})"
LEADERSHIP = r"(?U)\b(CEO|CTO|President|Founder|Co-founder|Chairman|Managing Director|Head of [A-Z]\w+)\b\s*(?:of|at|@)\s+" + _CAPS
OWNED = r"(?U)(?iu:founder|co-founder|founded|president|created|established|my company|chairman|owner|ceo|cto)\s+(?iu:(?:and\s+\w+\s+)?(?:of|at|@))\s+" + _CAPS
PARTNER = r"(?U)(?iu:partner(?:ship|ed|s)?|collaborat\w+|mou|alliance|consortium|agreement|teamed\s+up)\s+(?iu:with|between)\s+(?!(?:Dr|Mr|Mrs|Ms|Prof|Sir|Dame|Rev|The)\b)" + _CAPS
TRACTION = r"(?iU)([€$£]?\s?\d[\d,.]{0,24}\s?(?:k|m|bn|million|billion)?)\s*(customers|clients|users|subscribers|revenue|arr|mrr|employees|units|installations)"
QUANTITY = r"(?iU)\b(\d[\d,.]{0,24}\s?(?:MHz|GHz|kHz|km|kg|nm|mm|hours?|days?|%))\b"
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "twenty-five": 25, "thirty": 30, "forty": 40, "fifty": 50,
}
EXPERIENCE = (
    r"(?iU)\b(\d{1,2}|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + r")\+?\s*years?\s+(?:of\s+)?"
    r"(?:experience|expertise|as\b|in\b|working|building|leading|developing|designing|managing|practising|practicing|teaching|researching)"
)
YEAR = r"(?U)\b(19[5-9]\d|20[0-4]\d)\b"
FORWARD = (
    r"(?iU)\b(?:by|target(?:ed|ing)?|projected|expected|planned|planning|roadmap|horizon|due|forecast|goal|aim(?:ing)?|launch(?:ing)?|shipping|will|anticipated"
    r"|scheduled|from now until|through)\b[^.;\n]{0,40}$"
)
DETAIL = r"(?iU)\b\d[\d,.]*\s?(?:%|€|\$|£|k\b|m\b|users|employees|patients|units|customers)"
LINK = r"(?iU)\bhttps?://\S+"
HARD = ["doi", "orcid", "github", "arxiv", "nct", "patent"]

CLAIM = "array<struct<kind:string,subtype:string,value:string,context:string,negated:boolean>>"
#: Characters of context on either side of a match.
AROUND = 30


def _claim(kind: str, subtype: Column | str, value: Column, context: Column, denied: Column | None = None) -> Column:
    subtype = F.lit(subtype) if isinstance(subtype, str) else subtype
    denied = F.lit(False) if denied is None else denied
    return F.struct(F.lit(kind).alias("kind"), subtype.alias("subtype"), value.alias("value"), context.alias("context"), denied.alias("negated"))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _found(text: Column, pattern: str) -> Column:
    """Start, end and first group of each match; texts without any aren't cut up."""
    return F.when(text.rlike(pattern), matches(text, pattern, 1)).otherwise(F.expr("CAST(array() AS array<struct<start:int,end:int,match:string>>)"))


def _around(text: Column, m: Column) -> Column:
    """What surrounds a match, with white space collapsed."""
    low = F.greatest(m["start"] - AROUND, F.lit(0))
    return F.trim(F.regexp_replace(F.substring(text, low + 1, m["end"] + AROUND - low), r"(?U)\s+", " "))


def _identifier(found: Column) -> Column:
    """Without the punctuation after it."""
    return F.regexp_replace(F.trim(found), "[.,;)]+$", "")


def artifacts(text: Column, subtype: str) -> Column:
    """Identifiers of a kind."""
    return F.transform(_all(text, ARTIFACTS[subtype]), _identifier)


def assertions(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(rx), F.lit(label)) for label, rx in ASSERTIONS.items())))


def degrees(text: Column) -> Column:
    """array<struct<value, inst>>: level with field, and the institution tied to it or empty."""
    parts = F.arrays_zip(_all(text, DEGREE).alias("level"), _all(text, DEGREE, 2).alias("field"), _all(text, DEGREE, 3).alias("inst"))

    def one(x: Column) -> Column:
        field = F.btrim(x["field"], F.lit(" ,."))
        value = F.trim(F.concat_ws(" ", x["level"], F.nullif(field, F.lit(""))))
        return F.struct(value.alias("value"), F.trim(x["inst"]).alias("inst"))

    return F.transform(parts, one)


def institutions(text: Column) -> Column:
    return F.transform(_all(text, INSTITUTION), lambda v: F.trim(v))


def leadership(text: Column) -> Column:
    return F.transform(F.arrays_zip(_all(text, LEADERSHIP).alias("t"), _all(text, LEADERSHIP, 2).alias("o")), lambda x: F.concat(x["t"], F.lit(" of "), x["o"]))


def owned(text: Column) -> Column:
    return _all(text, OWNED)


def partners(text: Column) -> Column:
    return _all(text, PARTNER)


def _nothing(text: Column, m: Column) -> Column:
    """Whether a figure is zero or denied."""
    return F.trim(m["match"]).rlike(r"^[€$£]?\s?0+([.,]0+)?$") | negated(text, m["start"])


def traction(text: Column) -> Column:
    """array<struct<value, noun, negated>>; none or zero of something is denied."""
    found = F.arrays_zip(matches(text, TRACTION, 1).alias("m"), _all(text, TRACTION, 2).alias("noun"))

    def one(x: Column) -> Column:
        return F.struct(F.concat(F.trim(x["m"]["match"]), F.lit(" "), x["noun"]).alias("value"), F.lower(x["noun"]).alias("noun"), _nothing(text, x["m"]).alias("negated"))

    return F.when(text.rlike(TRACTION), F.transform(found, one)).otherwise(F.expr("CAST(array() AS array<struct<value:string,noun:string,negated:boolean>>)"))


def experience(text: Column) -> Column:
    return _all(text, EXPERIENCE)


def experience_years(raw: Column) -> Column:
    """'15' or 'fifteen' as a number; null for anything else."""
    words = F.create_map(*(F.lit(x) for pair in NUMBER_WORDS.items() for x in pair))
    said = F.lower(F.trim(raw))
    return F.coalesce(F.when(said.rlike("^[0-9]+$"), F.try_to_number(said, F.lit("9999")).cast("int")), F.try_element_at(words, said))


def _blanked(text: Column, identifiers: list[Column], amounts: Column, measures: Column) -> Column:
    """All of a text that matches cover turned into blanks; of amounts the first group, which is where they begin."""
    whole = lambda m: F.struct(m["start"].alias("start"), (m["end"] - m["start"]).alias("size"))
    first = lambda m: F.struct(m["start"].alias("start"), F.length(m["match"]).alias("size"))
    spans = F.concat(F.transform(F.concat(*identifiers, measures), whole), F.transform(amounts, first))
    return F.aggregate(spans, text, lambda acc, x: F.overlay(acc, F.repeat(F.lit(" "), x["size"]), x["start"] + 1, x["size"]))


def masked(text: Column) -> Column:
    """The text with identifiers, amounts and measures blanked, so that their digits aren't read as years.

    All are looked for in the text as it is; what any of them covers is blanked.
    """
    return _blanked(text, [_found(text, p) for p in ARTIFACTS.values()], _found(text, TRACTION), _found(text, QUANTITY))


def years(clean: Column) -> Column:
    """array<struct<value, target, start, end>> of a masked text; target: stated as a goal."""

    def one(m: Column) -> Column:
        before = F.substring(clean, F.greatest(m["start"] - 60, F.lit(0)) + 1, F.least(m["start"], F.lit(60)))
        return F.struct(m["match"].alias("value"), before.rlike(FORWARD).alias("target"), m["start"].alias("start"), m["end"].alias("end"))

    return F.transform(matches(clean, YEAR), one)


def _distinct(claims: Column) -> Column:
    """The first of claims that say the same, in order: a stable sort by what they say, of which each first stays."""
    key = lambda c: F.concat_ws("\0", c["kind"], c["subtype"], F.lower(c["value"]))
    said = F.array_sort(F.transform(claims, lambda c, i: F.struct(key(c).alias("key"), i.alias("at"))))
    first = F.filter(said, lambda x, i: (i == 0) | (F.get(said, i - 1)["key"] != x["key"]))
    places = F.array_sort(F.transform(first, lambda x: x["at"]))
    return F.when(F.size(places) == F.size(claims), claims).otherwise(F.transform(places, lambda i: F.get(claims, i)))


_ONCE = {"institution": INSTITUTION, "leadership": LEADERSHIP, "owned_org": OWNED, "partner_org": PARTNER, "traction": TRACTION, "quantity": QUANTITY, "experience": EXPERIENCE, "degree": DEGREE}


def with_claims(subjects: DataFrame) -> DataFrame:
    """Adds `claims` to rows with a text (null: none): array of kind, subtype, value, context, negated, first of equal ones only.

    Every pattern is looked for once; values, contexts and what is no date all come from its matches.
    """
    text = F.col("_text")
    rows = subjects.withColumn("_text", F.coalesce("text", F.lit("")))
    at = {name: f"_at_{name}" for name in [*ARTIFACTS, *_ONCE]}
    rows = rows.withColumns({at[name]: _found(text, p) for name, p in {**ARTIFACTS, **_ONCE}.items()})
    m = {name: F.col(c) for name, c in at.items()}
    blank = _blanked(text, [m[s] for s in ARTIFACTS], m["traction"], m["quantity"])
    degree = F.arrays_zip(m["degree"].alias("m"), _all(text, DEGREE, 2).alias("field"), _all(text, DEGREE, 3).alias("inst"))
    some = lambda name, value: F.when(F.size(m[name]) > 0, value).otherwise(F.lit(None))
    rows = rows.withColumns({"_masked": blank, "_degrees": some("degree", degree)})
    said = lambda kind, subtype, name, value=lambda x: x["match"]: F.transform(m[name], lambda x: _claim(kind, subtype, value(x), _around(text, x)))
    parts = [said("artifact", s, s, lambda x: _identifier(x["match"])) for s in ARTIFACTS]
    parts += [F.when(text.rlike(p), F.array(_claim("artifact", "assertion", F.lit(s), _around(text, F.get(matches(text, p), F.lit(0)))))).otherwise(F.expr(f"CAST(array() AS {CLAIM})")) for s, p in ASSERTIONS.items()]
    held = F.coalesce("_degrees", F.expr("CAST(array() AS array<struct<m:struct<start:int,end:int,match:string>,field:string,inst:string>>)"))
    level = lambda x: F.trim(F.concat_ws(" ", x["m"]["match"], F.nullif(F.btrim(x["field"], F.lit(" ,.")), F.lit(""))))
    both = lambda x: F.array(_claim("degree", "degree", level(x), _around(text, x["m"])), _claim("degree", "degree_institution", F.trim(x["inst"]), _around(text, x["m"])))
    parts.append(F.filter(F.flatten(F.transform(held, both)), lambda c: c["value"] != ""))
    tied = F.transform(held, lambda d: F.trim(d["inst"]))
    parts.append(F.filter(said("degree", "mentioned_institution", "institution", lambda x: F.trim(x["match"])), lambda c: ~F.array_contains(tied, c["value"])))
    led = F.arrays_zip(m["leadership"].alias("m"), _all(text, LEADERSHIP, 2).alias("o"))
    parts.append(F.transform(F.filter(led, lambda x: x["m"].isNotNull()), lambda x: _claim("role", "leadership", F.concat(x["m"]["match"], F.lit(" of "), x["o"]), _around(text, x["m"]))))
    parts += [said("role", "owned_org", "owned_org"), said("partnership", "partner_org", "partner_org")]
    figures = F.arrays_zip(m["traction"].alias("m"), _all(text, TRACTION, 2).alias("noun"))
    parts.append(F.transform(F.filter(figures, lambda x: x["m"].isNotNull()), lambda x: _claim("traction", F.lower(x["noun"]), F.concat(F.trim(x["m"]["match"]), F.lit(" "), x["noun"]), _around(text, x["m"]), _nothing(text, x["m"]))))
    parts.append(said("timeline", "claimed_experience_years", "experience"))
    parts.append(F.transform(years(F.col("_masked")), lambda y: _claim("timeline", F.when(y["target"], "year_target").otherwise("year"), y["value"], _around(text, y))))
    rows = rows.withColumn("_all", F.concat(*(p.cast(CLAIM) for p in parts)))
    return rows.withColumn("claims", _distinct(F.col("_all"))).drop("_text", "_degrees", "_masked", "_all", *at.values())


def claims_by(claims: Column, kind: str | None = None, *subtypes: str) -> Column:
    return F.filter(claims, lambda c: (c["kind"] == kind if kind else F.lit(True)) & (c["subtype"].isin(*subtypes) if subtypes else F.lit(True)))


def values_of(claims: Column, *subtypes: str) -> Column:
    return F.transform(claims_by(claims, None, *subtypes), lambda c: c["value"])


def exploded(subjects: DataFrame, *keep: str) -> DataFrame:
    """A row for each claim, with its place `ord` from 0.

    The outer form: for the inner one the optimizer would put a filter on the array, and with it the whole
    extraction, below every step of it.
    """
    return subjects.select(*keep, F.posexplode_outer("claims").alias("ord", "c")).where("c is not null").select(*keep, "ord", "c.*")


def owned_orgs(claims: Column) -> Column:
    """Organisations the subject leads, normalised: those owned first, then those of leading roles."""
    led = F.transform(values_of(claims, "leadership"), lambda v: F.regexp_replace(v, "^.*? of ", ""))
    return F.array_distinct(F.transform(F.concat(values_of(claims, "owned_org"), led), norm_org))


def partner_orgs(claims: Column) -> Column:
    return F.array_distinct(F.transform(values_of(claims, "partner_org"), norm_org))


def overlap(claims: Column) -> Column:
    return F.array_intersect(owned_orgs(claims), partner_orgs(claims))


def specificity(text: Column) -> Column:
    """Checkable details for each hundred words, to two places."""
    patterns = [YEAR, DETAIL, LINK, INSTITUTION, *ARTIFACTS.values()]
    n = sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))
    return F.bround(n / F.greatest(word_count(text), F.lit(1)) * 100, 2)
