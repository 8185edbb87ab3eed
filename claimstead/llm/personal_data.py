"""Personal data, with DataFrame functions alone.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs), and words near
a span raise or lower its score. Spans of the base kinds that pass their check always stay; the added kinds
(iban, ssn) stay from a score of LEAST on.

A regular expression gives no offsets here, so they are summed from the lengths of what lies between the
matches. Documents are first asked with one cheap search for each kind whether it can occur at all. The
patterns are written so that the regular-expression engine neither backtracks over a long run nor recurses
once for each repetition: a run is entered at its start only (or where the match before has ended), and
repetitions are possessive. They match what the plain patterns in BASE match.

Defined results: null text is empty and has no spans; repeated rows stand each for itself; other columns
are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The plain patterns of the base kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
LEAST = 50

_RUN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE["phone"],
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text with a span of the kind contains, in one search without groups.
_CAN = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
#: Score without context, and the words near a span that raise or lower it.
_SCORE = {"email": 80, "ip": 60, "card": 80, "phone": 60, "iban": 80, "ssn": 40}
_RAISE = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|login",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social security|tax id|insured",
}
_LOWER = "example|version|isbn|order|serial"
_NEAR = 40

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:int>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def doubled(x: Column) -> Column:
        return F.when(x > 4, 2 * x - 9).otherwise(2 * x)

    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 1, doubled(x.cast("int"))).otherwise(x.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks has its check digits right."""
    turned = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")
    value = F.transform(turned, lambda x: F.when(x.between("0", "9"), x.cast("int")).otherwise(F.ascii(x) - 55))
    return F.aggregate(value, F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97) == 1


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda x: ~x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _found(kind: str, text: Column) -> Column:
    pattern = F.lit(_RUN[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.slice(F.split(text, _RUN[kind], -1), 1, F.size(matches))
    steps = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), matches.alias("match"))
    none = F.expr("CAST(array() AS array<struct<start:int,match:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), x["match"].alias("match"))
        return F.struct((start + F.length(x["match"])).alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]

    def span(x: Column) -> Column:
        end = x["start"] + F.length(x["match"])
        before = F.greatest(x["start"] - _NEAR, F.lit(0))
        near = F.lower(F.concat_ws(" ", F.substring(text, before + 1, x["start"] - before), F.substring(text, end + 1, F.lit(_NEAR))))
        score = _SCORE[kind] + F.when(near.rlike(_RAISE[kind]), 20).otherwise(0) - F.when(near.rlike(_LOWER), 20).otherwise(0)
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    spans = F.transform(F.filter(found, lambda x: _valid(kind, x["match"])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= LEAST)
    return F.when(_CAN[kind](text), spans.cast(_SPAN)).otherwise(F.expr(f"CAST(array() AS {_SPAN})"))


def personal_spans(text: Column) -> Column:
    """All spans of a text that isn't null, by start and kind: start, rank of the kind, end, kind, score (percent)."""
    return F.array_sort(F.concat(*(_found(k, text) for k in KINDS)))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text (null: empty), spans."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("spans", personal_spans(F.col("text")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
