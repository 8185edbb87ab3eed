"""Whole-word term matching as column expressions.

A text is cut into words once, and runs of its words are intersected with all terms asked for, so the work
doesn't grow with the number of terms. Offsets, and with them negation, are worked out for the terms that are
there, not for all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimstead.functions.banks import CLAUSE_ENDS, CLAUSE_NEGATORS, CLAUSE_TOKENS, LOCAL_NEGATORS, LOCAL_TOKENS, LOOK_BACK


def _escaped(word: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", word)


def body_of(term: str) -> str:
    """A term's words with any run of blanks or hyphens between them."""
    words = [w for w in re.split(r"[\s\-]+", term.strip()) if w] or [term.strip()]
    return r"[\s\-]+".join(map(_escaped, words))


def pattern_of(term: str) -> str:
    return rf"(?iU)(?<!\w){body_of(term)}(?!\w)"


def any_of(terms: list[str]) -> str:
    return rf"(?iU)(?<!\w)(?:{'|'.join(map(body_of, terms))})(?!\w)"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def matches(text: Column, pattern: Column | str, group: int = 0) -> Column:
    """array<struct<start, end, match>> of all matches, in code points from 0."""
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, rx, F.lit(0))
    between = F.slice(F.split(text, rx, F.lit(-1)), 1, F.size(found))
    named = found if group == 0 else F.regexp_extract_all(text, rx, F.lit(group))
    steps = F.arrays_zip(F.transform(between, lambda x: F.length(x)).alias("gap"), F.transform(found, lambda x: F.length(x)).alias("size"), named.alias("match"))
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,match:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value written and worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def negated(text: Column, start: Column) -> Column:
    """Whether what begins at `start` is denied earlier in its clause."""
    ends = "".join("\\" + c if c in ".?|" else c for c in CLAUSE_ENDS)
    lists = lambda xs: F.array(*map(F.lit, xs))

    def denied(words: Column) -> Column:
        last = lambda n: F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))
        return F.arrays_overlap(last(CLAUSE_TOKENS), lists(CLAUSE_NEGATORS)) | F.arrays_overlap(last(LOCAL_TOKENS), lists(LOCAL_NEGATORS))

    def of_clause(clause: Column) -> Column:
        # a window that opens inside a word loses that word
        cut = (F.length(clause) == LOOK_BACK) & (start > LOOK_BACK) & F.substring(text, start - LOOK_BACK, F.lit(1)).rlike(r"(?U)\w")
        words = F.regexp_extract_all(F.replace(F.lower(clause), F.lit("'"), F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))
        whole = lambda w: F.when(cut, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)
        return _bound(_bound(words, whole), denied)

    before = F.substring(text, F.greatest(start - LOOK_BACK, F.lit(0)) + 1, F.least(start, F.lit(LOOK_BACK)))
    return _bound(F.regexp_extract(before, f"[^{ends}]*$", 0), of_clause)


_NONE = "CAST(array() AS array<string>)"
_WORD = r"\w+|[^\w\s\-]"


def _gram(term: str) -> str:
    return " ".join(re.findall(_WORD, term.lower()))


def _plain(term: str) -> bool:
    """Words alone: then a term is where its words follow each other with only blanks or hyphens between."""
    return bool(_gram(term)) and not re.search(r"[^\w\s\-]", term)


def _literal(values: list) -> Column:
    kind = "array<string>" if not values or isinstance(values[0], str) else "array<struct<key:string,term:string,gram:string>>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def _grams(text: Column, most: int) -> Column:
    """All runs of up to `most` words of a text, folded; a mark between words parts them."""

    def of_words(words: Column) -> Column:
        runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.concat(words, *(F.when(F.size(words) >= n, runs(n)).otherwise(F.expr(_NONE)) for n in range(2, most + 1)))

    return _bound(F.regexp_extract_all(F.lower(text), F.lit("(?U)" + _WORD), F.lit(0)), of_words)


def _present(text: Column, banks: dict[str, list[str]]) -> Column:
    """array<struct<key, term>> of the terms there are, in order: one pass over the text, whatever the number of terms.

    Terms with marks in them are asked for one by one.
    """
    rows = [{"key": k, "term": t, "gram": _gram(t)} for k, terms in banks.items() for t in terms if _plain(t)]
    odd = [(k, t) for k, terms in banks.items() for t in terms if not _plain(t)]
    out = F.expr(_HITS)
    if rows:
        grams = sorted({r["gram"] for r in rows})
        found = F.array_intersect(_literal(grams), _grams(text, max(g.count(" ") + 1 for g in grams)))
        pick = lambda hit: F.transform(F.filter(_literal(rows), lambda x: F.array_contains(hit, x["gram"])), lambda x: F.struct(x["key"].alias("key"), x["term"].alias("term")))
        out = _bound(found, lambda hit: F.when(F.size(hit) > 0, pick(hit)).otherwise(F.expr(_HITS)))
    if odd:
        out = F.concat(out, F.array_compact(F.array(*(F.when(text.rlike(pattern_of(t)), F.struct(F.lit(k).alias("key"), F.lit(t).alias("term"))) for k, t in odd))))
    return out


def find_terms(text: Column, terms: list[str], asserted: bool = False) -> Column:
    """The terms there are in the text, in the bank's order; asserted: with an occurrence that isn't denied."""
    if not terms:
        return F.expr(_NONE)
    order = {t: i for i, t in enumerate(terms)}
    hits = (find_many if asserted else _present)(text, {"": terms})
    found = F.transform(hits, lambda x: x["term"])
    if all(map(_plain, terms)) or not any(map(_plain, terms)):
        return found
    at = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
    return F.transform(F.array_sort(F.transform(found, lambda t: F.struct(at[t].alias("at"), t.alias("t")))), lambda x: x["t"])


_HITS = "CAST(array() AS array<struct<key:string,term:string>>)"


def find_many(text: Column, banks: dict[str, list[str]]) -> Column:
    """array<struct<key, term>>: the asserted terms of several banks. One array, so that denial is written once for all.

    Only for terms that are there a pattern is made, to find where.
    """
    return F.filter(_present(text, banks), lambda x: F.exists(matches(text, _pattern_column(x["term"])), lambda m: ~negated(text, m["start"])))


def terms_of(hits: Column, key: str) -> Column:
    return F.transform(F.filter(hits, lambda x: x["key"] == key), lambda x: x["term"])


def _pattern_column(term: Column) -> Column:
    """pattern_of() for a column of terms; terms hold letters, digits, blanks, hyphens, dots and ampersands."""
    words = F.regexp_replace(F.regexp_replace(F.trim(term), r"([.&+*?()])", r"\\$1"), r"[\s\-]+", r"[\\s\\-]+")
    return F.concat(F.lit(r"(?iU)(?<!\w)"), words, F.lit(r"(?!\w)"))


def has_term(text: Column, term: str, asserted: bool = False) -> Column:
    return F.size(find_terms(text, [term], asserted)) > 0


def count_occurrences(text: Column, terms: list[str]) -> Column:
    """All matches over all terms; of nested terms each counts."""
    return sum((F.regexp_count(text, F.lit(pattern_of(t))) for t in terms), F.lit(0))


def find_non_overlapping(text: Column, terms: list[str]) -> Column:
    """struct<terms, hits>: asserted matches that don't overlap, the earliest and then longest first; distinct terms in order."""
    order = F.array(*map(F.lit, terms))
    spans = F.flatten(
        F.transform(
            find_terms(text, terms),
            lambda t: F.transform(
                F.filter(matches(text, _pattern_column(t)), lambda m: ~negated(text, m["start"])),
                lambda m: F.struct(m["start"].alias("start"), (m["start"] - m["end"]).alias("less"), F.array_position(order, t).alias("ord"), m["end"].alias("end"), t.alias("term")),
            ),
        )
    )

    def step(acc: Column, x: Column) -> Column:
        free = x["start"] >= acc["last"]
        return F.struct(F.when(free, x["end"]).otherwise(acc["last"]).alias("last"), F.when(free, F.concat(acc["out"], F.array(x["term"]))).otherwise(acc["out"]).alias("out"))

    chosen = F.aggregate(F.array_sort(spans), F.struct(F.lit(-1).alias("last"), F.expr(_NONE).alias("out")), step)["out"]
    return F.struct(F.array_distinct(chosen).alias("terms"), F.size(chosen).alias("hits"))
