"""Names of people and organisations. Unicode decomposition has no built-in here, so folding is an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a name that identify nobody, and letters that don't decompose.
PARTICLES = [
    "de", "del", "della", "der", "den", "van", "von", "vander", "vande", "da", "di", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "op", "st",
    "dr", "prof", "mr", "ms", "mrs", "phd", "msc", "bsc", "md", "jr", "sr", "ii", "iii",
]
FOLDS = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "ı": "i", "ħ": "h", "ŋ": "n"}
# Words of an organisation's name that identify nothing, and beginnings of words of one meaning.
ORG_STOPWORDS = [
    "of", "the", "at", "for", "and", "in", "de", "des", "du", "der", "die", "das", "van", "von", "el", "la", "le", "les", "a", "an", "università", "universite",
]
ORG_STEMS = [
    ("universit", "univ"), ("uniwersytet", "univ"), ("universidad", "univ"), ("universidade", "univ"), ("hochschule", "univ"),
    ("institut", "institut"), ("instituto", "institut"), ("polytech", "polytech"), ("politecnico", "polytech"), ("polytechni", "polytech"),
    ("college", "college"), ("colegio", "college"), ("school", "school"), ("schule", "school"), ("escuela", "school"), ("ecole", "school"),
    ("academy", "academy"), ("akademie", "academy"), ("academia", "academy"),
]

_FOLD = str.maketrans(FOLDS)


def _bare(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).casefold()


def fold(text: str | None) -> str:
    return _bare(text).translate(_FOLD)


def _readings(folded: str) -> tuple[str, str]:
    """As written, and with hyphens and apostrophes inside words closed up."""
    return folded, re.sub(r"(?<=\w)[-'](?=\w)", "", folded)


def _words(folded: str) -> list[str]:
    return re.findall(r"\w+", folded)


def _telling(words: list[str]) -> list[str]:
    return [w for w in words if len(w) > 1 and w not in PARTICLES]


def tokens(name: str | None) -> set[str]:
    return {w for r in _readings(fold(name)) for w in _telling(_words(r))}


def _latin(words) -> bool:
    return any("a" <= c <= "z" for w in words for c in w)


def matched(subject: str | None, candidates: list[str] | None) -> bool | None:
    """Whether the subject is among the candidates; None where that can't be told.

    Two telling words in common say so, and one does where the name has only one. One common word of a longer
    name says so if it is the first or last and some candidate with it has no telling word that isn't the
    subject's (the rest is abbreviated); in the middle it says nothing. Names in different scripts can't be compared.
    """
    own, order = tokens(subject), _telling(_words(fold(subject)))
    listed = [{w for r in _readings(fold(c)) for w in _words(r)} for c in candidates or () if c and c.strip()]
    everything = set().union(*listed)
    if not own or not listed or _latin(own) != _latin(everything):
        return None
    common = own & everything
    if len(own) == 1 or len(common) != 1:
        return bool(common)
    if common.isdisjoint({*order[:1], *order[-1:]}):
        return None
    return any(common <= words and own.issuperset(_telling(words)) for words in listed)


def org_tokens(name: str | None) -> set[str]:
    words = (w for w in _words(_bare(name)) if len(w) > 1 and w not in ORG_STOPWORDS)
    return {next((stem for start, stem in ORG_STEMS if w.startswith(start)), w) for w in words}


@F.pandas_udf(T.StringType())
def name_normalize(name: pd.Series) -> pd.Series:
    return name.map(fold)


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_tokens(name: pd.Series) -> pd.Series:
    return name.map(lambda x: sorted(tokens(x)))


@F.pandas_udf(T.BooleanType())
def name_matches(subject: pd.Series, candidates: pd.Series) -> pd.Series:
    return pd.Series([matched(s, None if c is None else list(c)) for s, c in zip(subject, candidates, strict=True)], dtype="object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def org_tokens_of(name: pd.Series) -> pd.Series:
    return name.map(lambda x: sorted(org_tokens(x)))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def org_tokens_of_all(names: pd.Series) -> pd.Series:
    return names.map(lambda xs: [sorted(org_tokens(x)) for x in xs], na_action="ignore")


def name_initials(folded: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(folded, F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.substring(w, 1, 1))))


def ambiguous_acronym(name: Column) -> Column:
    bare = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(bare) <= 5) & ~F.contains(bare, F.lit(" ")) & bare.rlike(r"(?U)\p{Lu}") & (F.upper(bare) == bare)
