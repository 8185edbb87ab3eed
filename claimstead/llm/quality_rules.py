"""Quality rules: base counts, and the divergence of a document from what its language looks like.

References. For each language the corpus gives two histograms over all its documents: character classes, and
words by hash bucket, of which the most frequent are its common words and the others one class together.

Verdict. A document's two histograms are compared with a reference by the Jensen-Shannon distance (base 2,
so 0 to 1). It passes if both distances to the reference of its language, or else to any other, are within
the limits; each comparison needs a minimum length and is left out below it, as chance would decide.
Documents that fail the base rules (too few words, mostly repeated) are out in any case.

Counting is done where the text is read; what moves is a row for each language, bucket and input partition.
The driver sees the classes and common words of each language, never documents.

Defined results: null text has no words (and so fails the base rule); a null language has a reference of its
own; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimstead.llm.common import durable, lean

SYMBOLS = b"#*$%&|<>"
CLASSES = ("other", "lower", "upper", "digit", "blank", "line end", "sentence mark", "symbol", "non-ASCII", "inside")
BUCKETS, COMMON = 1 << 14, 96
LANGUAGES = 512
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The comparisons' minimum lengths and largest distances.
LEAST_CHARS, LEAST_COMMON = 200, 50
MOST_CLASS, MOST_WORD = 0.30, 0.53


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[*b"abcdefghijklmnopqrstuvwxyz"]] = 1
    table[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
    table[[*b"0123456789"]] = 3
    table[[*b" \t\r\x0b\x0c"]] = 4
    table[10] = 5
    table[[*b".,;:!?'\"()-"]] = 6
    table[[*SYMBOLS]] = 7
    table[0xC0:] = 8
    table[0x80:0xC0] = 9  # of a character already counted
    return table


_CLASS = _classes()


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word) % BUCKETS
        return bucket


_BUCKET = _Buckets()


def forget() -> None:
    if len(_BUCKET) > 50_000:
        _BUCKET.clear()


class Counts:
    """What the rules count in one text."""

    def __init__(self, text: str | None):
        data = (text or "").encode()
        words = data.split()  # bytes: at blanks of ASCII only
        self.n_words = len(words)
        self.classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(CLASSES))[:9]
        self.word_chars = int(self.classes.sum() - self.classes[4] - self.classes[5])
        self.n_symbols = int(self.classes[7])
        distinct = dict.fromkeys(words)
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        ids = np.array([number[w] for w in words], np.int64)
        self.buckets = np.array([_BUCKET[w] for w in distinct], np.int64)
        self.times = np.bincount(ids, minlength=len(distinct))
        self.n_repeat_words = self._repeated(ids, len(distinct)) if len(distinct) < len(words) else 0
        self.n_dup_lines = self._same_lines(data)

    @staticmethod
    def _repeated(ids: np.ndarray, distinct: int) -> int:
        if len(ids) < 4:
            return 0
        pairs = ids[:-1] * distinct + ids[1:]
        if distinct >= 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(ids) - 2 + k] |= again
        return int(covered.sum())

    @staticmethod
    def _same_lines(data: bytes) -> int:
        seen, n = set(), 0
        for line in data.split(b"\n"):
            if line in seen:
                n += 1
            elif line.strip():
                seen.add(line)
        return n

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def jensen_shannon(a: np.ndarray, b: np.ndarray) -> float:
    """The distance of two histograms, 0 to 1."""
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, both / 2)))


class Reference:
    def __init__(self, classes: list[float], common: list[tuple[int, float]], words: float):
        self.classes = np.array(classes, float)
        self.place = np.full(BUCKETS, len(common), np.int64)
        self.place[[b for b, _ in common]] = np.arange(len(common))
        self.words = np.array([*(n for _, n in common), max(0.0, words - sum(n for _, n in common))], float)

    def distances(self, c: Counts) -> tuple[float | None, float | None]:
        by_class = jensen_shannon(c.classes.astype(float), self.classes) if c.classes.sum() >= LEAST_CHARS else None
        by_word = None
        if c.n_words >= LEAST_COMMON:
            own = np.bincount(self.place[c.buckets], weights=c.times, minlength=len(self.words))
            by_word = jensen_shannon(own, self.words)
        return by_class, by_word


def language_references(docs: DataFrame) -> dict[str | None, Reference]:
    """From all documents, for the LANGUAGES values of lang (null is one) with the most words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + 9, np.int64))
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                data = (text or "").encode()
                total = sums[lang]
                total[BUCKETS:] += np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(CLASSES))[:9]
                if words := data.split():
                    total[:BUCKETS] += np.bincount(np.array([_BUCKET[w] for w in words]), minlength=BUCKETS)
        for lang, total in sums.items():
            slots = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(total[slots], pa.int64())], ["lang", "slot", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(lean(run, forget), "lang string, slot int, n long")
    sums = durable(rows.groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    words = sums.where(F.col("slot") < BUCKETS)
    most = words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    totals = {r["lang"]: r["n"] for r in most}
    known = F.col("lang").isin([x for x in totals if x is not None]) | (F.lit(None in totals) & F.col("lang").isNull())
    sums, words = sums.where(known), words.where(known)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "slot")
    common, classes = defaultdict(list), defaultdict(lambda: [0.0] * 9)
    for r in words.withColumn("place", F.row_number().over(order)).where(F.col("place") <= COMMON).collect():
        common[r["lang"]].append((r["slot"], float(r["n"])))
    for r in sums.where(F.col("slot") >= BUCKETS).collect():
        classes[r["lang"]][r["slot"] - BUCKETS] = float(r["n"])
    return {lang: Reference(classes[lang], sorted(common[lang]), totals[lang]) for lang in totals}


def within(c: Counts, lang: str | None, references: dict[str | None, Reference]) -> tuple[bool, float | None, float | None]:
    """(passes, class distance, word distance): to the document's own language, or to another that it passes by."""
    first = None
    for at in sorted(references, key=lambda x: (x != lang, x is None, x or "")):
        by_class, by_word = references[at].distances(c)
        ok = (by_class is None or by_class <= MOST_CLASS) and (by_word is None or by_word <= MOST_WORD)
        if ok:
            return True, by_class, by_word
        first = first or (False, by_class, by_word)
    return first or (True, None, None)


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs with text and lang -> the columns named in keep, then those of COUNTS."""
    references = language_references(docs)
    passed = [F.col(c) for c in keep]
    inputs = docs.select(*passed, F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lang in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist(), strict=True):
                c = Counts(text)
                ok, by_class, by_word = within(c, lang, references) if c.n_words else (True, None, None)
                out.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.base_failed, ok and not c.base_failed, by_class, by_word))
            columns = zip(*out, strict=True) if out else [[]] * 9
            columns = [pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *(x.split()[0] for x in COUNTS.split(", "))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*passed).schema.fields)
    return inputs.mapInArrow(lean(run, forget), f"{fields}, {COUNTS}")


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id and the columns of COUNTS."""
    return judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), ["doc_id"])
