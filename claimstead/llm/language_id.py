"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1: all non-trivial splits of the languages where there are few of
them, else a random code of ten bits for each doubling, the best separated of a fixed number of draws. For
each bit a binary classifier over hashed letter bigrams and trigrams weighs the evidence for the languages
on its one side against those on the other (smoothed log-odds per n-gram). A text gets the language of the
codeword with the least logistic loss, weighted by how well each bit did on the languages' own profiles;
close seconds are flagged as ambiguous.

Learning takes at most about SAMPLE documents of each language, chosen by a hash of their place in the
table; their n-gram counts are summed in Spark, and the driver gets one profile for each language.
Predicting reads whole texts and nothing but the text.

Defined results: a text that is null or has no letter is `und` with score 0; with nothing to learn from, all
are `und`; a null doc_id counts as the text '' in the split; repeated rows stand each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS, SAMPLE, SMOOTH = 1 << 14, 2000, 0.5
LANGUAGES = 512
FEW, DRAWS, SEED = 6, 200, 20
SHARPNESS, AMBIGUOUS = 6.0, 0.1
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter bigrams and trigrams (one blank for all between words); None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    two = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(0x165667B19E3779F9) + codes[2:] * np.uint64(0x27D4EB2F165667C5)
    slots = np.concatenate([two, three]) >> np.uint64(50)
    return np.bincount(slots.astype(np.int64), minlength=SLOTS)


def code(n: int) -> np.ndarray:
    """n codewords, as rows."""
    if n <= FEW:
        splits = [[1 if s >> k & 1 else -1 for k in range(n)] for s in range(1, 1 << max(n - 1, 1)) if n > 1]
        return np.array(splits, float).T.reshape(n, -1)
    rng, length = np.random.default_rng(SEED), int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(DRAWS):
        m = rng.choice([-1.0, 1.0], size=(n, length))
        same = m @ m.T
        np.fill_diagonal(same, -length)
        if (d := (length - same.max()) / 2) > apart and (abs(m.sum(0)) < n).all():
            best, apart = m, d
    return best


class Model:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.languages = sorted(profiles)
        if not self.languages:
            return
        counts = np.array([profiles[x] for x in self.languages], float) + SMOOTH
        shares = counts / counts.sum(1, keepdims=True)
        self.code = code(len(self.languages))
        side = lambda sign: np.stack([shares[self.code[:, b] == sign].mean(0) for b in range(self.code.shape[1])], 1)
        self.weights = np.log(side(1) / side(-1)) if self.code.size else np.zeros((SLOTS, 0))
        margins = np.tanh(SHARPNESS * self.code * (shares @ self.weights))
        self.trust = np.maximum(margins.min(0), 0.05) if self.code.size else np.zeros(0)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For rows of counts: the nearest codewords' languages, their scores, and whether they are ambiguous."""
        said = SHARPNESS * (counts @ self.weights) / np.maximum(counts.sum(1, keepdims=True), 1)
        loss = (np.logaddexp(0, -said[:, None, :] * self.code[None]) * self.trust).sum(2)
        scale = max(1.0, self.trust.sum() / 2)
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * 8 / scale)
        share /= share.sum(1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        rows = np.arange(len(share))
        first = share[rows, order[:, 0]]
        second = share[rows, order[:, 1]] if share.shape[1] > 1 else np.zeros(len(share))
        return [self.languages[i] for i in order[:, 0]], first, first - second < AMBIGUOUS


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: text, lang (neither null). About `sample` documents of each language are taken, by a hash of their text.

    Of more than LANGUAGES values of lang those with the most documents are learned.
    """
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model({})
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))))
    hashed = labelled.withColumn("h", F.xxhash64(F.lit(SEED), "text"))
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    # a text counts once, so that a hot one neither fills the sample nor decides it
    chosen = hashed.where(chance < F.try_element_at(share, "lang")).dropDuplicates(["lang", "h"]).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                n = ngram_counts(text)
                if n is not None:
                    sums[lang] = sums.get(lang, 0) + n / n.sum()  # documents weigh alike, however long
        for lang, n in sums.items():
            slots = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(n[slots], pa.float64())], ["lang", "slot", "n"])

    sums = chosen.mapInArrow(run, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    profiles: dict[str, np.ndarray] = {}
    for r in sums.collect():  # SLOTS rows for each language at most
        profiles.setdefault(r["lang"], np.zeros(SLOTS))[r["slot"]] = 1000 * r["n"]
    return Model(profiles)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                counts = [ngram_counts(t) if model.languages else None for t in part.column("text").to_pylist()]
                found = [i for i, c in enumerate(counts) if c is not None]
                langs, score, ambiguous = [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
                if found:
                    said, s, a = model.predict(np.array([counts[i] for i in found], float))
                    score[found], ambiguous[found] = s, a
                    for i, lang in zip(found, said, strict=True):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs), pa.array(score), pa.array(ambiguous)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, lang): learns from those not held out, predicts all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)
    model = learn(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"), sample)
    return identify(rows, model)
