"""Removal of byte strings of a given length that start in two places or more, anywhere in the corpus.

Equal strings contain equal anchors: the places where a hash of GRAM bytes is the smallest of all within a
string's length (minimizers; every string holds one, at the same offset in all its occurrences). Only
anchors whose hash occurs twice can belong to a repeat, and all occurrences of a repeated string lie in the
contexts of anchors with one hash, a context being all strings of the length around an anchor. So:

1. Each text gives its anchors, with hashes of anchor and context. Spark counts them; unique ones go.
2. An anchor whose whole context occurs twice is covered with its context.
3. The other contexts are dealt by anchor hash into shards, and a shard's contexts are sorted as suffixes by
   induction (induced_sort). Neighbours in that order with a common prefix of the length, from two places
   or from a context that occurs twice, are repeats.
4. The covered ranges of a text meet the text again, once.

Within periodic text every period would be an anchor; of such a run the two outer anchors on both sides stay
and the run itself is covered, as it repeats itself. A context is sorted once for all its occurrences. An
anchor with more than HOT different contexts (a passage that a third of all documents share, each in other
surroundings) is not sorted in one shard: the strings of its contexts are counted by hash in Spark, which
spreads them. Texts are known by hash and length, so copies cost no more than one.

Defined results: null text is empty; texts shorter than the length keep all bytes; repeated rows stand each
for itself and repeat each other; removal may cut a character, whose rest the text form of the result drops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.llm.common import durable, lean, stored
from claimstead.llm.induced_sort import equal_from, joined, suffix_order, words_at

LENGTH, GRAM = 200, 64
HOT = 10_000
SHARD_BYTES = 1 << 20
STEP = 1 << 20

_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, for as many places as a block has."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


_POWERS = _Powers()


class Block:
    """Bytes with the hash of every substring at hand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        _POWERS.need(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _POWERS.up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _POWERS.down[start] + (end - start).astype(np.uint64) * np.uint64(_ODD))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - 1
        return _mixed((self.sums[size:] - self.sums[: n - size + 1]) * _POWERS.down[: n - size + 1] + np.uint64(size * _ODD % (1 << 64)))


def _window_minima(values: np.ndarray, size: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // size) * size, ~np.uint64(0))
    padded[:n] = values
    rows = padded.reshape(-1, size)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(places, hashes, context hashes, periodic ranges) of a text."""
    n, width = len(data), length - gram + 1
    none = np.zeros(0, np.uint64)
    if n < length:
        return np.zeros(0, np.int64), none, none, []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first in range(0, n - length + 1, STEP):  # strings that start in [first, first + STEP)
        low = max(0, first - width + 1)
        part = np.frombuffer(data, np.uint8)[low : first + STEP + 2 * length]
        block = Block(part)
        hashes = block.grams(gram)
        count = min(STEP, n - length + 1 - first)
        own = hashes[first - low : first - low + count + width - 1]
        place = np.arange(first - low, first - low + len(own), dtype=np.uint64)
        best = (_window_minima(own >> np.uint64(32) << np.uint64(32) | place, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = best[np.concatenate([[True], best[1:] != best[:-1]])]
        start, end = np.maximum(at + low - width + 1, 0) - low, np.minimum(at + low + length, n) - low
        context = block.hashes(start, end) ^ _mixed((at - start).astype(np.uint64) + np.uint64(7))
        found.append((at + low, hashes[at], context))
    place, h, context = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:  # an anchor of the last strings of a step is one of the first of the next, too
        place, one = np.unique(place, return_index=True)
        h, context = h[one], context[one]
    keep, ranges = _thinned(place, h, length, gram)
    return place[keep], h[keep], context[keep], ranges


def _thinned(place: np.ndarray, h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors stay, and the ranges of the periodic runs whose inner ones don't."""
    keep, ranges = np.ones(len(place), bool), []
    if len(place) < 5:
        return keep, ranges
    step = np.diff(place)
    on = (h[1:] == h[:-1]) & (step <= gram)
    same = on[1:] & on[:-1] & (step[1:] == step[:-1])  # i, i+1, i+2 at one distance
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        last, period = b + 1, int(step[a])  # anchors a to last
        if last - a + 1 >= 5 and place[last] + gram - place[a] >= length + period:
            keep[a + 2 : last - 1] = False
            ranges.append((int(place[a]), int(place[last]) + gram))
    return keep, ranges


_TEXT = ["th", "n"]


def _texts(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Adds text (null: empty), its hash th and its bytes n."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*extra, text.alias("text")).withColumns({"th": F.xxhash64("text"), "n": F.octet_length("text")})


_ANCHORS = "th long, n int, place int, h long, c long, until int"


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each anchor; and for each periodic range, with until set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list[np.ndarray]] = [[] for _ in range(6)]
                for text, th, n in zip(part.column("text"), part.column("th").to_pylist(), part.column("n").to_pylist(), strict=True):
                    if n < length:
                        continue
                    place, h, c, ranges = anchors(text.as_buffer().to_pybytes(), length, gram)
                    rows = [(np.full(len(place), th), np.full(len(place), n), place, h.view(np.int64), c.view(np.int64), np.zeros(len(place), np.int64))]
                    if ranges:
                        a, b = np.array(ranges).T
                        rows.append((np.full(len(a), th), np.full(len(a), n), a, _mixed(a.astype(np.uint64) ^ np.uint64(th & (1 << 64) - 1)).view(np.int64), np.zeros(len(a), np.int64), b))
                    for row in rows:
                        for column, values in zip(columns, row, strict=True):
                            column.append(values)
                if columns[0]:
                    flat = [np.concatenate(c) for c in columns]
                    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(flat, types, strict=True)], ["th", "n", "place", "h", "c", "until"])

    return texts.select("text", "th", "n").mapInArrow(lean(run), _ANCHORS)


_SEGMENTS = "h long, c long, th long, n int, first int, times long, hot boolean, data binary"


def _segments(texts: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The contexts of the wanted anchors, cut out of the texts; a few times the same where there are copies."""
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text, th, n, items in zip(part.column("text"), part.column("th").to_pylist(), part.column("n").to_pylist(), part.column("items").to_pylist(), strict=True):
                    if (th, n) in seen:
                        continue
                    seen.add((th, n))
                    data = text.as_buffer().to_pybytes()
                    for x in items:
                        first = max(0, x["place"] - width + 1)
                        rows.append((x["h"], x["c"], th, n, first, x["times"], x["hot"], data[first : x["place"] + length]))
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _SEGMENTS.split(", ")])

    by_text = wanted.groupBy("th", "n").agg(F.collect_list(F.struct("h", "c", "place", "times", "hot")).alias("items"))
    return texts.select("text", "th", "n").join(by_text, _TEXT).mapInArrow(lean(run), _SEGMENTS)


def _repeats(contexts: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Ranges (th, n, start, end) of repeats among the contexts of a shard.

    Its arrays decide what a task takes beside the JVM: they are of 32 bits where that is enough, and strings
    that are too short or alone leave as soon as that is known.
    """
    rows = {name: contexts.column(name).to_numpy() for name in ("th", "n", "first", "times")}
    data = contexts.column("data").to_pylist()
    sizes = np.array([len(x) for x in data], np.int32)
    text = joined(data)
    del data
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int32)
    wanted = np.zeros(len(text), bool)  # where a string of the length starts
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        wanted[start : start + max(0, size - length + 1)] = True
    words = words_at(text)
    order = suffix_order(text, words, wanted)
    del text, wanted
    if len(order) < 2:
        return
    same = equal_from(words, order[:-1], order[1:], length)
    del words
    after, before = np.append(False, same), np.append(same, False)
    order, heads = order[after | before], np.flatnonzero(~after[after | before])
    if not len(order):
        return
    segment = (np.searchsorted(starts, order, side="right") - 1).astype(np.int32)
    first = rows["first"][segment] + order - starts[segment]
    del order, same, after, before
    source = _mixed(rows["th"].view(np.uint64)[segment] + first.astype(np.uint64) * np.uint64(_ODD))
    many = (rows["times"] > 1)[segment]
    twice = (np.minimum.reduceat(source, heads) != np.maximum.reduceat(source, heads)) | np.logical_or.reduceat(many, heads)
    del source
    hit = np.repeat(twice, np.diff(np.append(heads, len(many)))) & ~many
    segment, first = segment[hit], first[hit]
    if not len(segment):
        return
    by = np.lexsort((first, segment))
    segment, first = segment[by], first[by]
    begins = np.append(True, (segment[1:] != segment[:-1]) | (first[1:] - first[:-1] > length))
    at = segment[begins]
    columns = rows["th"][at], rows["n"][at], first[begins], first[np.append(begins[1:], True)] + length
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)], ["th", "n", "start", "end"])


def _sorted_shards(segments: DataFrame, length: int) -> DataFrame:
    """Ranges (th, n, start, end) of repeats among contexts with the same anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c = (batch.column(name).to_numpy() for name in "hc")
            new_h = np.append(last is None or last[0] != h[0], h[1:] != h[:-1])
            new = new_h | np.append(last is None or last[1] != c[0], c[1:] != c[:-1])
            last = h[-1], c[-1]
            batch, new_h = batch.filter(pa.array(new)), new_h[new]
            ends = np.cumsum(pc.binary_length(batch.column("data")).to_numpy(), dtype=np.int64)
            edges, at, done = np.flatnonzero(new_h), 0, 0
            for edge in edges[edges > 0].tolist() if not held else edges.tolist():
                before = int(ends[edge - 1]) if edge else 0
                if size + before - done >= SHARD_BYTES:
                    shard = pa.Table.from_batches([*held, batch.slice(at, edge - at)])
                    held, size, at, done = [], 0, edge, before
                    yield from _repeats(shard, length)
            held.append(batch.slice(at))
            size += int(ends[-1]) - done if len(ends) else 0
        if held:
            yield from _repeats(pa.Table.from_batches(held), length)

    return segments.repartition("h").sortWithinPartitions("h", "c").mapInArrow(lean(run), "th long, n int, start int, end int")


def _counted_strings(segments: DataFrame, length: int) -> DataFrame:
    """As _sorted_shards, for contexts of hot anchors: every string by its hash."""
    names = ["u", "v", "th", "n", "place", "many"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["data"], np.uint8)
                count = len(data) - length + 1
                if count > 0:
                    block, start = Block(data), np.arange(count)
                    u, half = block.grams(length), block.grams(length // 2)
                    v = half[:count] ^ _mixed(half[length - length // 2 : length - length // 2 + count])
                    same = [pa.array(np.full(count, r[k]), t) for k, t in (("th", pa.int64()), ("n", pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), *same, pa.array((start + r["first"]).astype(np.int32)), pa.array(np.full(count, r["times"] > 1))], names)

    rows = segments.mapInArrow(lean(run), "u long, v long, th long, n int, place int, many boolean")
    source = F.xxhash64("th", "n", "place")
    twice = rows.groupBy("u", "v").agg(F.min(source).alias("s0"), F.max(source).alias("s1"), F.max("many").alias("some")).where("s0 != s1 or some")
    hit = rows.where("not many").join(twice, ["u", "v"]).select("th", "n", "place").distinct()
    places = hit.groupBy("th", "n").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return places.select("th", "n", F.explode("places").alias("start")).select("th", "n", "start", (F.col("start") + length).alias("end"))


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts as of _texts() -> th, n, ranges (start, end in bytes; they may overlap) for texts that have any."""
    width = length - gram + 1
    rows = _anchor_rows(texts, length, gram)
    stats = rows.groupBy("h").agg(F.count("*").alias("times"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("times > 1")
    stats = stats.select("h", (F.col("c0") != F.col("c1")).alias("several"))
    shared = stored(rows.join(stats, "h", "left").where("several is not null or until > 0"), "anchors")
    runs = shared.where("until > 0").select("th", "n", F.col("place").alias("start"), F.col("until").alias("end"))
    whole = [F.greatest(F.col("place") - (width - 1), F.lit(0)).alias("start"), F.least(F.col("place") + length, F.col("n")).alias("end")]
    one = shared.where("until = 0 and not several").select("th", "n", *whole)
    mixed_ = shared.where("until = 0 and several")
    kinds = mixed_.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("th", "n", "place")).alias("at"))
    sizes = kinds.groupBy("h").agg((F.count("*") > HOT).alias("hot"))
    kinds = durable(kinds.join(sizes, "h").select("h", "c", "times", "hot", "at.th", "at.n", "at.place"))
    more = mixed_.join(kinds.where("times > 1").select("h", "c"), ["h", "c"]).select("th", "n", *whole)
    segments = stored(_segments(texts, kinds, length, gram), "contexts")
    found = _sorted_shards(segments.where("not hot"), length)
    hot = _counted_strings(segments.where("hot").dropDuplicates(["h", "c"]), length)
    covered = one.unionByName(more).where(F.col("end") - F.col("start") >= length)
    covered = covered.unionByName(runs).unionByName(found).unionByName(hot).distinct()
    return covered.groupBy("th", "n").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def _kept(data: bytes, ranges: list[dict] | None) -> tuple[bytes, int]:
    """What is left, and the number of maximal removed runs."""
    if not ranges:
        return data, 0
    parts, at, runs = [], 0, 0
    end = -1
    for r in ranges:
        if r["start"] > end:
            if runs:
                at = end
            parts.append(data[at : r["start"]])
            runs += 1
        end = max(end, r["end"])
    parts.append(data[end:])
    return b"".join(parts), runs


def remove_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with text -> the columns named in keep, then n_bytes, n_removed, n_spans, kept_sha256 and kept_text."""
    texts = _texts(docs, keep)
    ranges = repeated_ranges(texts, length, gram)
    names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text, ranges in zip(part.column("text"), part.column("ranges").to_pylist(), strict=True):
                    data = text.as_buffer().to_pybytes()
                    left, runs = _kept(data, ranges)
                    rows.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *columns], names)

    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    out = f"{fields}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    return texts.join(ranges, _TEXT, "left").select(*keep, "text", "ranges").mapInArrow(lean(run), out)
