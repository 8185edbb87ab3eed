"""Nearest neighbours by inner product: shifted space-filling curves, completed by an exact scan.

Vectors get one more component that makes all norms equal, so that the largest inner product is the smallest
distance. Each of several orderings projects them on a few random directions, shifts the grid at random and
numbers the cells along a Hilbert curve. Spark range-partitions the keys and gives every vector its rank; an
ordering is read in blocks of BLOCK consecutive ranks and a margin of MARGIN on both sides, and a query is
compared, in double precision, with all of its block. The best of the orderings are merged.

Windows of fixed size see an ever smaller share of a growing table. So their result only bounds the answer:
no nearest neighbour scores less than the last of those found. A scan then compares the queries, QUERIES at a
time, with all vectors and keeps what reaches the bound, of which the best are the exact answer. The better
the windows, the fewer rows leave the scan; the scan's comparisons are queries times vectors in any case.

Equal vectors are one class throughout, named by its smallest id and carried with its CLASS smallest ids:
no more can be among the nearest of any query, so a vector that a third of all rows share is indexed once.
A block has a fixed number of rows, whatever the keys are.

The projection's centre and range are fitted on at most FIT vectors.

Defined results: vectors that are null, zero, or that hold null or non-finite components take no part, neither
do rows without id; shorter vectors count as filled up with zeros; a repeated row is a candidate of its own, of
which a query leaves one out, itself; ids name vectors, so of different vectors under one id that is the
smallest of their classes one is indexed; with fewer candidates than asked for, all found are returned; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimstead.llm.common import durable

ORDERINGS, DIMENSIONS, BITS = 12, 6, 10
BLOCK, MARGIN = 4096, 512
FIT = 4096
QUERIES = 16384
SEED = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of cell coordinates (each below 2**bits); dimensions * bits < 64."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):  # from the largest cubes on: undo each cube's reflection and rotation
        low, bit = (1 << level) - 1, 1 << level
        for i, axis in enumerate(axes):
            upper = (axis & bit) != 0
            swap = np.where(upper, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(upper, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((axes[-1] >> level) & 1, turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> level) & 1
    return key


class Orderings:
    """Random directions and shifts, fitted to the spread of a sample."""

    def __init__(self, sample: np.ndarray, longest: float, count: int, dimensions: int, bits: int):
        rng = np.random.default_rng(SEED)
        self.longest, self.bits = longest, bits
        sample = self.lifted(sample)
        size, used = sample.shape[1], min(dimensions, sample.shape[1])
        self.directions = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, :used] for _ in range(count)]
        spread = [sample @ d for d in self.directions]
        self.low = [s.min(0) for s in spread]
        self.width = [np.maximum(s.max(0) - s.min(0), 1e-9) * 1.5 for s in spread]
        self.shift = [rng.random(used) / 3 for _ in range(count)]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        x, top = self.lifted(x), (1 << self.bits) - 1
        out = []
        for d, low, width, shift in zip(self.directions, self.low, self.width, self.shift, strict=True):
            cells = ((x @ d - low) / width + shift) * top
            out.append(hilbert_keys(np.clip(cells, 0, top).astype(np.int64), self.bits))
        return out


def _usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("embedding")))
    # one form of zero, so that equal vectors are equal bytes
    return rows.withColumn("embedding", F.transform(filled, lambda v: v + F.lit(0.0)))


def _first(rows: DataFrame, key: list[str], order: str, most: int, salts: int = 64) -> DataFrame:
    """The `most` rows of smallest `order` of each key; a hot key is cut down in `salts` parts first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    for by in ([*key, "salt"], key):
        salted = salted.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("at") <= most)
    return salted.drop("at", "salt")


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _ranked(keys: DataFrame) -> DataFrame:
    """Adds the rank (from 0) of each row in its ordering."""
    order = ["ordering", "key", "class"]
    dealt = durable(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", "ordering").count().orderBy("ordering", "part").collect()  # a row or two for each partition
    bases, before, last = [], 0, None
    for r in counts:
        before = before if r["ordering"] == last else 0
        bases.append((r["part"], r["ordering"], before))
        before, last = before + r["count"], r["ordering"]
    bases = F.broadcast(keys.sparkSession.createDataFrame(bases, "part int, ordering int, base long"))
    within = F.row_number().over(Window.partitionBy("part", "ordering").orderBy("key", "class"))
    return dealt.withColumn("within", within).join(bases, ["part", "ordering"]).select("ordering", "class", (F.col("base") + F.col("within") - 1).alias("rank"))


def _scanned(indexed: DataFrame, bounded: DataFrame, most: int, slack: float) -> DataFrame:
    """bounded: asking, embedding, least -> asking, class, score: the `most` best of all vectors, given that they reach least."""
    count, parts = max(1, -(-bounded.count() // QUERIES)), []
    for part in range(count):
        rows = bounded.where(F.pmod(F.xxhash64("asking"), F.lit(count)) == part).collect()
        if not rows:
            continue
        names = np.array([r["asking"] for r in rows])
        asked = np.array([r["embedding"] for r in rows])
        least = np.array([r["least"] for r in rows]) - slack  # the same product may differ in its last bits

        def scan(batches: Iterator[pa.RecordBatch], names=names, asked=asked, least=least) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, classes = _matrix(batch.column("embedding")), batch.column("class").to_numpy()
                for at in range(0, len(asked) if len(x) else 0, 256):
                    scores = asked[at : at + 256] @ x.T
                    q, i = np.nonzero(scores >= least[at : at + 256, None])
                    yield pa.RecordBatch.from_arrays([pa.array(names[at + q]), pa.array(classes[i]), pa.array(scores[q, i])], ["asking", "class", "score"])

        place = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "class"))
        reached = indexed.select("class", "embedding").mapInArrow(scan, "asking long, class long, score double")
        parts.append(durable(reached.withColumn("at", place).where(F.col("at") <= most).drop("at")))
    return reduce(DataFrame.unionByName, parts) if parts else bounded.select("asking", F.col("asking").alias("class"), F.col("least").alias("score"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, bits: int = BITS, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """vectors (vec_id, embedding); is_query: a condition on vec_id -> query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = _usable(vectors).withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    ids = durable(rows.select("vec_id", "h1", "h2"))
    members = durable(_first(ids, ["h1", "h2"], "vec_id", k + 1))
    classes = durable(members.groupBy("h1", "h2").agg(F.min("vec_id").alias("class")))
    queries = durable(ids.where(is_query).join(classes, ["h1", "h2"]).select("vec_id", "class").distinct())
    asked = queries.select("class").distinct().withColumn("asked", F.lit(True))
    named = rows.withColumnRenamed("vec_id", "class").join(classes, ["class", "h1", "h2"])
    indexed = durable(named.select("class", "embedding").dropDuplicates(["class"]))
    longest = indexed.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.array([r[0] for r in indexed.orderBy(F.xxhash64("class"), "class").limit(FIT).select("embedding").collect()])
    curves = Orderings(sample, longest, orderings, dimensions, bits)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, keys in enumerate(curves.keys(_matrix(batch.column("embedding")))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), o, np.int32)), pa.array(keys), batch.column("class")], ["ordering", "key", "class"])

    ranked = _ranked(indexed.mapInArrow(number, "ordering int, key long, class long"))
    blocks = F.explode(F.array_distinct(F.array(*(F.floor(F.greatest(F.col("rank") + d, F.lit(0)) / block) for d in (-margin, 0, margin)))))
    placed = ranked.withColumn("block", blocks).join(asked, "class", "left")
    own = F.coalesce(F.col("asked"), F.lit(False)) & (F.col("block") == F.floor(F.col("rank") / block))
    placed = placed.select("ordering", "block", "class", own.alias("own")).join(indexed, "class")
    dealt = placed.repartition("ordering", "block").sortWithinPartitions("ordering", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def best() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            x, names = _matrix(table["embedding"].combine_chunks()), table["class"].to_numpy()
            asking = np.flatnonzero(table["own"].to_numpy(zero_copy_only=False))
            for part in (asking[i : i + 256] for i in range(0, len(asking), 256)):
                scores = x[part] @ x.T
                most = min(k + 1, len(x))
                top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
                # all that tie with the last of these, for ties go to the smaller id
                for i, q in enumerate(part):
                    last = scores[i, top[i]].min()
                    found = np.flatnonzero(scores[i] >= last)
                    found = found[np.lexsort((names[found], -scores[i, found]))][:most]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), names[q])), pa.array(names[found]), pa.array(scores[i, found])], ["asking", "class", "score"])

        for batch in batches:
            o, b = batch.column("ordering").to_numpy(), batch.column("block").to_numpy()
            ends = np.flatnonzero((o[1:] != o[:-1]) | (b[1:] != b[:-1])) + 1
            for start, end in zip([0, *ends], [*ends, len(o)], strict=True):
                if start == end:
                    continue
                if at != (o[start], b[start]) and held:
                    yield from best()
                    held = []
                at = (o[start], b[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield from best()

    found = dealt.mapInArrow(compare, "asking long, class long, score double")
    merged = found.groupBy("asking", "class").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "class"))
    merged = merged.withColumn("at", place).where(F.col("at") <= k + 1).drop("at")
    least = F.when(F.count("*") == k + 1, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least")
    bounded = merged.groupBy("asking").agg(least).join(indexed.withColumnRenamed("class", "asking"), "asking")
    merged = _scanned(indexed, durable(bounded.select("asking", "embedding", "least")), k + 1, 1e-9 * longest**2)
    full = members.join(classes, ["h1", "h2"]).select("class", F.col("vec_id").alias("found_id"))
    near = merged.join(full, "class").groupBy("asking").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "found_id"))), 1, k + 1).alias("near"))
    each = queries.select(F.col("vec_id").alias("query_id"), F.col("class").alias("asking")).join(near, "asking")
    own = F.array_position(F.transform("near", lambda x: x["found_id"]), F.col("query_id")) - 1
    others = F.slice(F.filter("near", lambda x, i: i != own), 1, k)
    out = each.select("query_id", F.posexplode(others).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.found_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
