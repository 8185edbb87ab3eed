"""Similarity join of documents on word shingles by parity sketches.

A document is its set of shingles. Sets of sizes that can link at all meet in size bands: the group of a band
holds its sets and those of the next band, so any two that link meet in the group of the smaller one's band.
Of sets that link there, at most D shingles are in one but not the other. Every shingle flips one bit of a
sketch, so the Hamming distance of two sketches is at most that difference; a sketch of more than D blocks
thus has equal blocks in both (pigeonhole), and block contents are the keys of the join. This sketch is far
wider than it is full, so a block is named by the XOR of its bits' hashes: a bit that flips twice cancels, and
blocks differ unless their shingles are the same.

Empty blocks say nothing, and blocks that very many sets share (a line that a third of all documents hold)
say little. A group has some blocks more than D + 1, so two linked sets have more equal blocks than the group
has to spare. A set with no more empty and popular blocks than that shares one that is neither with every set
it links with. The others take part in their popular keys; should the empty blocks alone be too many, in a
second and third sketch with other hashes too, and in the last of them with empty blocks. So no link is lost.

Sets that are equal are one class. Round 0 compares every class with one of the smallest classes of its keys,
the nearest by a second sketch (a parity bitmap of SHARP bits for each shingle that may differ): stars, not all
pairs. Later rounds take the keys whose classes are still in different components, in tiles of fixed size, and
every component of a tile names its nearest classes outside that the sketches don't rule out and that haven't
been compared, one in the first of these rounds and more in each that follows, until there is none. A key that
names none is done. All that is named is compared exactly, on the sets.

Keys travel packed, a blob of all keys of a task's classes for each partition. Only where all classes of a key
are together are keys without a partner left out, and equal sets of classes named once. Sets are compared in
cells of one class and up to CELL others, to which their shingles come once.

Defined results: null or blank texts have an empty set and link with nothing; with fewer words than a
shingle the whole sequence is the one shingle; repeated rows stand each for itself and are one class; rows
without id take part and count as larger than any id. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimstead.llm.common import Scratch, lean, stored
from claimstead.llm.components import components, joined_components

LEVELS, SPARE = 3, 0.12
POPULAR = 16
SHARP = 16
FLUSH = 500_000
TILE = 2048
CELL = 64
PARTITION_BYTES = 32 << 20
FILTER_WORDS = 1 << 20

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))
_LETTER = mixed(_LOWER.astype(np.uint64) * _M1 + _M2)
_PIECE = 1 << 19


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            steps = np.full((2, 1 << (n - 1).bit_length()), [[int(_M1)], [pow(int(_M1), -1, 1 << 64)]], np.uint64)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1)


_POWERS = _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word; A-Z count as a-z."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    starts, ends = edges[::2], edges[1::2]
    _POWERS.need(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * _POWERS.up[: len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64) * _M2), starts


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while at < len(data):
        end = at + _PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _set_of(words: np.ndarray, size: int) -> np.ndarray:
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * _M1 + words[k : len(words) - size + 1 + k])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    held, volume = [], 0

    def flush() -> Iterator[np.ndarray]:
        words, starts = word_hashes(b" ".join(held))
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)]))
        first, n = cuts[:-1], np.diff(cuts)
        full = np.zeros(0, np.uint64)
        if len(words) >= size:
            full = np.full(len(words) - size + 1, size, np.uint64)
            for k in range(size):
                full = mixed(full * _M1 + words[k : len(words) - size + 1 + k])
        for i, m in zip(first.tolist(), n.tolist(), strict=True):
            if m < size:
                yield _set_of(words[i : i + m], size)
            else:
                own = np.sort(full[i : i + m - size + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]

    for text in texts:
        data = (text or "").encode()
        if len(data) > _PIECE:
            if held:
                yield from flush()
                held, volume = [], 0
            yield _set_of(np.concatenate([word_hashes(x)[0] for x in _pieces(data)]), size)
            continue
        held.append(data)
        volume += len(data)
        if volume >= _PIECE:
            yield from flush()
            held, volume = [], 0
    if held:
        yield from flush()


def shingles(text: str | None, size: int) -> np.ndarray:
    return next(shingle_sets([text], size))


class Bands:
    """Size bands for a Jaccard threshold of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    def most_apart(self, a: int, b: int) -> int:
        """The largest symmetric difference with which sets of these sizes link."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def furthest(self, size: int) -> int:
        """The same for a set of this size and any larger one."""
        return self.most_apart(size, 100 * size // self.percent)

    def groups(self, size: int) -> list[tuple[int, int, int]]:
        """(group, D, blocks) in which a set of this size takes part; none if no other set can link with it."""
        if self.furthest(size) == 0:
            return []
        while self.starts[-1] <= size or len(self.starts) < 3:
            self.starts.append(100 * self.starts[-1] // self.percent + 1)
        band = int(np.searchsorted(self.starts, size, side="right")) - 1
        out = []
        for group in (band - 1, band) if band else (band,):  # as a larger set of the band below, and in its own
            apart = self.furthest(self.starts[group + 1] - 1)
            out.append((group, apart, apart + 3 + int(SPARE * (apart + 1))))
        return out


@lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def block_keys(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The keys of the join for a set (sorted); and how many of them may be popular before they are needed."""
    out, room = [np.zeros(0, np.uint64)], 1 << 30
    high, value = tokens >> np.uint64(32), mixed(tokens * _M1 + _M3)
    for group, apart, blocks in bands(percent).groups(len(tokens)):
        spare = blocks - apart - 1
        for level in range(LEVELS):
            if level:
                h = np.sort(mixed(tokens + np.uint64(level * int(_M1) % (1 << 64))))
                high, value = h >> np.uint64(32), mixed(h * _M1 + _M3)
            block = high * np.uint64(blocks) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            # the content is well mixed as it is, so the block's name is only spread and added
            name = np.uint64(group * LEVELS + level << 32)
            out.append((np.bitwise_xor.reduceat(value, starts) ^ (block[starts] + name) * _M2) * _M1)
            empty = blocks - len(starts)
            if empty <= spare:
                room = min(room, -1 if level else spare - empty)
                break
            if level == LEVELS - 1:
                out.append((np.setdiff1d(np.arange(blocks, dtype=np.uint64), block[starts]) + name) * _M2 * _M1)
                room = -1
        if level:
            high, value = tokens >> np.uint64(32), mixed(tokens * _M1 + _M3)
    return np.concatenate(out), room


def check_sketch(tokens: np.ndarray, percent: int) -> bytes:
    """A parity bitmap of SHARP bits for each shingle by which linked sets may differ, rounded up to a power of two."""
    size = max(64, 1 << (SHARP * bands(percent).furthest(len(tokens)) - 1).bit_length()) if len(tokens) else 64
    bits = np.bincount((mixed(tokens) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def sketch_matrix(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, folded to the size of the shortest (a folded sketch is the shorter sketch)."""
    return folded(sketches, min(map(len, sketches)))


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sketches])
    out = np.zeros((len(sketches), width // 8), np.uint64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64).reshape(len(at), size // width, width // 8)
        out[at] = np.bitwise_xor.reduce(rows, axis=1)
    return out


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The Hamming distances of pairs of sketches, each at the size of the shorter."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for pair in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == pair).all(1)).tolist()
        m = sketch_matrix([a[i] for i in at] + [b[i] for i in at])
        out[at] = np.bitwise_count(m[: len(at)] ^ m[len(at) :]).sum(1, dtype=np.int64)
    return out


def may_link(percent: int, apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches so far apart leave a link possible between sets of sizes a and b."""
    return (apart <= (100 - percent) * (a + b) // (100 + percent)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _groups(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and node without repeats; and for each key where its entries begin."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes = keys[new], nodes[new]
    return keys, nodes, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _partition_names(spark: SparkSession, parts: int) -> np.ndarray:
    """For each of so many hash partitions an int that Spark deals to it."""
    tries = spark.range(int(parts * (np.log(parts) + 8)) + 64).select(F.col("id").cast("int").alias("name"))
    rows = tries.groupBy(F.pmod(F.hash("name"), F.lit(parts)).alias("part")).agg(F.min("name").alias("name"))
    return np.array([r["name"] for r in rows.collect()])


_STAGED = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("key", pa.int64()), ("least", pa.int64()), ("sketch", pa.binary()), ("keys", pa.binary()), ("nodes", pa.binary())])
_STAGED_SQL = "kind string, part int, doc_id long, th long, n long, node long, key long, least long, sketch binary, keys binary, nodes binary"


def _rows(kind: str, **columns) -> pa.RecordBatch:
    n = len(columns["n"])
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _STAGED], schema=_STAGED)


def _staged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows of three kinds: doc (doc_id, th: its text's hash, n, node, sketch, key: its room), member (key, node, least, n: its size)
    of the sets of classes that share a key, load (node, n): how many popular keys a class has.
    """
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // PARTITION_BYTES))
    names = _partition_names(spark, parts)
    parts = len(names)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, counts, total = [], [], [], 0
        turn = TaskContext.get().partitionId() * 31  # rows of documents go round the partitions, from another one in each task
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, owner = np.concatenate(held), np.repeat(np.arange(len(nodes)), counts)
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")  # owners ascend already
            keys, owner = keys[order].astype(np.uint32), owner[order]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            table = np.array(nodes)
            for p, (start, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if end > start:
                    own, times = np.unique(owner[start:end], return_counts=True)
                    yield _rows("blob", part=[int(names[p])], n=[len(own)], keys=[keys[start:end].tobytes()], nodes=[table[own].tobytes() + times.astype(np.uint32).tobytes()])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ns, own, sketches, rooms = [], [], [], []
                for tokens in shingle_sets(part.column(1).to_pylist(), size):
                    node, sketch_, room = node_of(tokens), None, None
                    if node not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(node)
                        sketch_ = check_sketch(tokens, percent)
                        keys, room = block_keys(tokens, percent)
                        if len(keys):
                            held.append(keys)
                            nodes.append(node)
                            counts.append(len(keys))
                            total += len(keys)
                    ns.append(len(tokens))
                    own.append(node)
                    sketches.append(sketch_)
                    rooms.append(room)
                turn += 1
                yield _rows("doc", part=[int(names[(turn + k // 100) % parts]) for k in range(len(ns))], doc_id=part.column(0), th=part.column(2), n=ns, node=own, sketch=sketches, key=rooms)
                if total >= FLUSH:
                    yield from flush()
                    held, nodes, counts, total = [], [], [], 0
        if total:
            yield from flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []
        for batch in batches:
            kinds = pc.equal(batch.column("kind"), "blob")
            yield batch.filter(pc.invert(kinds))
            blobs = batch.filter(kinds)
            for k, packed, n in zip(blobs.column("keys"), blobs.column("nodes"), blobs.column("n").to_pylist(), strict=True):
                packed = packed.as_buffer().to_pybytes()
                keys.append(np.frombuffer(k.as_buffer().to_pybytes(), np.uint32))
                nodes.append(np.repeat(np.frombuffer(packed, np.int64, n), np.frombuffer(packed, np.uint32, offset=8 * n)))
        if not keys:
            return
        # 32 bits name a key of a partition; should two meet, comparisons too many are made
        _, nodes, heads = _groups(np.concatenate(keys), np.concatenate(nodes))
        sizes = np.diff(np.append(heads, len(nodes)))
        popular, times = np.unique(nodes[np.repeat(sizes > POPULAR, sizes)], return_counts=True)
        for at in range(0, len(popular), 50_000):
            yield _rows("load", node=popular[at : at + 50_000], n=times[at : at + 50_000])
        # sets of classes, each once, named by a hash of their classes
        sets = np.add.reduceat(mixed(nodes.view(np.uint64)), heads) + sizes.astype(np.uint64)
        first = np.zeros(len(heads), bool)
        first[np.unique(sets, return_index=True)[1]] = True
        chosen = first & (sizes > 1)
        rows = np.repeat(chosen, sizes)
        columns = {"key": np.repeat(sets, sizes)[rows].view(np.int64), "node": nodes[rows], "least": np.repeat(nodes[heads], sizes)[rows], "n": np.repeat(sizes, sizes)[rows]}
        for at in range(0, len(columns["n"]), 50_000):
            yield _rows("member", **{name: c[at : at + 50_000] for name, c in columns.items()})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(lean(sketch), _STAGED_SQL)
    return rows.repartition(parts, "part").mapInArrow(lean(match), _STAGED_SQL).drop("part", "keys", "nodes")


def _stars(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class the nearest of the smallest classes of its keys, if sketches allow a link."""
    pairs = members.where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            apart = distances(*(batch.column(c).to_pylist() for c in ("sa", "sb")))
            ok = may_link(percent, apart, na, nb)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(ok)) for c in "ab"), pa.array(apart[ok])], ["a", "b", "apart"])

    near = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lean(run), "a long, b long, apart long")
    return near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label, size of the members of keys whose classes are in several components."""
    marked = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = marked.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("size")).where("l0 != l1")
    return marked.join(several.select("key", "size"), "key")


def _nearest_outside(rows: DataFrame, nodes: DataFrame, apart: DataFrame, percent: int, most: int) -> DataFrame:
    """key, a, b: for each component in a tile of a key its `most` nearest pairs with a class of another, where sketches allow a link.

    rows: as of _open(); apart: pairs (a, b), a < b, that don't link and aren't named again. A pair may be
    named once for a task; a key with a pair named elsewhere comes with nulls, for it isn't done yet.
    """
    rows = rows.withColumn("tiles", F.ceil(F.col("size") / TILE)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    # tile pairs (i, j), i <= j, with the row's own tile as either
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    rows = rows.withColumn("other", other).select("key", "node", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    known = apart.groupBy("a").agg(F.collect_list("b").alias("known")).withColumnRenamed("a", "node")
    rows = rows.join(nodes.join(known, "node", "left"), "node")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    columns = ["key", "i", "j", "node", "label", "own", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named: set[tuple[int, int]] = set()

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """All pairs of rows at a distance of 1, 2 ... within a tile, for all tiles of the table at once."""
            key, i, j, node, label, own, n = (t[c].to_numpy() for c in columns)
            tile = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            sketches, known = t["sketch"].to_pylist(), t["known"].to_pylist()
            width = np.array([len(x) for x in sketches])
            width = np.minimum.reduceat(width, np.flatnonzero(np.diff(tile, prepend=-1)))[tile]
            best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
            for size in np.unique(width).tolist():
                at = np.flatnonzero(width == size)
                s = folded([sketches[k] for k in at], size)
                for step in range(1, int(np.bincount(tile[at]).max())):
                    x, y = at[:-step], at[step:]
                    same = tile[x] == tile[y]
                    if not same.any():
                        break
                    left = np.flatnonzero(same & (label[x] != label[y]) & ((i[x] == j[x]) | (own[x] != own[y])))
                    x, y = x[left], y[left]
                    if len(left):
                        distance = np.bitwise_count(s[left] ^ s[left + step]).sum(1, dtype=np.int64)
                        near = np.flatnonzero(may_link(percent, distance, n[x], n[y]))
                        for x_, y_, d in zip(x[near].tolist(), y[near].tolist(), distance[near].tolist(), strict=True):
                            a, b = sorted((x_, y_), key=lambda k: int(node[k]))
                            if known[a] is None or int(node[b]) not in known[a]:
                                found = d, int(node[a]), int(node[b])
                                for component in (int(label[a]), int(label[b])):
                                    heap = best.setdefault((int(tile[a]), component), [])
                                    heap.append(found)
                                    if len(heap) > 4 * most:
                                        heap.sort()
                                        del heap[most:]
            largest = {}
            if best:
                tiles, first = np.unique(tile, return_index=True)
                for k in {k for k, _ in best}:
                    own_labels, sizes = np.unique(label[tile == k], return_counts=True)
                    largest[k] = int(own_labels[sizes.argmax()]), int(key[first[k]])
            out = set()
            for (k, component), heap in best.items():
                if component != largest[k][0]:  # what the largest would name, the others do
                    new = {x[1:] for x in sorted(heap)[:most]} - named
                    named.update(new)
                    out |= {(largest[k][1], *x) for x in new} or {(largest[k][1], None, None)}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # whole tiles only: all but the last tile of what is there
            k, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            changes = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != int(v[0]) for c, v in (("key", k), ("i", i), ("j", j))):
                yield from pairs(pa.Table.from_batches(held))
                held = []
            if len(changes):
                cut = int(changes[-1])
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return rows.select(*columns, "sketch", "known").mapInArrow(lean(run), "key long, a long, b long")


def _compared(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """pairs (a, b) -> a, b, linked: compared exactly, on the sets, which come from the texts again.

    A bitmap over the hashes of the texts wanted, a table of FILTER_WORDS words at most, spares most others the way.
    """
    parts = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("cells")), "a")
    parts = parts.select("a", "b", F.pmod(F.xxhash64("b"), F.col("cells")).alias("cell"))
    seats = parts.select("a", "cell", F.col("b").alias("node")).unionByName(parts.select("a", "cell", F.col("a").alias("node")).distinct())
    word = F.shiftrightunsigned("th", 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("word")
    bit = F.expr("shiftleft(1L, cast(th & 63 as int))")
    either = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = either.join(nodes, "node").groupBy(word).agg(F.bit_or(bit).alias("bits"))
    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    texts = texts.withColumn("word", word).join(F.broadcast(wanted), "word").where(F.col("bits").bitwiseAND(bit) != 0).select("text", "th")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, new = batch.slice(at, 500), {}
                for text, th in zip(part.column("text"), part.column("th").to_pylist(), strict=True):
                    if th not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(th)
                        new[th] = text.as_py()
                found = {node_of(tokens): tokens.tobytes() for tokens in shingle_sets(list(new.values()), size)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "tokens"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            out = []
            for a, cell, node, t in zip(*(batch.column(c).to_pylist() for c in ("a", "cell", "node")), batch.column("tokens"), strict=True):
                tokens = np.frombuffer(t.as_buffer().to_pybytes(), np.uint64)
                if (a, cell) != at:  # the cell's own class comes first
                    at, centre = (a, cell), tokens
                    continue
                both = len(np.intersect1d(centre, tokens, assume_unique=True))
                out.append((a, node, 100 * both >= percent * (len(centre) + len(tokens) - both)))
            if out:
                types = pa.int64(), pa.int64(), pa.bool_()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["a", "b", "linked"])

    tokens = texts.mapInArrow(lean(sets), "node long, tokens binary").dropDuplicates(["node"])
    seated = seats.join(tokens, "node").repartition("a", "cell").sortWithinPartitions("a", "cell", F.col("node") != F.col("a"))
    return seated.select("a", "cell", "node", "tokens").mapInArrow(lean(verify), "a long, b long, linked boolean")


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, class_id, component_id; size: words of a shingle.

    class_id: the smallest doc_id with the same set; component_id: the smallest reachable by links.
    """
    with Scratch(docs.sparkSession) as kept:
        staged = kept.keep(_staged(docs, size, percent), "parity")
        rows = staged.where("kind = 'doc'").select("doc_id", "th", "n", "node", "sketch", "key")
        of_class = F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.max("key").alias("room"), F.min("doc_id").alias("rep"), F.min("th").alias("th")
        nodes = kept.keep(rows.groupBy("node").agg(*of_class), "classes")
        loads = staged.where("kind = 'load'").groupBy("node").agg(F.sum("n").alias("load"))
        loaded = loads.join(nodes.select("node", "room"), "node").where("load > room").select("node")
        found = staged.where("kind = 'member'").select("key", "node", "least", "n").distinct()
        members = found.where(F.col("n") <= POPULAR).unionByName(found.where(F.col("n") > POPULAR).join(loaded, "node", "left_semi"))
        members = kept.keep(members.select("key", "node", "least"), "members")
        sketches, hashes = nodes.select("node", "n", "sketch"), nodes.select("node", "th")
        pairs = kept.keep(_stars(members, sketches, percent), "pairs")
        compared = kept.keep(_compared(docs, pairs, hashes, size, percent), "compared")
        labels, apart, most = components(compared.where("linked"), kept), compared.where("not linked").select("a", "b"), 1
        while True:
            before, members = members, kept.keep(_open(members, labels), "open")
            kept.drop(before)
            named = kept.keep(_nearest_outside(members, sketches, apart, percent, most), "named")
            pairs = kept.keep(named.where("a is not null").select("a", "b").distinct(), "pairs")
            if pairs.isEmpty():
                break
            compared = kept.keep(_compared(docs, pairs, hashes, size, percent), "compared")
            labels = joined_components(labels, compared.where("linked"), kept)
            apart = apart.unionByName(compared.where("not linked").select("a", "b"))
            # keys that named nothing never will; the more rounds, the more pairs at once
            before, members, most = members, kept.keep(members.join(named.select("key").distinct(), "key", "left_semi"), "members"), 8 * most
            kept.drop(before, named)
        classes = nodes.join(labels, "node", "left").select("node", F.col("rep").alias("class_id"), F.coalesce("label", "node").alias("label"))
        least = classes.groupBy("label").agg(F.min("class_id").alias("component_id"))
        classes = classes.join(least, "label").select("node", "class_id", "component_id")
        out = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(classes, "node")
        own = [F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "component_id")]
        return stored(out.select("doc_id", "n_shingles", *own), "similar")
