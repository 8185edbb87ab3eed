"""A content-addressed store of token ids.

Rolling hashes over the ids cut every document's stream into chunks where its content says so; a chunk's
address is the SHA-256 of its bytes, and each distinct chunk is stored once. A document is a recipe (the
addresses in order) with the Merkle root over them. The store is one table in two parts:

    kind=chunk    address, payload (little-endian unsigned 16-bit ids, 32-bit where the vocabulary needs it), n_ids
    kind=recipe   doc_id, row_key, n_ids, addresses, root

and a manifest beside it, the recipes in ascending order of doc_id with each document's start in the stream
of all ids. Reading back checks every chunk against its address and every recipe against its root; the
CRC-32 of a document is combined from those of its chunks, so no payload is moved to read a document's sum.

Text is encoded once; one shuffle by address makes chunks unique, after each task has dropped the copies it
saw itself. A chunk that a third of all documents share thus reaches its task once per input partition.

Defined results: null and empty texts are documents of the end id alone; repeated rows are documents each;
ties of doc_id keep the order of reading; null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimstead.llm.common import new_path
from claimstead.llm.pieces import library_encoder, pack

WINDOW, SHORTEST, MEAN_BITS, LONGEST = 8, 64, 9, 4096


def _gear(size: int = 1 << 16) -> np.ndarray:
    """A fixed 64-bit number for each id (the splitmix64 finaliser)."""
    z = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_GEAR = _gear()


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a non-empty stream of ids."""
    n, ends, last = len(ids), [], 0
    if n > SHORTEST:
        rolled = np.zeros(n, np.uint64)
        gear = _GEAR[ids & 0xFFFF]
        for k in range(WINDOW):
            rolled[k:] += gear[: n - k] << np.uint64(k)
        for at in (np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + 1).tolist():
            while at - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if at - last >= SHORTEST:
                last = at
                ends.append(at)
        while n - last > LONGEST:
            last += LONGEST
            ends.append(last)
    return [*ends, n] if last < n else ends


def merkle_root(leaves: list[bytes]) -> bytes:
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [hashlib.sha256(b"\1" + b"".join(p)).digest() if len(p) == 2 else p[0] for p in pairs]
    return level[0]


def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


@lru_cache(maxsize=64)
def _zero_bytes(power: int) -> tuple[int, ...]:
    """The matrix over GF(2) by which 2**power zero bytes change a CRC-32 register."""
    if power:
        half = _zero_bytes(power - 1)
        return tuple(_times(half, x) for x in half)
    bit = (0xEDB88320, *(1 << k for k in range(31)))
    for _ in range(3):
        bit = tuple(_times(bit, x) for x in bit)
    return bit


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a concatenation, from (CRC-32, bytes) of its parts."""
    out = 0
    for crc, size in parts:
        power = 0
        while size >> power:
            if size >> power & 1:
                out = _times(_zero_bytes(power), out)
            power += 1
        out ^= crc
    return out


_STAGED = "kind string, key binary, doc_id long, row_key long, n_ids long, addresses array<binary>, root binary, payload binary"
_ARROW = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_ids", pa.int64()), ("addresses", pa.list_(pa.binary())), ("root", pa.binary()), ("payload", pa.binary())])
_ROWS = 512


def _staged(docs: DataFrame, vocabulary: str, end_id: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_encoder(vocabulary), pack([end_id])
        seen: set[bytes] = set()
        row_key, rows = TaskContext.get().partitionId() << 40, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode(text) + end, "<u4")
                if int(ids.max()) >> 8 * width:
                    raise ValueError(f"an id of this vocabulary needs more than {width} bytes")
                stored, start, addresses = ids.astype(f"<u{width}").tobytes(), 0, []
                for at in cut_points(ids):
                    payload = stored[width * start : width * at]
                    addresses.append(address := hashlib.sha256(payload).digest())
                    if address not in seen:
                        seen.add(address)
                        rows.append(("chunk", address, None, None, at - start, None, None, payload))
                    start = at
                rows.append(("recipe", row_key.to_bytes(8, "little"), doc_id, row_key, len(ids), addresses, merkle_root(addresses), None))
                row_key += 1
                if len(rows) >= _ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _STAGED)


def write_store(docs: DataFrame, vocabulary: str, path: str, end_id: int = 2, width: int = 2) -> None:
    """Writes path/store and path/manifest. width: bytes of an id, 2 or 4."""
    spark = docs.sparkSession
    staged = _staged(docs, vocabulary, end_id, width)
    copy = F.row_number().over(Window.partitionBy("key").orderBy("n_ids"))
    unique = staged.withColumn("copy", copy).where((F.col("kind") == "recipe") | (F.col("copy") == 1)).drop("copy")
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/store")
    recipes = _read(spark, path, "recipe").select("doc_id", "row_key", "n_ids", "addresses", "root")
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row_key"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_key").withColumn("shard", F.spark_partition_id())
    ordered.write.parquet(f"{path}/manifest")


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    schema = "key binary, doc_id long, row_key long, n_ids long, addresses array<binary>, root binary, payload binary, kind string"
    return spark.read.schema(schema).parquet(f"{path}/store").where(F.col("kind") == kind)


def read_chunks(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """address, n_ids and the CRC-32 over 32-bit ids of every stored chunk; fails on a chunk that isn't what its address says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(hashlib.sha256(p).digest() != k for k, p in zip(keys, payloads, strict=True)):
                raise ValueError("a stored chunk differs from its address")
            crcs = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // width for p in payloads], pa.int64()), pa.array(crcs, pa.int64())], ["address", "size", "crc"])

    return _read(spark, path, "chunk").select("key", "payload").mapInArrow(run, "address binary, size long, crc long")


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    schema = "doc_id long, row_key long, n_ids long, addresses array<binary>, root binary, shard int"
    manifest = spark.read.schema(schema).parquet(f"{path}/manifest")
    totals = manifest.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each file
    before, bases = 0, []
    for r in totals:
        bases.append((r["shard"], before))
        before += r["n"]
    bases = F.broadcast(spark.createDataFrame(bases, "shard int, base long"))
    so_far = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "row_key").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("doc_id", "row_key", "n_ids", "root", "shard").withColumn("within", F.coalesce(F.sum("n_ids").over(so_far), F.lit(0))).join(bases, "shard")
    starts = starts.select("row_key", "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_ids", "root")
    links = manifest.select("row_key", F.posexplode("addresses").alias("pos", "address"))
    parts = links.join(read_chunks(spark, path, width), "address", "left")
    whole = parts.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("pos", "address", "size", "crc"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts, root, n in zip(batch.column("parts").to_pylist(), batch.column("root").to_pylist(), batch.column("n_ids").to_pylist(), strict=True):
                if any(p["size"] is None for p in parts) or merkle_root([p["address"] for p in parts]) != root or sum(p["size"] for p in parts) != n:
                    raise ValueError("a document differs from its manifest")
                crcs.append(crc32_joined([(p["crc"], 4 * p["size"]) for p in parts]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_ids")] + [pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.join(whole, "row_key").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, width: int = 2) -> DataFrame:
    """Writes docs to a new store in the shared folder and reads it back."""
    path = new_path(docs.sparkSession, "token-store")
    write_store(docs, vocabulary, path, end_id, width)
    return read_store(docs.sparkSession, path, width)
