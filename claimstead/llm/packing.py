"""Best-fit packing of tokenised documents into sequences of fixed length.

Bounded-space online best-fit. Each packing task keeps a fixed number of open sequences, indexed by their
free space in a bitset, so that the fullest sequence a piece fits into is found with a few bit operations;
when another has to be opened and all places are taken, the fullest is closed first.

Only lengths are packed: texts are encoded where they are read, and what moves is one small row a piece.
Groups of a fixed number of tokens are packed independently, so neither time nor memory of a task grows
with the corpus, and what is left open at a group's end is a fixed share of it at most.

Defined results: null and empty texts are one piece holding the end id; repeated rows are packed each on
its own; an empty table gives an empty result; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.llm.common import durable, lean
from claimstead.llm.pieces import forget, library_encoder, pack

SEQUENCE = 1024
OPEN = 512
GROUP_TOKENS = 1 << 24


class OpenSequences:
    """At most `places` sequences that still take pieces."""

    def __init__(self, capacity: int = SEQUENCE, places: int = OPEN):
        self.capacity, self.places, self.count, self.made = capacity, places, 0, 0
        self.mask = 0  # bit f: some open sequence has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        sequence = stack.pop()
        if not stack:
            self.mask ^= 1 << free
        self.count -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        """The number of the sequence that takes the piece, and the piece's offset there."""
        if fitting := self.mask >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.count >= self.places:
                self._take((self.mask & -self.mask).bit_length() - 1)
            sequence, free = self.made, self.capacity
            self.made += 1
        if left := free - length:
            self.by_free[left].append(sequence)
            self.mask |= 1 << left
            self.count += 1
        return sequence, self.capacity - free


def cut(n: int, capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, and before them the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def tokenised_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = SEQUENCE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = library_encoder(vocabulary), pack([end_id])
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], _NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, forget), _PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE, places: int = OPEN) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of at most capacity. pieces is read more than once."""
    part = pieces.where(F.col("length") < capacity)
    tokens = part.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // GROUP_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, base = OpenSequences(capacity, places), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [open_.place(n) for n in batch.column("length").to_pylist()]
            columns = [pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "sequence_id", "offset"])

    dealt = part.repartition(groups).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32")
    packed = dealt.mapInArrow(run, f"{_PIECES}, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity)
    full = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def best_fit_pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = SEQUENCE, places: int = OPEN) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(durable(tokenised_pieces(docs, vocabulary, end_id, capacity)), capacity, places)
