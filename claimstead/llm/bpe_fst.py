"""Byte-level BPE as a finite-state transducer, determinised as it is used; decoding as a stream.

The transducer. A token sequence is the BPE encoding of its bytes exactly when every token encodes to itself
and every two neighbours encode to themselves. So after each byte there is one token that ends the encoding
of what has been read, and what matters of the past is, for each place at which a token may have begun, the
position in the vocabulary's trie and the token before it. A state is the tuple of these; a transition
advances each by the byte, drops what left the trie, and adds the one completed token. States get numbers
and transitions are kept when first needed, in bounded tables. A token is emitted once all live beginnings
agree on it, that is after as many bytes as the longest token has at most.

Matches of the pre-tokenizing pattern are encoded separately; one that is itself in the vocabulary is its
own token, as the rank-file library has it.

Defined results: null is the empty text, which has no ids; repeated rows stand each for itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimstead.llm.pieces import PieceEncoder

_STATES = 300_000
_PAIRS = 1_000_000
_EMIT = 512


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file that every executor has beside the tokenizer libraries."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE as defined: join the neighbours whose union ranks lowest, leftmost first, until none is in the vocabulary."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = rank
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = ((0, -1),)
        self.states: list[tuple[tuple[int, int], ...]] = [start]
        self.number = {start: 0}
        self.moves: list[dict[int, tuple[int, list[int], int, int] | None]] = [{}]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose union makes this one last in its own encoding; itself twice for a byte, None if it never arises."""
        if token not in self.split:
            data, self.split[token] = self.bytes_of[token], None
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) <= 2:
                self.split[token] = self.ranks[parts[0]], self.ranks[parts[-1]]
        return self.split[token]

    def follows(self, last: int, token: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes."""
        if self.halves(token) is None:
            return False
        if last < 0:
            return True
        key = last << 32 | token
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._apart(last, token)
        return ok

    def _apart(self, left: int, right: int) -> bool:
        """Undoes the merges on both sides of the border, the latest first: none across it may have come before."""
        before = 1 << 40
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < before:
                return False
            for side in (0, 1) if left > right else (1, 0):
                whole = right if side else left
                part = self.halves(whole)[0 if side else 1]
                if part != whole:
                    break
            else:
                return True
            if side:
                before, right = whole + 1, part
            else:
                before, left = whole, part

    def _move(self, state: int, byte: int) -> tuple[int, list[int], int, int] | None:
        """(next state, which beginnings live on, which one completed a token, that token); None if not exactly one did."""
        live, stay, done = [], [], []
        for k, (node, last) in enumerate(self.states[state]):
            child = self.children[node].get(byte)
            if child is not None:
                token = self.token_at[child]
                if token >= 0 and self.follows(last, token):
                    done.append((k, token))
                if self.children[child]:
                    live.append((child, last))
                    stay.append(k)
        move = None
        if len(done) == 1:
            k, token = done[0]
            after = (*live, (0, token))
            number = self.number.get(after)
            if number is None:
                number = self.number[after] = len(self.states)
                self.states.append(after)
                self.moves.append({})
            move = (number, stay, k, token)
        self.moves[state][byte] = move
        return move

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > _STATES:
            self._reset()
        out: list[int] = []
        state, pending = 0, [None]  # for each live beginning the tokens before it: (token, those before)
        for at, byte in enumerate(piece):
            move = self.moves[state].get(byte, 0)
            if move == 0:
                move = self._move(state, byte)
            if move is None:  # not a vocabulary that this holds for
                return merge_by_rank(piece, self.ranks)
            state, stay, k, token = move
            new = (token, pending[k])
            pending = [pending[i] for i in stay]
            pending.append(new)
            if at % _EMIT == _EMIT - 1:
                pending = self._emit(pending, out)
                if len(self.states) > _STATES:
                    at_state = self.states[state]
                    self._reset()
                    state = self.number.setdefault(at_state, len(self.states))
                    if state:
                        self.states.append(at_state)
                        self.moves.append({})
        tail, chain = [], pending[-1]
        while chain is not None:
            tail.append(chain[0])
            chain = chain[1]
        out.extend(reversed(tail))
        return out

    @staticmethod
    def _emit(pending: list, out: list[int]) -> list:
        """Moves to out the tokens that all beginnings agree on."""
        chains = []
        for chain in pending:
            tokens = []
            while chain is not None:
                tokens.append(chain[0])
                chain = chain[1]
            chains.append(tokens[::-1])
        n = 0
        for column in zip(*chains, strict=False):
            if len(set(column)) > 1:
                break
            n += 1
        # equal tokens from the start cover equal bytes, so n tokens end at one place for all
        out.extend(chains[0][:n])
        left = []
        for tokens in chains:
            chain = None
            for t in tokens[n:]:
                chain = (t, chain)
            left.append(chain)
        return left


def _utf8_states() -> list[list[int]]:
    """For each state the next one for each byte. 0: between characters; 1 to 3: so many bytes missing;
    4 to 7: a second byte of a restricted range is due; 8: not UTF-8."""
    bad = 8
    table = [[bad] * 256 for _ in range(9)]
    for b in range(0x80):
        table[0][b] = 0
    for first, last, to in ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        for b in range(first, last + 1):
            table[0][b] = to
    for state, first, last, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        for b in range(first, last + 1):
            table[state][b] = to
    return table


_UTF8 = _utf8_states()


class StreamDecoder:
    """ids in any portions -> bytes that end between characters; bytes that are no UTF-8 pass as they are."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.held = bytes_of, b""

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        # the last character begins among the last four bytes: only there can one be unfinished
        cut = len(data)
        for back in range(1, min(4, cut) + 1):
            if not 0x80 <= (byte := data[-back]) < 0xC0:
                if byte >= 0xC0:
                    state = 0
                    for b in data[cut - back :]:
                        state = _UTF8[state][b]
                        if state in (0, 8):
                            break
                    if state not in (0, 8):
                        cut -= back
                break
        self.held = data[cut:]
        return data[:cut]

    def finish(self) -> bytes:
        rest, self.held = self.held, b""
        return rest


class Codec:
    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        matches, encode = regex.compile(pattern).findall, self.transducer.encode
        self.encode = PieceEncoder(lambda text: [i for m in matches(text) for i in encode(m.encode())], lambda word: encode(word.encode()))

    def decode(self, ids: Iterable[int]) -> bytes:
        stream = StreamDecoder(self.transducer.bytes_of)
        return stream.feed(ids) + stream.finish()


_LOADED: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Codec(path, pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and decoded, both binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # ids take more room than text
                part = batch.slice(at, 256)
                ids = [both.encode(t) for t in part.column(1).to_pylist()]
                texts = [both.decode(memoryview(x).cast("I")) for x in ids]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
