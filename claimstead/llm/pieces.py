"""Whole-text encoding by blank-separated pieces.

The pre-tokenizing pattern always ends a token before a blank that follows a non-space and precedes a
non-space, and nothing after that point changes what came before. So a text whose blanks are all of that
kind is the concatenation of its pieces, each encoded with its leading blank; ids of short pieces are kept
in a bounded table. Any other text (runs of white space, special-token strings) is encoded in one go.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

_LIMIT = 500_000
_LONGEST = 48
#: A letter run and a run of marks after it are two matches of the pattern.
_MARKS = ".,;:!?#$%&*()[]{}<>|/\\-+=_~^@\"`"

Encode = Callable[[str], Iterable[int]]


class _Irregular(Exception):
    pass


class _Table(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, prefix: str, whole: Encode, word: Encode, after_line: _Table | None = None):
        """prefix: what stands before each piece. after_line: the table of pieces without anything before them."""
        super().__init__()
        self.prefix, self.whole, self.word = prefix, whole, word
        self.after_line = self if after_line is None else after_line
        self.older: dict[str, bytes] = {}  # what was kept before the table was last full
        self.marks: dict[str, bytes] = {}
        self.line_end = pack(word("\n"))

    def _marks(self, run: str) -> bytes:
        if run not in self.marks:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[run] = pack(self.word(run))
        return self.marks[run]

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular
        if (ids := self.older.get(piece)) is not None:
            self._keep(piece, ids)
            return ids
        if piece.isalpha():
            ids = pack(self.word(self.prefix + piece))
        elif (letters := piece.rstrip(_MARKS)).isalpha():
            ids = self[letters] + self._marks(piece[len(letters) :])
        elif "\n" in piece:  # between two non-spaces it is a match by itself
            head, *lines = piece.split("\n")
            return self[head] + b"".join(self.line_end + self.after_line[x] for x in lines)
        else:
            ids = pack(self.whole(self.prefix + piece))
        if len(piece) <= _LONGEST:
            self._keep(piece, ids)
        return ids

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(self) >= _LIMIT:
            self.older = dict(self)
            self.clear()
        self[piece] = ids


def pack(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


class PieceEncoder:
    def __init__(self, whole: Encode, word: Encode | None = None, special: str | None = None):
        """whole: text -> its ids. word: the same for one match of the pattern. Texts holding special are not taken apart."""
        self.whole, self.special = whole, special
        self.first = _Table("", whole, word or whole)
        self.rest = _Table(" ", whole, word or whole, self.first)

    def __call__(self, text: str | None) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers; none for null or empty."""
        if not text:
            return b""
        if self.special is None or self.special not in text:
            head, *tail = text.split(" ")
            try:
                return self.first[head] + b"".join(map(self.rest.__getitem__, tail))
            except _Irregular:
                pass
        return pack(self.whole(text))


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_LOADED: dict[str, PieceEncoder] = {}


def forget() -> None:
    """Lets go of the pieces encoded so far."""
    for encoder in _LOADED.values():
        for table in (encoder.first, encoder.rest):
            table.clear()
            table.older = {}


def library_encoder(path: str) -> PieceEncoder:
    """The tokenizers library's ids for the byte-level vocabulary file at path, without added special tokens."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        letters = str.maketrans(dict(enumerate(byte_letters())))
        tokenize = tokenizer.model.tokenize

        def word(text: str) -> list[int]:
            return [x.id for x in tokenize(text.encode().decode("latin-1").translate(letters))]

        _LOADED[path] = PieceEncoder(lambda text: tokenizer.encode(text, add_special_tokens=False).ids, word, "<|")
    return _LOADED[path]
