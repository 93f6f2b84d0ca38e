"""Byte-level BPE in linear time: longest matches from an Aho-Corasick automaton, backtracking over token compatibility.

The encoding of a text is the one sequence of tokens in which every two neighbours are compatible: merging their bytes
by rank gives just these two tokens. So a piece is cut greedily by the longest token at each place; where that does not
fit the token before it, shorter prefixes are tried, and a place from which nothing fits is marked dead and never tried
again. Bytes are Latin-1 characters for the automaton. Compatibility of pairs is memoised, as are the ids of short
chunks of text; both memos are bounded and change no result.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

PAIRS_KEPT, CHUNKS_KEPT, PIECES_KEPT, KEY_CHARS = 100_000, 150_000, 100_000, 32
# White space as the split pattern's \s has it (the Unicode property White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
_CHUNKS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def ranks_of(file: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


class ByteBpe:
    """Encoder and decoder for one rank table; every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        places = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * places
        self.length, self.shorter = array("l", [0]) * places, array("l", [-1]) * places
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.bytes_of[rank], self.length[rank] = token, len(token)
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
        self.automaton.make_automaton()

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; itself twice for a byte or a token that no merge reaches."""
        found = self.halves.get(token)
        if found is None:
            parts = [bytes((b,)) for b in self.bytes_of[token]]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], token))
                if self.ranks.get(parts[best] + parts[best + 1], token) >= token:
                    break
                parts[best: best + 2] = [parts[best] + parts[best + 1]]
            found = self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens, merged by rank, give just the two tokens; remembered in ``pairs``.

        Goes down from the last merge to the bytes at the border. A merge across the border comes first if its rank is
        lower than that of the merge it competes with; of equal ranks the one further left comes first.
        """
        a, b, bound, fits = left, right, 1 << 62, True
        while True:
            if self.ranks.get(self.bytes_of[a] + self.bytes_of[b], bound) < bound:
                fits = False
                break
            of_a, of_b = self._halves(a), self._halves(b)
            whole_a, whole_b = of_a[1] == a, of_b[0] == b
            if whole_a and whole_b:
                break
            if whole_b or (not whole_a and a > b):
                bound, a = a, of_a[1]
            else:
                bound, b = b + 1, of_b[0]
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        self.pairs[left, right] = fits
        return fits

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one match of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, fits, pairs = len(piece), self.length, self.shorter, self.compatible, self.pairs
        longest = [0] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # of one start, longer tokens end later
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while at < n:
            end = at + length[token]
            if not dead[end] and (not out or (fits(out[-1], token) if (known := pairs.get((out[-1], token))) is None else known)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Memo(dict):
    """Values of ``make`` for short keys. Holds at most two generations of ``kept`` keys; the older one goes as a whole."""

    def __init__(self, make, kept: int):
        super().__init__()
        self.make, self.kept, self.older = make, kept, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEY_CHARS:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TextCoder:
    """Whole texts to little-endian 32-bit ids; remembers the ids of short chunks and pieces.

    ``chunked`` says that the pattern never matches across white space, but for one space before a word: then texts are
    cut at white space first, and the pattern is applied to new chunks only.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunked: bool):
        self.bpe, self.chunked = ByteBpe(ranks), chunked
        split = regex.compile(pattern).findall
        pieces = Memo(lambda piece: array("I", self.bpe.encode(piece.encode("utf-8"))).tobytes(), PIECES_KEPT)
        self.chunks = Memo(lambda chunk: b"".join(map(pieces.__getitem__, split(chunk))), CHUNKS_KEPT)

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.chunks.__getitem__, _CHUNKS.findall(text) if self.chunked else [text])) if text else b""

    def decoded(self, ids: bytes) -> bytes:
        return self.bpe.decode(memoryview(ids).cast("I").tolist())


_coders: dict[tuple, TextCoder] = {}


def coder(file: bytes, pattern: str, chunked: bool) -> TextCoder:
    """One coder per Python worker and vocabulary."""
    key = (zlib.crc32(file), len(file), pattern, chunked)
    if key not in _coders:
        _coders.clear()
        _coders[key] = TextCoder(ranks_of(file), pattern, chunked)
    return _coders[key]


def byte_bpe(docs: DataFrame, file: bytes, pattern: str, text_col: str = "text", chunked: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` (long), ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` (binary) at the end.

    ``file`` is the content of a rank file; it goes to the executors with the task. Each match of ``pattern`` is encoded
    by itself; no special tokens. ``decoded`` is made from the ids and equals the UTF-8 bytes of the text. A null or
    empty text has no ids. Columns of these three names are replaced; all others pass through. There is no shuffle.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)
    # Numbered names inside: columns of a table may differ in letter case alone or hold any character.
    inner = rows.toDF(*[f"c{i}" for i in range(len(names))])
    shape = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in inner.schema] + ["n_tokens long", "ids binary", "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ids = coder(file, pattern, chunked)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = [with_ids.ids(text) for text in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([with_ids.decoded(x) for x in ids], pa.binary())],
                    [*part.schema.names, "n_tokens", "ids", "decoded"],
                )

    return inner.mapInArrow(run, shape).toDF(*names, "n_tokens", "ids", "decoded")
