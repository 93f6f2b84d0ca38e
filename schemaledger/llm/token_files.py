"""Token-ID files of patched frame-of-reference blocks, in ascending document order.

A file is ``MAGIC``, four unsigned 64-bit numbers (documents, ids, blocks, flag bytes), one byte per document that is 1 where its id is null,
the document ids (signed 64-bit), their token counts and the byte at which each block starts (both unsigned 64-bit, the
latter with the end as last entry), then the blocks. A block holds ``BLOCK`` ids: its minimum (32-bit), bit width (8-bit)
and number of exceptions (16-bit), the packed low bits of ``id - minimum``, then places (16-bit) and whole values (32-bit)
of the exceptions. The width fits ``PERCENTILE`` percent of the block; only what is wider is an exception. The last
block is filled up with its minimum. All numbers are little-endian.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from ..session import shared_folder, written

MAGIC = b"TOKPFOR1"
BLOCK, PERCENTILE = 512, 90
FILE_IDS = 4_000_000
PIECES_KEPT, CHARS_KEPT = 500_000, 1 << 26
_BATCH, _WORDS = 1024, 1 << 20
_HEAD = 7
# Letters that have one form in NFC and one lower case, and ASCII punctuation.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
# Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free character from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_BYTE_LETTERS = {b: chr(256 + n) for n, b in enumerate(_HIDDEN)}


def packed(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of unsigned 32-bit ids, and where each block starts (with the end)."""
    if not len(ids):
        return b"", np.zeros(1, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids):] = ids[(blocks - 1) * BLOCK:].min()
    full = full.reshape(blocks, BLOCK)
    least = full.min(1)
    rest = full - least[:, None]
    cut = np.partition(rest, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.ceil(np.log2(cut.astype(np.float64) + 1)).astype(np.uint8)
    wide = (rest >> np.minimum(width, 31)[:, None] > 0) & (width < 32)[:, None]
    exceptions = wide.sum(1).astype(np.uint16)
    bits: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            flags = ((rest[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            for row, data in zip(rows.tolist(), np.packbits(flags.reshape(len(rows), -1), axis=1, bitorder="little")):
                bits[row] = data.tobytes()
    head = np.zeros((blocks, _HEAD), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(blocks, 4)
    head[:, 4] = width
    head[:, 5:] = exceptions.astype("<u2").view(np.uint8).reshape(blocks, 2)
    row, place = np.nonzero(wide)
    values, ends = rest[row, place].astype("<u4"), np.cumsum(exceptions.astype(np.int64))
    out = []
    for b in range(blocks):
        lo, hi = int(ends[b]) - int(exceptions[b]), int(ends[b])
        out.append(head[b].tobytes() + bits[b] + place[lo:hi].astype("<u2").tobytes() + values[lo:hi].tobytes())
    return b"".join(out), np.concatenate(([0], np.cumsum([len(b) for b in out]))).astype(np.uint64)


def unpacked(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of blocks (bytes) that start at ``starts``; a slice of both reads a part of a file."""
    blocks = len(starts) - 1
    if not blocks:
        return np.zeros(0, np.uint32)
    begin = starts[:-1].astype(np.int64)
    head = data[begin[:, None] + np.arange(_HEAD)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    width = head[:, 4].astype(np.int64)
    exceptions = np.ascontiguousarray(head[:, 5:]).view("<u2")[:, 0].astype(np.int64)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            raw = data[begin[rows][:, None] + _HEAD + np.arange(BLOCK * w // 8)]
            flags = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            total = np.zeros((len(rows), BLOCK), np.uint32)
            for bit in range(w):
                total |= flags[:, :, bit].astype(np.uint32) << np.uint32(bit)
            rest[rows] = total
    row = np.repeat(np.arange(blocks), exceptions)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = begin[row] + _HEAD + BLOCK * width[row] // 8
    places = np.ascontiguousarray(data[(at + 2 * nth)[:, None] + np.arange(2)]).view("<u2")[:, 0]
    values = np.ascontiguousarray(data[(at + 2 * exceptions[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    rest[row, places] = values
    return (rest + least[:, None]).reshape(-1)[:n]


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks, starts = packed(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    table = np.array([0 if d is None else d for d in doc_ids], "<i8")
    base = len(MAGIC) + 32 + len(null) + 8 * len(table) + 8 * len(counts) + 8 * len(starts)
    head = np.array([len(doc_ids), len(ids), len(starts) - 1, len(null)], "<u8")
    return b"".join((MAGIC, head.tobytes(), null.tobytes(), table.tobytes(), counts.astype("<u8").tobytes(), (starts + np.uint64(base)).astype("<u8").tobytes(), blocks))


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, token counts and all ids of a file."""
    if content[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    docs, n, blocks, flags = np.frombuffer(content, "<u8", 4, len(MAGIC)).astype(np.int64).tolist()
    at = len(MAGIC) + 32
    null = np.frombuffer(content, np.uint8, flags, at)
    table = np.frombuffer(content, "<i8", docs, at + flags)
    counts = np.frombuffer(content, "<u8", docs, at + flags + 8 * docs).astype(np.int64)
    starts = np.frombuffer(content, "<u8", blocks + 1, at + flags + 16 * docs)
    ids = unpacked(np.frombuffer(content, np.uint8), starts, n)
    return [None if missing else d for d, missing in zip(table.tolist(), null.tolist())], counts, ids


class WordCoder:
    """Whole texts to ids. The tokenizer drops white space and merges within words only, so words are encoded once each.

    It also lower-cases and cuts punctuation from letters, so a word of plain letters with ASCII punctuation behind it is
    taken as two pieces; the letters, whose normal form is known, go straight to the library's merge model. Splitting,
    distinct words and pieces are found in Arrow, so Python sees distinct pieces only. The ids of known pieces lie one after
    another in one array, from which the ids of a batch are gathered. Beyond ``PIECES_KEPT`` pieces or
    ``CHARS_KEPT`` characters the memory starts anew.
    """

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.chars = {"": 0}, 0
        self.held, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _remember(self, fresh: list[str]) -> None:
        """Ids of new pieces behind those of the known ones."""
        merged, whole = self.tokenizer.model.tokenize, _LETTERS.fullmatch
        letters = [p for p in fresh if whole(p)]
        other = [p for p in fresh if not whole(p)]
        coded = [array("I", [t.id for t in merged(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_LETTERS))]) for p in letters]
        coded += [array("I", e.ids) for e in self.tokenizer.encode_batch(other, add_special_tokens=False)]
        ids = np.frombuffer(b"".join(coded), "<u4")
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        end = int(self.begin[-1] + self.size[-1])
        if end + len(ids) > len(self.held):
            self.held = np.concatenate((self.held, np.zeros(max(len(self.held), len(ids)), np.uint32)))
        self.held[end: end + len(ids)] = ids
        self.begin = np.concatenate((self.begin, end + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.chars += sum(map(len, fresh))
        self.pieces.update(zip(letters + other, range(len(self.pieces), len(self.pieces) + len(fresh))))

    def ids(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null texts have none."""
        if not len(texts):
            return []
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if len(self.pieces) > PIECES_KEPT or self.chars > CHARS_KEPT:
            self._forget()
        for mark in "\t\r\n":
            texts = pc.replace_substring(texts, mark, " ")
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = split.flatten().dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, _PLAIN)
        head = pc.if_else(cut.is_valid(), pc.utf8_lower(cut.field("letters")), coded.dictionary)
        halves = pa.concat_arrays([head, pc.fill_null(cut.field("marks"), "")]).dictionary_encode()
        asked = halves.dictionary.to_pylist()
        self._remember([p for p in asked if p not in self.pieces])
        piece = np.fromiter(map(self.pieces.__getitem__, asked), np.int64, len(asked))[halves.indices.to_numpy(zero_copy_only=False)]
        halves_of = piece.reshape(2, -1)
        word = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(self.size[halves_of].sum(0)[word])))
        out = []
        for begin in range(0, len(word), _WORDS):
            both = halves_of[:, word[begin: begin + _WORDS]].T.ravel()
            both = both[self.size[both] > 0]
            size = self.size[both]
            before = np.cumsum(size) - size
            out.append(self.held[np.arange(int(size.sum())) + np.repeat(self.begin[both] - before, size)])
        edges = split.offsets.to_numpy()
        return np.split(np.concatenate(out), ends[edges - edges[0]][1:-1])


_coders: dict[tuple[int, int], WordCoder] = {}


def word_coder(file: bytes) -> WordCoder:
    """One coder per Python worker and vocabulary."""
    key = (zlib.crc32(file), len(file))
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordCoder(file)
    return _coders[key]


def write_token_files(docs: DataFrame, folder: str, file: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Token files of all documents below ``folder``; returns the manifest ``part, seq, file, n_docs, n_ids``.

    Documents are ordered by id (nulls first), rows of one id by their text. Each ends with ``end_id``; a null text is
    empty. Range partitions are encoded side by side; a task writes files of about ``file_ids`` ids under names of its
    own attempt, and only the files that the manifest names count, so lost and repeated tasks do no harm.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = given.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
        store.create_dir(base, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        held_docs: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0
        made: list[tuple] = []

        def close() -> None:
            nonlocal held_docs, held, total, seq
            if held_docs:
                name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(file_bytes(held_docs, np.array([len(x) for x in held]), np.concatenate(held)))
                made.append((part, seq, name, len(held_docs), total))
                held_docs, held, total, seq = [], [], 0, seq + 1

        for batch in batches:
            for begin in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(begin, _BATCH)
                for doc, ids in zip(rows.column(0).to_pylist(), word_coder(file).ids(rows.column(1))):
                    held_docs.append(doc)
                    held.append(np.append(ids, np.uint32(end_id)))
                    total += len(ids) + 1
                    if total >= file_ids:
                        close()
        close()
        columns = list(zip(*made)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
            ["part", "seq", "file", "n_docs", "n_ids"],
        )

    return written(ordered.mapInArrow(write, "part int, seq int, file string, n_docs long, n_ids long"))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32-bit) of each document in the files.

    ``start`` counts the ids of all documents before. Files that the manifest does not name are not counted.
    """
    whole = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per range partition
    in_part = Window.partitionBy("part").orderBy("seq")
    first = written(manifest.join(before, "part").select("file", (F.col("before") + F.sum("n_ids").over(in_part) - F.col("n_ids")).alias("first")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids, counts, ids = read_file(content)
                ends = np.cumsum(counts)
                name = path.rsplit("/", 1)[-1]
                for lo in range(0, len(doc_ids), 512):
                    hi = min(lo + 512, len(doc_ids))
                    own = [ids[e - c: e].astype("<u4").tobytes() for e, c in zip(ends[lo:hi].tolist(), counts[lo:hi].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (hi - lo)), pa.array(doc_ids[lo:hi], pa.int64()), pa.array(ends[lo:hi] - counts[lo:hi]), pa.array(counts[lo:hi]), pa.array(own, pa.binary())],
                        ["file", "doc_id", "local", "n_tokens", "ids"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    rows = files.select("path", "content").mapInArrow(read, "file string, doc_id long, local long, n_tokens long, ids binary")
    return rows.join(first, "file").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, file: bytes, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the documents' token files and read them back; an empty table writes none and gives no rows."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    manifest = write_token_files(docs, folder, file, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    return read_token_files(spark, folder, manifest)
