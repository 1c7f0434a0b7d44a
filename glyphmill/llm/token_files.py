"""Token-id files in Simple-8b: each 64-bit word has a selector of four bits and as many ids as fit in the other 60.

A file is the magic line, blocks of whole documents, then a footer: each block's byte offset and first id in the file,
and their number. A block: its counts (ids, words, documents, escapes, documents without a key, which come first), the
document keys and lengths, the words, the escaped ids. The selector 0 stands for one id of 2**60 or more, taken from
the escapes in order; selectors 1 to 14 for the counts and widths of LAYOUTS. The footer makes every block addressable
on its own, and its words are unpacked selector by selector with array operations.

Documents are written in ascending order of key (null first; equal keys by checksum of the text), so that the ids of
all files in order are the corpus in order. Defined results: null or empty text: the end id alone; repeated rows: each
its own document; empty table: no files, no rows; other columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import files
from glyphmill.llm.bpe import byte_letters
from glyphmill.llm.pieces import Splitter, UnitEncoder
from glyphmill.llm.shared import dealt_files, fresh_folder, partitions, small_batches, whole_number_key, written

MAGIC = b"simple-8b 3\n"
#: (ids in a word, bits of each), by selector from 1 on; 0 is an escape.
LAYOUTS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 21
_COUNT = np.array([1, *(n for n, _ in LAYOUTS)], np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped ids) of non-negative ids below 2**63."""
    n = len(ids)
    values = np.r_[ids.astype(np.uint64), np.zeros(60, np.uint64)]
    selector = np.zeros(n, np.int64)
    done = np.zeros(n, bool)
    widest, width = values, 1
    largest = {1: widest}  # of runs, by length; runs past the end see zeros
    for count in sorted(c for c, _ in LAYOUTS):
        while width < count:
            step = min(width, count - width)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            width += step
        largest[count] = widest
    for k, (count, bits) in enumerate(LAYOUTS, 1):
        fits = ~done & (largest[count][:n] < np.uint64(1 << bits))
        selector[fits] = k
        done |= fits
    steps, chosen, at = (_COUNT[selector]).tolist(), [], 0
    while at < n:
        chosen.append(at)
        at += steps[at]
    at = np.array(chosen, np.int64)
    selector = selector[at]
    words = selector.astype(np.uint64) << np.uint64(60)
    for k, (count, bits) in enumerate(LAYOUTS, 1):
        rows = np.flatnonzero(selector == k)
        if len(rows):
            cells = values[at[rows][:, None] + np.arange(count)]
            words[rows] |= np.bitwise_or.reduce(cells << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words, values[at[selector == 0]]


def unpack(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of packed words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNT[selector])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - _COUNT[selector]
    out[starts[selector == 0]] = escaped
    for k, (count, bits) in enumerate(LAYOUTS, 1):
        rows = np.flatnonzero(selector == k)
        if len(rows):
            cells = words[rows][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[starts[rows][:, None] + np.arange(count)] = cells & np.uint64((1 << bits) - 1)
    return out[:n]


def block(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a block of documents; those without a key come first."""
    words, escaped = pack(ids)
    head = struct.pack("<QQQQQ", len(ids), len(words), len(keys), len(escaped), keys.count(None))
    return head + b"".join(a.tobytes() for a in (np.array([k or 0 for k in keys], "<i8"), np.array(lengths, "<u8"), words.astype("<u8"), escaped.astype("<u8")))


def footer(offsets: list[int], firsts: list[int]) -> bytes:
    return np.array([*offsets, *firsts, len(offsets)], "<u8").tobytes()


def index_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte offset, first id) of each block, from a file's footer."""
    if not data.startswith(MAGIC):
        raise ValueError("not a token-id file")
    (n,) = struct.unpack_from("<Q", data, len(data) - 8)
    both = np.frombuffer(data, "<u8", 2 * n, len(data) - 8 - 16 * n).astype(np.int64)
    return both[:n], both[n:]


def block_at(data: bytes, at: int) -> tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]:
    """(keys, masked where there is none, lengths, ids) of the block at a byte offset."""
    n, words, docs, escapes, without = struct.unpack_from("<QQQQQ", data, at)
    at += 40
    parts = []
    for kind, count in (("<i8", docs), ("<u8", docs), ("<u8", words), ("<u8", escapes)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += 8 * count
    keys = np.ma.MaskedArray(parts[0], np.arange(docs) < without)
    return keys, parts[1].astype(np.int64), unpack(parts[2], parts[3], n)


def blocks(data: bytes) -> Iterator[tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]]:
    """(keys, lengths, ids) of each block of a file."""
    for at in index_of(data)[0].tolist():
        yield block_at(data, at)


@lru_cache(2)
def _units(path: str) -> UnitEncoder:
    library = tokenizers.Tokenizer.from_file(path)
    letters = {b: c for b, c in enumerate(byte_letters())}

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's own merges, piece by piece: texts reach it already split as its pre-tokenizer splits them."""
        merge = library.model.tokenize
        found = [[t.id for t in merge(piece.encode().decode("latin-1").translate(letters))] for piece in pieces]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    return UnitEncoder(Splitter(library, words=False), encode, special)


def write(df: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int = 2) -> DataFrame:
    """The documents as files of ids, each document followed by the end id; a table (file, part, number, ids, documents)."""
    tie = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    whole_number_key(df, key)
    rows = df.select(F.col(key).cast("long").alias("key"), tie.alias("tie"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(partitions(rows), "key", "tie").sortWithinPartitions("key", "tie").select("key", F.spark_partition_id().alias("part"), "text")

    def run(batches):
        units, number, size = _units(path), 0, 0
        data, total, documents, part = [MAGIC], 0, 0, None
        at, offsets, firsts = len(MAGIC), [], []
        waiting: tuple[list, list, list] = ([], [], [])

        def close_block():
            nonlocal waiting, total, documents, at
            if waiting[0]:
                ids = np.concatenate(waiting[2])
                data.append(block(waiting[0], waiting[1], ids))
                offsets.append(at)
                firsts.append(total)
                at += len(data[-1])
                total, documents = total + len(ids), documents + len(waiting[0])
                waiting = ([], [], [])

        def close_file():
            nonlocal data, total, documents, number, at, offsets, firsts
            close_block()
            data.append(footer(offsets, firsts))
            row = (files.create(folder, b"".join(data), ".s8b"), part, number, total, documents)
            data, total, documents, number = [MAGIC], 0, 0, number + 1
            at, offsets, firsts = len(MAGIC), [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["file", "part", "number", "ids", "documents"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            if keys:
                part = batch.column(1)[0].as_py()
            for first, _, flat, counts in units(batch.column(2)):
                ends = np.cumsum(counts)
                for d, (stop, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    waiting[0].append(keys[first + d])
                    waiting[1].append(n + 1)
                    waiting[2].append(np.append(flat[stop - n : stop], end))
                    size += n + 1
                    if size >= BLOCK_IDS:
                        close_block()
                        size = 0
                if total >= FILE_IDS:
                    yield close_file()
                    size = 0
        close_block()
        if documents:
            yield close_file()

    return rows.mapInArrow(run, "file string, part int, number int, ids long, documents long")


def read(listing: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in the files of a listing; start counts over all files."""
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    based = listing.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0))).select("file", "base")

    def run(batches):
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = files.load(file)
                for at, first in zip(*(c.tolist() for c in index_of(data)), strict=True):
                    keys, lengths, ids = block_at(data, at)
                    start = base + first
                    ends = np.cumsum(lengths)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    arrays = [pa.array(keys.tolist(), pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[key, "start", "n_tokens", "ids_crc32"])

    return dealt_files(based).mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents written as token-id files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listing = write(docs, fresh_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    with small_batches(spark):  # texts go to Python beside the sort, which needs the memory
        listing = written(listing, "listing")
    return read(listing)
