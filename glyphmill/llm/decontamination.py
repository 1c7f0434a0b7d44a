"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. A document and an item are compared if the runs of LEAST words that
they share cover COVERAGE of the item: tiles lie within these runs, so no item that tiles could cover is left out.
Tiling then marks, again and again, the longest runs of unmarked words that both hold, non-overlapping, down to
runs of LEAST words: for a run length, hashes of the item's unmarked runs are looked up by those of the document's
unmarked runs, rolling along both, and matches are confirmed and stretched word by word. Since runs may match in any
order, passages whose parts were moved are covered too. An item whose words are covered to COVERAGE or more
contaminates the document.

The benchmark is a stated query set, taken in blocks of at most BLOCK_BYTES of text: the table is read back in order,
one block at a time is sent to the tasks, and every document meets every block, so nothing depends on its size.
Defined results: null or word-less texts and items match nothing; items shorter than LEAST words need their whole run;
repeated documents or items: a row for each; ties between longest matches: the first in the document; null keys and ids:
carried as null; very long texts: whole; empty tables: no rows; other columns, of any name, are not carried by
`contaminated` and pass through `without_contaminated`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphmill.llm.arrow import alone, parts
from glyphmill.llm.shared import forget, written
from glyphmill.llm.words import mix

LEAST, COVERAGE = 3, 0.6
BLOCK_BYTES = 4 << 20
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def tiles(document: list[int], item: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document start, item start, length) of tiles, longest first, no word in two tiles."""
    free_d, free_i = [True] * len(document), [True] * len(item)
    out, length = [], min(len(document), len(item))
    while length >= least:
        best = longest_matches(document, item, free_d, free_i, length, least)
        if not best:
            break
        length = best[0][2]
        for d, i, n in best:
            if all(free_d[d : d + n]) and all(free_i[i : i + n]):
                free_d[d : d + n], free_i[i : i + n] = [False] * n, [False] * n
                out.append((d, i, n))
    return out


def _rolling(values: list[int], free: list[bool], width: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of each run of `width` unmarked values, by running Karp-Rabin."""
    top = pow(_BASE, width - 1, 1 << 64)
    h = n = 0
    for end, (v, f) in enumerate(zip(values, free, strict=True)):
        if not f:
            h = n = 0
            continue
        if n == width:
            h = (h - values[end - width] * top) & _MASK
            n -= 1
        h = (h * _BASE + v) & _MASK
        n += 1
        if n == width:
            yield end - width + 1, h


def longest_matches(document, item, free_d, free_i, most: int, least: int) -> list[tuple[int, int, int]]:
    """All longest matches of unmarked runs, of `least` values or more.

    Runs of the search length are looked up by hash and stretched to their full length; the search length halves until
    something is found, so that the longest of what is found is the longest there is.
    """
    width = min(most, 16)
    while True:
        seen = defaultdict(list)
        for i, h in _rolling(item, free_i, width):
            seen[h].append(i)
        best, found = 0, []
        if seen:
            for d, h in _rolling(document, free_d, width):
                for i in seen.get(h, ()):
                    if d and i and free_d[d - 1] and free_i[i - 1] and document[d - 1] == item[i - 1] and document[d : d + width] == item[i : i + width]:
                        continue  # a match that began earlier holds this one
                    n = 0
                    while d + n < len(document) and i + n < len(item) and free_d[d + n] and free_i[i + n] and document[d + n] == item[i + n]:
                        n += 1
                    if n >= max(width, best, least):
                        if n > best:
                            best, found = n, []
                        found.append((d, i, n))
        if found:
            return found
        if width <= least:
            return []
        width = max(least, width // 2)


class Block:
    """One block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[object, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.items.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(self.items):
            if len(words) < LEAST:
                self.short[tuple(words)].append(k)
        self.short_lengths = sorted({len(words) for words in self.short})
        # the items' words end to end: each place's item, and the places where a seed begins, by seed
        self.lengths = np.array([len(words) for _, words in self.items], np.int64)
        self.owners = np.repeat(np.arange(len(self.items)), self.lengths)
        runs = [_seeds(np.array(words, np.int64)) for _, words in self.items]
        begins = np.cumsum(self.lengths) - self.lengths
        seeds = np.concatenate([np.zeros(0, np.uint64), *runs])
        places = np.concatenate([np.zeros(0, np.int64), *(b + np.arange(len(r)) for b, r in zip(begins.tolist(), runs, strict=True))])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], places[order]

    def search(self, text: str | None) -> Iterator[tuple[object, float, int]]:
        """(item, coverage, tiles) of each item that contaminates the text."""
        known = self.vocabulary.get
        words = np.fromiter((known(w, 0) for w in words_of(text)), np.int64)
        own = words.tolist()
        for k in sorted({*self._coverable(words), *self._short_hits(own)}):
            item_id, item = self.items[k]
            # words that the item lacks part the document; runs of one word are no tile
            found = tiles(*_relevant(own, item), least=min(LEAST, len(item)))
            coverage = sum(n for _, _, n in found) / len(item)
            if coverage >= COVERAGE:
                yield item_id, coverage, len(found)

    def _coverable(self, words: np.ndarray) -> list[int]:
        """Items of which shared seeds cover COVERAGE or more, the most that tiles can."""
        hashes = np.unique(_seeds(words))
        first, last = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        counts = last - first
        if not counts.any():
            return []
        ends = np.cumsum(counts)
        shared = self.places[np.arange(ends[-1]) + np.repeat(last - ends, counts)]
        covered = np.unique(np.concatenate([shared + j for j in range(LEAST)]))
        items, n = np.unique(self.owners[covered], return_counts=True)
        return items[n / self.lengths[items] >= COVERAGE].tolist()

    def _short_hits(self, words: list[int]) -> Iterator[int]:
        """Items under LEAST words whose run the document holds."""
        for n in self.short_lengths:
            for run in {tuple(words[a : a + n]) for a in range(len(words) - n + 1)}:
                yield from self.short.get(run, ())


def _relevant(document: list[int], item: list[int]) -> tuple[list[int], list[int]]:
    """The document with each run of words that the item lacks shortened to one stranger."""
    inside, out = set(item), []
    for w in document:
        if w in inside:
            out.append(w)
        elif not out or out[-1]:
            out.append(0)
    return out, item


def _seeds(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of LEAST known words."""
    if len(words) < LEAST:
        return np.zeros(0, np.uint64)
    values = mix(words.astype(np.uint64))
    h = np.zeros(len(words) - LEAST + 1, np.uint64)
    known = np.ones(len(h), bool)
    for j in range(LEAST):
        h = h * np.uint64(_BASE) + values[j : j + len(h)]
        known &= words[j : j + len(h)] > 0
    return mix(h)[known]


def benchmark_blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, read one block at a time."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, coverage, tiles) of each document and each item that contaminates it."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    item_type = benchmark.schema[item].dataType
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("item", item_type), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    out = None
    for items in benchmark_blocks(benchmark, item, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            block = Block(sent.value)
            for batch in parts(batches):
                rows = [(k, *found) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for found in block.search(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

        part = source.mapInArrow(alone(run), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = source.sparkSession.createDataFrame([], schema)
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "coverage", "tiles")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that an item contaminates; all columns."""
    at, before = docs.columns.index(text), None
    for n, items in enumerate(benchmark_blocks(benchmark, item, item_text)):
        if n:  # the rows that the blocks so far left, so that a task holds one block
            docs = written(docs, "clean")
            if before is not None:
                forget(docs.sparkSession, before)
            before = docs
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            block = Block(sent.value)
            for batch in parts(batches):
                clean = [next(block.search(t), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(alone(run), docs.schema)
    return docs


def op4(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
