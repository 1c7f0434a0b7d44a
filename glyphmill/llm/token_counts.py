"""Token counts by prefix dynamic programming.

Within a piece, the last token of each prefix's encoding is unique: it is the token t ending there whose boundary with
the last token of the prefix before t would survive merging. So count[end] = count[end - len(t)] + 1, one pass gives
the exact count of every prefix of the piece, and sums over pieces those of every prefix of a text. Truncation and
budget questions are then look-ups in what is stored (`PrefixCounts`; as columns `prefix_tokens` and `truncated`).

Two tokens keep their boundary if, undoing merges backwards in time on both sides of it, no merge across it comes
earlier than the younger of the two symbols that meet there (the leftmost of equal merges goes first).

Defined results: null or empty text: 0 tokens, 0 bytes, the table [0], truncated to the empty text; null keys, ties and
repeated rows: each row on its own; very long texts and words: whole; a budget below 0: ValueError; empty table: no rows;
other columns pass through, columns named like the results are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import tokenizers
from pyspark.sql import DataFrame

from glyphmill.llm.arrow import with_columns
from glyphmill.llm.bpe import _NONE, BpeModel, PairTable
from glyphmill.llm.pieces import Splitter, UnitEncoder, sums

_TOGETHER = 24  # pieces up to this many bytes are counted side by side


class PrefixCounter:
    """Counts of all prefixes of pieces under a byte-level merge list."""

    def __init__(self, path: str):
        self.model = m = BpeModel(path)
        if m.suffix:
            raise ValueError("prefixes of a word-end vocabulary are not its pieces")
        self.rank = np.full(m.size, -1, np.int64)
        self.rank[m.made] = np.arange(len(m.made))
        self.first, self.second = np.arange(m.size), np.arange(m.size)
        self.first[m.made], self.second[m.made] = m.left, m.right
        byte_of = {c: b for b, c in enumerate(m.letters)}
        nodes: dict[tuple[int, int], int] = {}
        self.token = [-1]
        for token, i in m.vocab.items():
            if token in m.special:
                continue
            node = 0
            for c in token:
                key = (node, byte_of[c])
                if key not in nodes:
                    nodes[key] = len(self.token)
                    self.token.append(-1)
                node = nodes[key]
            self.token[node] = i
        self.token = np.array(self.token, np.int64)
        self.nodes = nodes
        self.step = PairTable([k[0] for k in nodes], [k[1] for k in nodes], nodes.values())
        self.one = lru_cache(100_000)(lambda a, b: bool(self.meets(np.array([a]), np.array([b]))[0]))

    def meets(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the boundary between the tokens of each pair survives merging."""
        out = np.ones(len(left), bool)
        at = np.arange(len(left))
        limit = np.full(len(left), 2**62)
        while len(at):
            across = self.model.ranks.get(left, right).astype(np.int64)
            broken = (across != _NONE) & (2 * across < limit)
            out[at[broken]] = False
            a, b = self.rank[left], self.rank[right]
            go = ~broken & ((a >= 0) | (b >= 0))
            at, left, right, a, b = at[go], left[go], right[go], a[go], b[go]
            undo_left = a > b
            limit = np.where(undo_left, 2 * a, 2 * b + 1)
            left, right = np.where(undo_left, self.second[left], left), np.where(undo_left, right, self.first[right])
        return out

    def table(self, pieces: list[bytes]) -> np.ndarray:
        """counts[i, n] of the first n bytes of piece i; for pieces of like, small size."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max(initial=0))
        data = np.zeros((len(pieces), width + 1), np.int64)
        inside = np.arange(width + 1) < lengths[:, None]
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        counts, last = np.zeros((len(pieces), width + 1), np.int64), np.full((len(pieces), width + 1), -1, np.int64)
        for start in range(width):
            rows = np.flatnonzero(lengths > start)
            node = np.zeros(len(rows), np.int64)
            for end in range(start, width):
                node = self.step.get(node, data[rows, end])
                go = (node != _NONE) & (lengths[rows] > end)
                rows, node = rows[go], node[go].astype(np.int64)
                if not len(rows):
                    break
                token = self.token[node]
                ends = np.flatnonzero(token >= 0)
                r, t = rows[ends], token[ends]
                if start:
                    fits = self.meets(last[r, start], t)
                    r, t = r[fits], t[fits]
                last[r, end + 1] = t
                counts[r, end + 1] = counts[r, start] + 1
        return counts

    def prefixes(self, piece: bytes) -> np.ndarray:
        """Counts of the first 0, 1, .. bytes of one piece of any length."""
        counts, last = np.zeros(len(piece) + 1, np.int64), [-1] * (len(piece) + 1)
        for start in range(len(piece)):
            node = 0
            for end in range(start, len(piece)):
                node = self.nodes.get((node, piece[end]))
                if node is None:
                    break
                token = int(self.token[node])
                if token >= 0 and (not start or self.one(last[start], token)):
                    last[end + 1] = token
                    counts[end + 1] = counts[start] + 1
        return counts

    def totals(self, pieces: list[bytes]) -> np.ndarray:
        """Count of each whole piece: the last entry of its table."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        for low, high in ((0, 8), (8, 14), (14, _TOGETHER)):
            some = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(some):
                out[some] = self.table([pieces[i] for i in some])[np.arange(len(some)), lengths[some]]
        for i in np.flatnonzero(lengths > _TOGETHER):
            out[i] = self.prefixes(pieces[i])[-1]
        return out


class PrefixCounts:
    """Exact token counts of every prefix of one text."""

    def __init__(self, counter: PrefixCounter, split: Splitter, text: str):
        self.counter, self.split, self.text = counter, split, text
        self.pieces = split(text)
        self.starts = np.r_[0, np.cumsum([len(p) for p in self.pieces])].astype(np.int64)
        self.tables = [self._table(p) for p in self.pieces]
        self.before = np.r_[0, np.cumsum([t[-1] for t in self.tables])].astype(np.int64)

    def _table(self, piece: str) -> np.ndarray:
        return np.array([0, 1]) if piece in self.split.special else self.counter.prefixes(piece.encode())

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]. Only the cut piece and the one before it can split otherwise than in the text."""
        if chars <= 0:
            return 0
        k = int(np.searchsorted(self.starts, chars, "left")) - 1
        k = max(0, min(k, len(self.pieces) - 1) - 1)
        tail = self.split(self.text[self.starts[k] : chars])
        total = int(self.before[k])
        for i, piece in enumerate(tail):
            whole = self.pieces[k + i] if k + i < len(self.pieces) else ""
            known = whole.startswith(piece) and piece not in self.split.special and whole not in self.split.special
            total += int(self.tables[k + i][len(piece.encode())] if known else self._table(piece)[-1])
        return total

    def all(self) -> np.ndarray:
        """Tokens of text[:0], text[:1], .. and of the whole text."""
        return np.fromiter(map(self.count, range(len(self.text) + 1)), np.int64, len(self.text) + 1)

    def truncate(self, budget: int) -> tuple[str, int]:
        """The longest prefix of at most `budget` tokens, and its tokens. A longer prefix may have fewer tokens than a
        shorter one, but one that ends in piece k has more than the pieces before k - 1, which bounds where to look."""
        if budget < 0:
            raise ValueError("a budget is 0 or more")
        if not self.pieces or self.before[-1] <= budget:
            return self.text, int(self.before[-1])
        k = min(int(np.searchsorted(self.before, budget, "left")), len(self.pieces) - 1)  # before[k - 1] < budget
        for n in range(int(self.starts[k + 1]), 0, -1):
            if (tokens := self.count(n)) <= budget:
                return self.text[:n], tokens
        return "", 0


@lru_cache(2)
def _counter(path: str) -> tuple[PrefixCounter, Splitter]:
    return PrefixCounter(path), Splitter(tokenizers.Tokenizer.from_file(path), words=False)


def prefix_tokens(df: DataFrame, path: str, text: str = "text", to: str = "prefix_tokens") -> DataFrame:
    """df with the token counts of the text's first 0, 1, .. characters."""

    def make():
        counter, split = _counter(path)

        def slices(column):
            for i, t in enumerate(column.to_pylist()):
                yield i, i + 1, [pa.array([PrefixCounts(counter, split, t or "").all().tolist()], pa.list_(pa.int32()))]

        return slices

    return with_columns(df, text, [(to, "array<int>")], make)


def truncated(df: DataFrame, path: str, budget: int, text: str = "text", to: str = "truncated", tokens: str = "n_tokens") -> DataFrame:
    """df with the longest prefix of the text that has at most `budget` tokens, and its number of tokens."""
    if budget < 0:
        raise ValueError("a budget is 0 or more")

    def make():
        counter, split = _counter(path)

        def slices(column):
            found = [PrefixCounts(counter, split, t or "").truncate(budget) for t in column.to_pylist()]
            yield 0, len(found), [pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())]

        return slices

    return with_columns(df, text, [(to, "string"), (tokens, "long")], make)


@lru_cache(2)
def _units(path: str) -> UnitEncoder:
    counter, split = _counter(path)
    return UnitEncoder(split, lambda ps: (counter.totals([p.encode() for p in ps]).astype(np.int32), np.ones(len(ps), np.int64)), {s: 1 for s in counter.model.special})


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit)."""

    def make():
        units = _units(path)

        def slices(column):
            sizes = pa.compute.binary_length(column.cast(pa.large_binary()).fill_null(b"")).cast(pa.int64())
            for first, last, counts, per_doc in units(column):
                n = sums(counts, per_doc)
                yield first, last, [sizes.slice(first, last - first), pa.array(n, pa.int64()), pa.array(n > limit)]

        return slices

    return with_columns(df, text, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")], make)


def op10(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
