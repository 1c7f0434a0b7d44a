"""Text to ids by pieces: the pre-tokenizer's pieces are looked up in a bounded cache, missing ones encoded in bulk.

Pieces are what the tokenizer file's normaliser and splitting pattern yield; they are encoded independently of each
other, so a text's ids are those of its pieces, in order. Characters whose class differs between Unicode versions
send a text through the library's own normaliser and splitter; special strings in a text become their own ids.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import regex
import tokenizers

from glyphmill.llm.words import Scan, scans

#: Splitting patterns of the two files, as the library applies them (fixed values).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Outside these blocks, whose characters all Unicode versions class alike, the library itself splits.
_UNSURE = regex.compile(r"[^\x00-ԯḀ-ỿ -⁤₠-₿←-⏿぀-ゖ゠-ヾ一-鿌가-힣]")
_CACHE_ENTRIES = 1_200_000


class Splitter:
    """Pieces of a text as the tokenizer file's normaliser and pre-tokenizer give them."""

    def __init__(self, library: tokenizers.Tokenizer, words: bool):
        self.words = words
        self.find = regex.compile(WORD_PATTERN if words else BYTE_PATTERN).findall
        self.library = library
        self.special = {t.content for t in library.get_added_tokens_decoder().values()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")").split

    def __call__(self, text: str) -> list[str]:
        if "<|" in text and any(s in text for s in self.special):
            return [p for part in self.cut(text) for p in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if _UNSURE.search(text):
                text = self.library.normalizer.normalize_str(text) if self.words else text
                return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
            if self.words:
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower() if self.words else text)


def _spaced(part: np.ndarray) -> np.ndarray:
    """Positions of white space other than \\x20 and \\x09-\\x0D, whose runs may go on across units."""
    at = np.flatnonzero(_LEADS[part])
    at = at[at + 2 < len(part) + 1]
    if not len(at):
        return at
    wide = np.r_[part, np.zeros(2, np.uint8)]
    a, b, c = (wide[at + k].astype(np.int64) for k in range(3))
    two, three = a << 8 | b, a << 16 | b << 8 | c
    return at[(two == 0xC285) | (two == 0xC2A0) | np.isin(three, _WIDE_SPACES)]


_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE_SPACES = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


class UnitEncoder:
    """Values of whole documents through a bounded cache of units: a word with the white space before it (which the
    word tokenizer drops), or the white space that ends a text. The pieces of a unit do not depend on its neighbours.
    A unit is known by 64 bits of hash and its length. `encode` maps pieces to (flat values, values per piece).
    """

    def __init__(self, split: Splitter, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int]):
        self.split, self.encode, self.special = split, encode, special
        self._reset()

    def _reset(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat values, values per text) without the cache."""
        found = [self.split(t) for t in texts]
        pieces = [p for ps in found for p in ps]
        new = list(dict.fromkeys(pieces))
        plain = [p for p in new if p not in self.special]
        flat, counts = self.encode(plain)
        marks = [p for p in new if p in self.special]
        flat = np.r_[flat, np.array([self.special[p] for p in marks], np.int32)]
        counts = np.r_[counts, np.ones(len(marks), np.int64)]
        row = dict(zip(plain + marks, range(len(new)), strict=True))
        rows = np.fromiter(map(row.__getitem__, pieces), np.int64, len(pieces))
        values, n = ragged(flat, np.cumsum(counts) - counts, counts, rows)
        return values, sums(n, np.fromiter(map(len, found), np.int64, len(found)))

    def __call__(self, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, one past the last, flat values, values per document) for slices of a string column."""
        for scan in scans(column, slice_bytes=1 << 19):
            yield scan.first, scan.last, *self._slice(scan)

    def _slice(self, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
        docs = scan.last - scan.first
        cuts = scan.cuts
        words = np.diff(scan.bounds)
        if self.split.words:
            begin, end, per_doc = scan.starts, scan.ends, words
        else:  # units run from the end before to the word's end; what is left of a document is one more
            tail = np.where(words > 0, np.r_[scan.ends, 0][scan.bounds[1:] - 1], cuts[:-1]) < cuts[1:]
            per_doc = words + tail
            last = np.cumsum(per_doc)
            end = np.zeros(last[-1] if docs else 0, np.int64)
            of = np.repeat(np.arange(docs), words)
            end[np.arange(len(scan.ends)) + (np.cumsum(tail) - tail)[of]] = scan.ends
            end[last[tail] - 1] = cuts[1:][tail]
            begin = np.r_[0, end[:-1]]
        if not len(end):
            return np.zeros(0, np.int32), np.zeros(docs, np.int64)
        rows = self._rows(scan, begin, end)
        flat, counts = ragged(self.flat, self.at, self.count, rows)
        per_doc_values = sums(counts, per_doc)
        odd = np.unique(np.searchsorted(cuts, _spaced(scan.data), "right") - 1)
        if len(odd) and not self.split.words:
            whole, n = self._values([bytes(scan.data[cuts[d] : cuts[d + 1]]).decode() for d in odd])
            parts, ends = np.split(flat, np.cumsum(per_doc_values)[:-1]), np.cumsum(n)
            for k, d in enumerate(odd):
                parts[d], per_doc_values[d] = whole[ends[k] - n[k] : ends[k]], n[k]
            flat = np.concatenate(parts)
        return flat, per_doc_values

    def _rows(self, scan: Scan, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = scan.spans(begin, end)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > _CACHE_ENTRIES or self.used > 8 * _CACHE_ENTRIES:
            self._reset()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        new = np.flatnonzero(~known)
        row = np.zeros(len(distinct), np.int64)
        row[known] = self.rows[at[known]]
        if len(new):
            data = scan.data.tobytes()
            values, counts = self._values([data[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            while self.used + len(values) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            self.flat[self.used : self.used + len(values)] = values
            row[new] = len(self.at) + np.arange(len(new))
            self.at = np.r_[self.at, (self.used + np.cumsum(counts) - counts).astype(np.int32)]
            self.count = np.r_[self.count, counts.astype(np.int32)]
            self.used += len(values)
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.rows = np.insert(self.rows, at[new], row[new])
        return row[back]


def ragged(flat: np.ndarray, at: np.ndarray, count: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the given rows one after the other, values per row)."""
    counts = count[rows]
    ends = np.cumsum(counts)
    return flat[np.repeat(at[rows] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], counts


def sums(values: np.ndarray, per_group: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, which may be empty."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(per_group)
    return total[ends] - total[ends - per_group]
