"""Line-first quality rules: judge each line, drop the lines that fail, reject documents that lose too much text.

A line with a word fails if it is
- unpunctuated: no word of it ends a sentence (. ! ? and the like, closing quotes aside);
- noise: more than 15 % of its characters are punctuation or symbols, from five words on;
- navigation: three or more separators (| > » · •), one to at most four words each;
- boilerplate: it holds a phrase of BOILERPLATE and has at most 30 words.
Lines without a word are neither kept nor lost. A document is kept if it passes the base rules and the lines that fail
hold at most half of the characters of its words.

Everything is counted on slices of many documents at once, on bytes; lines and windows of a document are compared by
64-bit hashes. Defined results: null or empty text: no words, hence base_failed; repeated rows and ties: equal verdicts;
null keys: a row each; very long texts: whole, as a slice of their own; empty table: no rows; other columns pass through,
columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.llm.arrow import with_columns
from glyphmill.llm.words import Scan, mix, scans

MIN_WORDS, REPEAT_WIDTH, REPEAT_PERCENT = 20, 8, 30
MAX_NOISE, MAX_LOST = 0.15, 0.5
BOILERPLATE = (
    "all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "javascript",
    "lorem ipsum", "subscribe to", "sign up for", "log in to", "click here", "copyright ©", "powered by",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _mask(b"#*$%&|<>")
_NOISE = _mask(bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum()))
_SEPARATOR = _mask(b"|>")
_SENTENCE_END, _QUOTE = _mask(b".!?"), _mask(b"\"')]")
_FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])  # first byte of a character
_WIDE_ENDS = np.array([int.from_bytes(c.encode(), "big") for c in "…。！？"])
_WIDE_SEPARATORS = np.array([int.from_bytes(c.encode(), "big") for c in "»·•"])


class Lines:
    """Measures of the lines (split at \\n) of the documents of a scan."""

    def __init__(self, scan: Scan):
        data, cuts = scan.data, scan.cuts
        breaks = np.flatnonzero(data == 10)
        docs = len(cuts) - 1
        per_doc = np.diff(np.searchsorted(breaks, cuts)) + 1
        last = np.cumsum(per_doc)
        self.doc = np.repeat(np.arange(docs), per_doc)
        self.end = np.zeros(last[-1] if docs else 0, np.int64)
        self.end[last - 1] = cuts[1:]
        inner = np.ones(len(self.end), bool)
        inner[last - 1] = False
        self.end[inner] = breaks
        self.begin = np.zeros(len(self.end), np.int64)
        self.begin[1:] = self.end[:-1] + inner[:-1]
        self.first_word, self.end_word = np.searchsorted(scan.starts, self.begin), np.searchsorted(scan.starts, self.end)
        self.words = self.end_word - self.first_word
        self.chars = _between(_FIRST[data] & _inside(scan), self.begin, self.end)
        self.noise = _between(_NOISE[data], self.begin, self.end)
        separators = _SEPARATOR[data]
        wide = np.flatnonzero((data == 0xC2) | (data == 0xE2))
        if len(wide):
            separators = separators.copy()
            separators[wide[_matches(data, wide, _WIDE_SEPARATORS)]] = True
        self.separators = _between(separators, self.begin, self.end)
        self.sentences = _range_sums(_ends_sentence(scan), self.first_word, self.end_word)
        self.boilerplate = np.zeros(len(self.end), bool)
        low = scan.data.tobytes().lower()
        for phrase in BOILERPLATE:
            phrase = phrase.encode()
            at = low.find(phrase)
            while at >= 0:
                line = int(np.searchsorted(self.begin, at, "right")) - 1
                if at + len(phrase) <= self.end[line]:
                    self.boilerplate[line] = True
                at = low.find(phrase, at + len(phrase))

    def failed(self) -> np.ndarray:
        unpunctuated = self.sentences == 0
        noisy = (self.words >= 5) & (self.noise > MAX_NOISE * np.maximum(self.chars, 1))
        navigation = (self.separators >= 3) & (self.words <= 5 * self.separators)
        return (self.words > 0) & (unpunctuated | noisy | navigation | (self.boilerplate & (self.words <= 30)))


def _inside(scan: Scan) -> np.ndarray:
    change = np.zeros(len(scan.data) + 1, np.int8)
    change[scan.starts] += 1
    change[scan.ends] -= 1
    return np.cumsum(change[:-1], dtype=np.int8).astype(bool)


def _range_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[begin]


_between = _range_sums


def _matches(data: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
    padded = np.r_[data, np.zeros(2, np.uint8)]
    a, b, c = (padded[at + k].astype(np.int64) for k in range(3))
    return np.isin(a << 8 | b, codes) | np.isin(a << 16 | b << 8 | c, codes)


def _ends_sentence(scan: Scan) -> np.ndarray:
    """Whether each word ends a sentence, up to two closing quotes or brackets aside."""
    last = scan.ends - 1
    for _ in range(2):
        quoted = _QUOTE[scan.data[last]] & (last > scan.starts)
        last = last - quoted
    out = _SENTENCE_END[scan.data[last]]
    wide = np.flatnonzero((scan.data[last] >= 0x80) & (last - 2 >= scan.starts))
    if len(wide):
        out[wide] |= _matches(scan.data, last[wide] - 2, _WIDE_ENDS)
    return out


def _repeats(scan: Scan) -> np.ndarray:
    """Words of each document in windows of 8 words that its text holds twice or more."""
    docs = len(scan.cuts) - 1
    at, grams = scan.windows(scan.hashes(), REPEAT_WIDTH)
    out = np.zeros(docs, np.int64)
    if not len(at):
        return out
    doc = np.searchsorted(scan.bounds, at, "right") - 1
    own = mix(grams + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.sort(own)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        hit = at[np.isin(own, twice)]
        change = np.zeros(len(scan.starts) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + REPEAT_WIDTH, -1)
        out = _range_sums(np.cumsum(change[:-1]) > 0, scan.bounds[:-1], scan.bounds[1:])
    return out


def measures(scan: Scan) -> dict[str, np.ndarray]:
    """The columns of each document of a scan, and the verdict on its lines."""
    lines, docs = Lines(scan), len(scan.cuts) - 1
    words = np.diff(scan.bounds)
    with_word = lines.words > 0
    of = lines.doc[with_word]
    own = mix(scan.spans(lines.begin[with_word], lines.end[with_word]) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(own, return_index=True)
    total = np.bincount(of, minlength=docs)
    chars = np.bincount(lines.doc, lines.chars, docs).astype(np.int64)
    repeated = _repeats(scan)
    failed = lines.failed()
    lost = np.bincount(lines.doc[failed], lines.chars[failed], docs)
    base = (words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * words)
    return {
        "n_words": words,
        "word_chars": chars,
        "n_symbols": _range_sums(_SYMBOL[scan.data], scan.cuts[:-1], scan.cuts[1:]),
        "n_dup_lines": total - np.bincount(of[first], minlength=docs),
        "n_repeat_words": repeated,
        "base_failed": base,
        "kept": ~base & (lost <= MAX_LOST * chars),
        "lines": lines,
        "failed": failed,
    }


FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean")]


def line_quality(df: DataFrame, text: str = "text", cleaned: str | None = None) -> DataFrame:
    """df with the measures, base_failed and kept; with `cleaned`, also the text without the lines that fail."""

    def make():
        def slices(column):
            for scan in scans(column):
                found = measures(scan)
                arrays = [pa.array(found[n], pa.bool_() if t == "boolean" else pa.int64()) for n, t in FIELDS]
                if cleaned:
                    lines, data = found["lines"], scan.data.tobytes()
                    kept: list[list[bytes]] = [[] for _ in range(len(scan.cuts) - 1)]
                    for i in np.flatnonzero(~found["failed"]):
                        kept[lines.doc[i]].append(data[lines.begin[i] : lines.end[i]])
                    arrays.append(pa.array([b"\n".join(k).decode() for k in kept], pa.string()))
                yield scan.first, scan.last, arrays

        return slices

    return with_columns(df, text, FIELDS + ([(cleaned, "string")] if cleaned else []), make)


def op2(spark, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *[n for n, _ in FIELDS])
