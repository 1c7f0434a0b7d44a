"""Toxicity by compression distance: windows of a text are compressed with a dictionary trained on ordinary text and with
one trained on toxic text, and the lengths compared.

A window is a lower-cased word with the spaces around it. Each of its bytes is followed by its place in the word, so
that a match means the same letters at the same place, and two fixed runs of incompressible bytes, which the
dictionaries know, keep the compressor from storing it as it is and from leaving its last bytes unmatched. What a
window gains is its length under the ordinary dictionary less that under the toxic one.

Fitting takes a bounded sample of labelled rows: at most TRAIN_DOCS of each label, of texts of at most TRAIN_BYTES
bytes, in the order of a hash of the key. zstandard trains one dictionary on the windows of ordinary texts, and one on
windows of toxic texts. Most of a toxic text is ordinary, and a dictionary of all of it tells little; the toxic one is
trained on the windows that bear evidence: those of which a beginning (BEGINNINGS bytes, or the whole) is in so many
more toxic than ordinary texts that the log-likelihood ratio is EVIDENCE or more. A window counts for a text only where
its neighbours are new, so that copies of one text count once. No language is told apart: evidence is counted over all.

Calibration: the sample is dealt into FOLDS; dictionaries of the other folds measure each, a logistic function of how
many windows gain how much is fitted to that, and the cut with the best F1 is moved to the score REJECT.

Defined results: null or empty text: the score of a text without windows; a sample without both labels in all folds, or
without evidence: score 0 for all; repeated rows and ties: equal scores; very long texts: scored whole, each distinct
word measured once; rows without a label: scored like all; null keys: scored, never learned from; empty table: no rows;
other columns pass through, columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.arrow import alone, parts, with_columns

TRAIN_DOCS, TRAIN_BYTES, FOLDS = 2000, 65536, 4
ORDINARY_BYTES, TOXIC_BYTES = 65536, 4096
BEGINNINGS, EVIDENCE = (4, 5, 6, 7, 8), 8.0
#: Gains that a document's windows are counted by.
STEPS = (2, 4, 6, 9)
REJECT = 0.7
#: Distinct windows whose gains a task remembers; forgotten when full.
_CACHE = 400_000
#: Rows that `without_toxic` hands back at once.
_ROWS = 500

_NOISE = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(4))
_HEAD, _TAIL = _NOISE[:96], _NOISE[96:108]
_STRIP = b".,;:!?\"'()[]*%$&#|<>"
_PLACES = bytes(range(128, 250))


def windows(text: str | None) -> list[bytes]:
    """The windows of a text, in order."""
    return [b" " + w + b" " for w in (x.strip(_STRIP) for x in (text or "").encode().lower().split()) if w]


def placed(window: bytes) -> bytes:
    """Each byte followed by its place; all places far into a word are one."""
    out = bytearray(2 * len(window))
    out[::2] = window
    out[1::2] = _PLACES[: len(window)] + b"\xff" * max(0, len(window) - len(_PLACES))
    return bytes(out)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    content += _HEAD
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    bits = max(15, len(content).bit_length())
    how = zstandard.ZstdCompressionParameters(
        window_log=bits, chain_log=bits, hash_log=bits, search_log=5, min_match=6, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer takes from placed windows (its entropy tables, which short windows do not use, are left
    off), most useful last; all distinct windows where they fit."""
    often = Counter(samples)
    if sum(map(len, often)) <= size:
        return b"".join(sorted(often, key=lambda s: (often[s], s)))
    return zstandard.train_dictionary(size, samples, k=24, d=8).as_bytes()[-(size - 300) :]


def _beginnings(window: bytes) -> list[bytes]:
    return [*(window[: n + 1] for n in BEGINNINGS if len(window) > n + 2), window]


def fresh_windows(texts: list[str]) -> list[list[bytes]]:
    """The distinct windows of each text whose neighbours no text before it has."""
    seen: set[int] = set()
    out = []
    for text in texts:
        own, fresh = windows(text), set()
        for before, window, after in zip([b"", *own], own, [*own[1:], b""], strict=False):
            around = hash((before, window, after))
            if around not in seen:
                seen.add(around)
                fresh.add(window)
        out.append(sorted(fresh))
    return out


def _evidence(toxic: Counter, ordinary: Counter, n1: int, n0: int) -> set[bytes]:
    """Beginnings in so many more toxic texts than ordinary ones that chance does not explain it."""
    out = set()
    for beginning, a in toxic.items():
        b = ordinary.get(beginning, 0)
        if a > 1 and a * n0 > 4 * b * n1:
            rate = (a + b) / (n1 + n0)
            cells = ((a, n1 * rate), (n1 - a, n1 * (1 - rate)), (b, n0 * rate), (n0 - b, n0 * (1 - rate)))
            if sum(o * math.log(o / e) for o, e in cells if o > 0) >= EVIDENCE:
                out.add(beginning)
    # of a beginning and longer ones, the longest that nearly always follows, else the shortest
    longest = {p for p in out if not any(q != p and q.startswith(p) and toxic[q] >= 0.8 * toxic[p] for q in out)}
    return {p for p in longest if not any(p != q and p.startswith(q) for q in longest)}


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)

    def measure(self) -> Model:
        self.plain, self.other = _compressor(self.ordinary), _compressor(self.toxic)
        self.known: dict[bytes, int] = {}
        return self

    def gains(self, text: str | None) -> np.ndarray:
        """Bytes each window of a text gains under the toxic dictionary."""
        plain, other, known = self.plain.compress, self.other.compress, self.known
        if len(known) > _CACHE:
            known.clear()
        out = []
        for window in windows(text):
            gain = known.get(window)
            if gain is None:
                framed = _HEAD + placed(window) + _TAIL
                gain = known[window] = len(plain(framed)) - len(other(framed))
            out.append(gain)
        return np.array(out, np.int64)

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, features(self.gains(text)))))))))


def features(gains: np.ndarray) -> np.ndarray:
    n = max(1, len(gains))
    counts = [int((gains >= step).sum()) for step in STEPS]
    top = [*sorted(gains.tolist())[:-3:-1], 0, 0]
    return np.array([1.0, *map(math.log1p, counts), *(math.log1p(100 * c / n) for c in counts), min(top[0], 20) / 4, min(top[1], 20) / 4, math.log(n)])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[0.3] * (x.shape[1] - 1)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _best_cut(values: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, halfway to the next value below."""
    order = np.argsort(-values, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ordered = values[order]
    f1[:-1][ordered[:-1] == ordered[1:]] = -1  # no cut between equal values
    k = int(np.argmax(f1))
    return float(ordered[k] if k + 1 == len(y) else (ordered[k] + ordered[k + 1]) / 2)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries of all texts; weights and cut from folds that the dictionaries of the others measure."""
    y = np.array(labels, np.int64)
    pool: dict[bytes, bytes] = {}  # one object for each distinct window
    own = [[pool.setdefault(w, w) for w in ws] for ws in fresh_windows(texts)]
    made = {w: placed(w) for w in pool}
    samples = [[made[w] for w in ws] for ws in own]
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS

    # only beginnings in two toxic texts or more can be evidence: a sieve by hash lets all of them through, and few others
    sieve = bytearray(1 << 22)
    for i in np.flatnonzero(y == 1):
        for b in {b for w in own[i] for b in _beginnings(w)}:
            at = hash(b) & (len(sieve) - 1)
            sieve[at] = min(2, sieve[at] + 1)

    def beginnings_of(part: np.ndarray) -> Counter:
        return Counter(b for i in np.flatnonzero(part) for b in {b for w in own[i] for b in _beginnings(w) if sieve[hash(b) & (len(sieve) - 1)] > 1})

    counts = {(f, label): beginnings_of((fold == f) & (y == label)) for f in range(FOLDS) for label in (0, 1)}
    total = {label: Counter() for label in (0, 1)}
    for (_, label), found in counts.items():
        total[label].update(found)

    def dictionaries(without: int) -> Model | None:
        use = fold != without
        n1, n0 = int((use & (y == 1)).sum()), int((use & (y == 0)).sum())
        if not n1 or not n0:
            return None
        left = {label: Counter(total[label]) for label in (0, 1)}
        for label in (0, 1):
            left[label].subtract(counts.get((without, label), {}))
        chosen = _evidence(left[1], left[0], n1, n0)
        bearing = [s for i in np.flatnonzero(use & (y == 1)) for w, s in zip(own[i], samples[i], strict=True) if not chosen.isdisjoint(_beginnings(w))]
        if not bearing:
            return None
        return Model(dictionary([s for i in np.flatnonzero(use & (y == 0)) for s in samples[i]], ORDINARY_BYTES), dictionary(bearing, TOXIC_BYTES)).measure()

    model = dictionaries(-1)
    x = np.zeros((len(y), len(features(np.zeros(0)))))
    for f in range(FOLDS):
        part = dictionaries(f)
        if model is None or part is None:
            return Model()
        for i in np.flatnonzero(fold == f):
            x[i] = features(part.gains(texts[i]))
    weights = _logistic(x, y)
    weights[0] += math.log(REJECT / (1 - REJECT)) - _best_cut(x @ weights, y)
    model.weights = weights.tolist()
    return model


def is_held_out(key: str) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(key))
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("__y")).withColumn("h", F.xxhash64(key))
    sample = [known.where(F.col("__y") == y).orderBy("h", key).limit(TRAIN_DOCS) for y in (0, 1)]  # keys only, so bounded
    texts = docs.select(key, F.col(text).alias("__t")).where(F.col("__t").isNotNull() & (F.octet_length("__t") <= TRAIN_BYTES))
    rows = texts.join(F.broadcast(sample[0].unionByName(sample[1])), key)
    taken = rows.select("h", "__t", "__y").orderBy("h", "__t").limit(2 * TRAIN_DOCS).collect()
    taken.sort(key=lambda r: (r["h"], r["__t"]))
    return fit([r["__t"] for r in taken], [r["__y"] for r in taken])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score and predicted (1 from REJECT on)."""
    parts = (model.ordinary, model.toxic, model.weights)

    def make():
        own = Model(*parts).measure()

        def slices(column):
            found = np.array([own.score(t) for t in column.to_pylist()])
            yield 0, len(column), [pa.array(found, pa.float64()), pa.array((found >= REJECT).astype(np.int32))]

        return slices

    return with_columns(df, text, [("score", "double"), ("predicted", "int")], make)


def without_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df without the rows that score REJECT or more; all columns as they are, whatever their names."""
    at = df.columns.index(text)
    fitted = (model.ordinary, model.toxic, model.weights)

    def run(batches):
        own = Model(*fitted).measure()
        for part in parts(batches, _ROWS):
            yield part.filter(pa.array([own.score(t) < REJECT for t in part.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(alone(run), df.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
