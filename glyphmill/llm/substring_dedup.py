"""Removal of passages that repeat across documents, by repeated-phrase automata.

A window is 50 consecutive words. A word goes if a window that covers it also starts in a document with a smaller
key. Equal texts need no comparison: all but those with the smallest key lose everything. For the distinct texts:

1. Confirm. Each window is known by the smallest of its 25-word hashes; texts that share a window share that value.
   Windows whose value no other text has are out; the others are grouped by their own hash, which gives each
   recurring window its owner, the smallest key. Runs of windows that one text owns are the recurring passages.
2. Compile. Passages are dealt into shards by owner, sized by their bytes. A shard's Aho-Corasick automaton holds,
   for each window of its passages, the 16-word phrase in it with the smallest hash (copies share these phrases).
3. Stream. Each text runs through the automata of the shards that own windows of it. Windows around a phrase found
   are looked up among the shard's windows and compared word by word; those that a smaller key owns are cut.
   A shard that many texts need is copied, and the texts are dealt over its copies.

Equal texts are known by their SHA-256, and numbered; windows are found by 64-bit hashes and compared word by word.

Defined results: null or empty text: no words, nothing removed, the digest of the empty string; texts under 50 words
stay whole; very long texts are processed whole, as a slice of their own; equal keys do not remove from each other; a
null key counts as the largest; keys that are not whole numbers: ValueError; repeated rows: equal results; empty table:
no rows; other columns, of any name, pass through `without_repeats` and are not carried by `repeats`.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.arrow import alone, parts
from glyphmill.llm.shared import forget, join_split, small_batches, whole_number_key, written
from glyphmill.llm.words import scans

WINDOW, ANCHOR, PHRASE = 50, 25, 16
#: Bytes of passages in one automaton, and of texts in one copy of a shard.
SHARD_BYTES, STREAM_BYTES = 2_000_000, 16_000_000
#: Bytes of text that are hashed at once.
SLICE_BYTES = 1 << 18
_LAST = 2**63 - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _window_marks(scan, hashes: np.ndarray):
    """For each document of a scan: the smallest 25-word hash of each of its windows."""
    at, grams = scan.windows(hashes, ANCHOR)
    cuts = np.searchsorted(at, scan.bounds)
    for a, b, words in zip(cuts[:-1].tolist(), cuts[1:].tolist(), np.diff(scan.bounds).tolist(), strict=True):
        yield _sliding_min(grams[a:b], WINDOW - ANCHOR + 1) if words >= WINDOW else np.zeros(0, np.uint64)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])], pa.int32()), pa.array(flat.astype(kind)))


def _survey(docs: DataFrame) -> DataFrame:
    """own, key, id -> n_words, sha, marks: the distinct values of its windows."""
    schema = T.StructType([*docs.select("own", "key", "id").schema.fields, *T._parse_datatype_string("n_words long, sha string, marks array<long>").fields])

    def run(batches):
        for batch in batches:
            column, counts, marks = batch.column(3), [], []
            for scan in scans(column, slice_bytes=SLICE_BYTES):
                counts += np.diff(scan.bounds).tolist()
                marks += [np.unique(m).view(np.int64) for m in _window_marks(scan, scan.hashes())]
            shas = [_sha((t or "").encode().split()) for t in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(shas, pa.string()), _lists(marks, np.int64)], names=schema.names)

    return docs.select("own", "key", "id", "text").mapInArrow(alone(run), schema)


def _recurring(texts: DataFrame) -> DataFrame:
    """key, tk, again (marks that other texts have), text -> key, tk, text, hashes and starts of windows with such marks."""
    schema = T.StructType([*texts.select("key", "tk", "text").schema.fields, *T._parse_datatype_string("hashes array<long>, starts array<int>").fields])

    def run(batches):
        for batch in batches:
            again, column = batch.column(2).to_pylist(), batch.column(3)
            hashes, starts = [], []
            for scan in scans(column, slice_bytes=SLICE_BYTES):
                words = scan.hashes()
                at, wide = scan.windows(words, WINDOW)
                cuts = np.searchsorted(at, scan.bounds)
                for d, marks in enumerate(_window_marks(scan, words)):
                    hit = np.isin(marks, np.array(again[scan.first + d], np.int64).view(np.uint64))
                    hashes.append(wide[cuts[d] : cuts[d + 1]][hit].view(np.int64))
                    starts.append(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column, _lists(hashes, np.int64), _lists(starts, np.int32)], names=schema.names)

    return texts.select("key", "tk", "again", "text").mapInArrow(alone(run), schema)


def _passages(owned: DataFrame) -> DataFrame:
    """shard, key, starts, text of an owner -> shard, key, passage (words joined by spaces)."""
    schema = T.StructType([*owned.select("shard", "key").schema.fields, *T._parse_datatype_string("passage string").fields])

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for shard, key, starts, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, at = text.encode().split(), np.unique(np.array(starts, np.int64))
                for run_ in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    for column, value in zip(out, (shard, key, b" ".join(words[run_[0] : run_[-1] + WINDOW])), strict=True):
                        column.append(value)
            arrays = [pa.array(out[0], batch.column(0).type), pa.array(out[1], batch.column(1).type), pa.array(out[2], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return owned.select("shard", "key", "starts", "text").mapInArrow(alone(run), schema)


class Automaton:
    """Phrases of recurring passages, and the search for every occurrence of the passages' windows in a text."""

    def __init__(self) -> None:
        self.owners: list[int] = []
        self.passages: list[bytes] = []
        self.machine = None

    def add(self, owner: int, passage: bytes) -> None:
        self.owners.append(owner)
        self.passages.append(passage)

    def compile(self) -> None:
        self.words = [p.split(b" ") for p in self.passages]
        self.machine = ahocorasick.Automaton()
        keys, passages, offsets = [], [], []
        for scan in scans(pa.array(self.passages, pa.binary()), slice_bytes=SLICE_BYTES):
            words = scan.hashes()
            at, wide = scan.windows(words, WINDOW)
            keys.append(wide)
            of = np.searchsorted(scan.bounds, at, "right") - 1
            passages.append(scan.first + of)
            offsets.append(at - scan.bounds[of])
            at, grams = scan.windows(words, PHRASE)
            cuts = np.searchsorted(at, scan.bounds)
            for d in range(len(scan.bounds) - 1):
                own = grams[cuts[d] : cuts[d + 1]]
                chosen = np.isin(own, _sliding_min(own, WINDOW - PHRASE + 1))
                for x in np.flatnonzero(chosen).tolist():
                    self.machine.add_word(_spaced(self.words[scan.first + d][x : x + PHRASE]), 1)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.places = np.stack([np.concatenate(passages)[order], np.concatenate(offsets)[order]]) if len(keys) else np.zeros((2, 0), np.int64)
        self.machine.make_automaton()

    def cuts(self, key: int, text: bytes, windows: np.ndarray) -> list[tuple[int, int]]:
        """Runs of windows of a text that occur in passages of smaller keys; windows: the hashes of all its windows."""
        if not len(windows) or not len(self.machine):
            return []
        words = text.split()
        phrases = np.zeros(len(windows) + 1, np.int64)
        begins = np.cumsum([1, *map(len, words)]) + np.arange(len(words) + 1)
        ends = np.array([end for end, _ in self.machine.iter(_spaced(words))], np.int64)
        if not len(ends):
            return []
        found = np.searchsorted(begins, ends + 1) - PHRASE  # the first word of each phrase
        np.add.at(phrases, np.maximum(found + PHRASE - WINDOW, 0), 1)
        np.add.at(phrases, np.minimum(found, len(windows) - 1) + 1, -1)
        at = np.flatnonzero(np.cumsum(phrases[:-1]) > 0)
        row = np.searchsorted(self.keys, windows[at])
        hit = row < len(self.keys)
        hit[hit] = self.keys[row[hit]] == windows[at[hit]]
        at, (passage, offset) = at[hit], self.places[:, row[hit]]
        smaller = np.array([self.owners[p] < key for p in passage.tolist()], bool)
        at, passage, offset = at[smaller], passage[smaller], offset[smaller]
        out = []
        for run in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) != 1) | (np.diff(passage) != 0) | (np.diff(offset) != 1)) + 1):
            if len(run):
                a, b, x = int(at[run[0]]), int(at[run[-1]]) + WINDOW, int(offset[run[0]])
                if words[a:b] == self.words[passage[run[0]]][x : x + b - a]:
                    out.append((a, b))
        return out


def _spaced(words: list[bytes]) -> str:
    """One character per byte, a space on either side of each word."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def _stream(dealt: DataFrame) -> DataFrame:
    """Rows of (shard, copy), passages first, then texts -> key, tk, froms, tos of the words to cut."""
    schema = T.StructType([*dealt.select("key", "tk").schema.fields, *T._parse_datatype_string("froms array<int>, tos array<int>").fields])

    def run(batches):
        group, automaton = None, None
        for batch in batches:
            out = ([], [], [], [])
            *columns, texts = batch.columns
            rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
            for scan in scans(texts, slice_bytes=SLICE_BYTES):
                at, wide = scan.windows(scan.hashes(), WINDOW)
                cuts, data = np.searchsorted(at, scan.bounds), scan.data.tobytes()
                for d in range(len(scan.bounds) - 1):
                    shard, copy, is_text, key, tk = rows[scan.first + d]
                    text = data[scan.cuts[d] : scan.cuts[d + 1]]
                    if group != (shard, copy):
                        group, automaton = (shard, copy), Automaton()
                    if not is_text:
                        automaton.add(key, text)
                        continue
                    if automaton.machine is None:
                        automaton.compile()
                    if found := automaton.cuts(key, text, wide[cuts[d] : cuts[d + 1]]):
                        for column, value in zip(out, (key, tk, [a for a, _ in found], [b for _, b in found]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f) for v, f in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=schema.names)

    return dealt.select("shard", "copy", "is_text", "key", "tk", "text").mapInArrow(alone(run), schema)


def keep_mask(n: int, froms: list[int], tos: list[int]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.array(froms, np.int64), 1)
    np.add.at(change, np.array(tos, np.int64), -1)
    return np.cumsum(change[:-1]) == 0


def _identified(df: DataFrame, key: str, text: str) -> DataFrame:
    """own (the key as it is), key, id (SHA-256 of the text), text."""
    whole_number_key(df, key)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(F.col(key).alias("own"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("key"), F.unhex(F.sha2(body, 256)).alias("id"), F.col(text).alias("text"))


def _find(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survey of all rows; distinct texts of a window or more: id, tk, their smallest key, their number of rows; cuts by
    tk, with the texts)."""
    docs = _identified(df, key, text)
    with small_batches(df.sparkSession):
        survey = written(_survey(docs), "survey")
    texts = survey.where(f"n_words >= {WINDOW}").groupBy("id").agg(F.min_by(F.struct("key", "marks"), "key").alias("r"), F.count(F.lit(1)).alias("n"))
    texts = written(texts.select("id", F.monotonically_increasing_id().alias("tk"), "r.key", "r.marks", "n"), "texts")
    marks = texts.select("tk", "key", F.explode("marks").alias("mark"))
    again = written(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    shared = join_split(marks, again, ["mark"]).groupBy("tk").agg(F.collect_list("mark").alias("again"))  # bounded by the text
    wanted = shared.join(texts.select("tk", "id", "key"), "tk").select("tk", F.col("id").alias("rid"), F.col("key").alias("rkey"), "again")
    once = docs.select("id", "key", "text").dropDuplicates(["id", "key"])  # before the shuffle of the join, which it shares
    candidates = once.join(wanted, (once.id == wanted.rid) & (once.key == wanted.rkey)).select("key", "tk", "again", "text")
    with small_batches(df.sparkSession):
        candidates = written(_recurring(candidates), "candidates")
    forget(df.sparkSession, again)

    windows = candidates.select("key", "tk", F.explode(F.arrays_zip("hashes", "starts")).alias("w")).select("key", "tk", F.col("w.hashes").alias("h"), F.col("w.starts").alias("start"))
    owners = written(windows.groupBy("h").agg(F.min("key").alias("owner"), F.max("key").alias("other"), F.count(F.lit(1)).alias("n")).where("owner < other").select("h", "owner", "n"), "owners")
    joined = join_split(windows, owners, ["h"])
    part = F.xxhash64("owner")
    uses = written(
        joined.groupBy("tk", "key", "owner").agg(F.collect_list(F.when(F.col("key") == F.col("owner"), F.col("start"))).alias("starts")),
        "uses",
    )
    size = uses.where("key = owner").agg(F.sum(F.size("starts")).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(size) * 8 // SHARD_BYTES))
    shard = F.pmod(part, F.lit(shards)).alias("shard")
    owned = uses.where("key = owner").select("tk", shard, "starts").join(candidates.select("tk", "key", "text"), "tk")
    passages = written(_passages(owned), "passages")
    routes = uses.where("key > owner").select("tk", shard).distinct()
    routed = candidates.select("tk", "key", F.octet_length("text").alias("bytes")).join(routes, "tk")
    copies = written(routed.groupBy("shard").agg(F.ceil(F.sum("bytes") / STREAM_BYTES).cast("int").alias("copies")), "copies")
    left = passages.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(False).alias("is_text"), "key", F.lit(0).cast("long").alias("tk"), F.col("passage").alias("text"))
    right = candidates.select("tk", "key", "text").join(routes.join(copies, "shard"), "tk")
    right = right.select("shard", F.pmod(F.shiftright("tk", 7), F.col("copies")).cast("int").alias("copy"), F.lit(True).alias("is_text"), "key", "tk", "text")
    dealt = left.unionByName(right).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "is_text")
    cuts = _stream(dealt).groupBy("key", "tk").agg(F.flatten(F.collect_list("froms")).alias("froms"), F.flatten(F.collect_list("tos")).alias("tos"))
    with small_batches(df.sparkSession):
        cuts = written(cuts, "cuts")
    forget(df.sparkSession, uses, passages, copies, owners)
    return survey, texts.select("id", "tk", F.col("key").alias("least"), "n"), cuts.join(candidates.select("tk", "text"), "tk")


def _digests(cuts: DataFrame) -> DataFrame:
    schema = T._parse_datatype_string("tk long, cut long, cut_sha string")

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for tk, froms, tos, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                keep = keep_mask(len(words), froms, tos)
                for column, value in zip(out, (tk, int((~keep).sum()), _sha([words[i] for i in np.flatnonzero(keep)])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=schema.names)

    return cuts.select("tk", "froms", "tos", "text").mapInArrow(alone(run), schema)


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept_sha256."""
    survey, texts, cuts = _find(df, key, text)
    found = written(texts.join(_digests(cuts), "tk", "left"), "found")
    copy = F.col("key") > F.col("least")
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0).cast("long")))
    sha = F.when(copy, F.lit(_sha([]))).otherwise(F.coalesce("cut_sha", "sha"))
    rows = survey.drop("marks")
    out = join_split(rows.where(f"n_words >= {WINDOW}"), found, ["id"]).select("own", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256"))
    short = rows.where(f"n_words < {WINDOW}").select("own", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return out.unionByName(short).withColumnRenamed("own", key)


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the repeats cut from the text: what is left is joined by single spaces; untouched texts stay as they are."""
    _, texts, cuts = _find(df, key, text)
    # cuts belong to the rows of the smallest key; all others of the text lose everything
    found = written(texts.join(cuts.select("tk", "froms", "tos"), "tk", "left").select("id", "least", "n", "froms", "tos"), "found")
    columns = df.columns
    names = [f"__{i}" for i in range(len(columns))]
    at = columns.index(text)
    source = df.toDF(*names)
    body = F.coalesce(F.col(names[at]), F.lit("")).cast("binary")
    own = F.coalesce(F.col(names[columns.index(key)]).cast("long"), F.lit(_LAST))
    marked = join_split(source.withColumn("id", F.unhex(F.sha2(body, 256))).withColumn("key", own), found, ["id"], how="left")
    staged = marked.select(*names, F.coalesce(F.col("key") > F.col("least"), F.lit(False)), "froms", "tos")

    def run(batches):
        for batch in parts(batches):
            arrays = list(batch.columns[: len(names)])
            out = arrays[at].to_pylist()
            for i, (all_, froms, tos) in enumerate(zip(*(c.to_pylist() for c in batch.columns[len(names) :]), strict=True)):
                if all_:
                    out[i] = ""
                elif froms:
                    words = out[i].encode().split()
                    out[i] = b" ".join(words[j] for j in np.flatnonzero(keep_mask(len(words), froms, tos))).decode()
            arrays[at] = pa.array(out, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return staged.mapInArrow(alone(run), df.schema)


#: DuckDB SQL for the rows of the query.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(t) - 48)) AS p, t FROM w WHERE len(t) >= 50),
h AS (SELECT doc_id, p, array_to_string(t[p:p + 49], ' ') AS g FROM win),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM h) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS l FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM dup) GROUP BY doc_id)
SELECT w.doc_id, len(t)::BIGINT AS n_words, coalesce(len(l), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN l IS NULL THEN t ELSE list_filter(t, lambda x, i: NOT list_contains(l, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


def op7(spark, sf_dir: str) -> DataFrame:
    """Repeats across all documents."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
