"""Near-duplicate components by an n-gram Jaccard join with adaptive multi-match prefixes.

Every document is the set of its distinct word 5-grams (hashed to 64 bits), ordered by hash. Two sets with Jaccard
similarity of t or more share at least l elements among the first |x| - ceil(t |x|) + l elements of each, for any l.

1. Equal sets are one node. Each node emits a prefix with a base l; prefix elements that only one node has are
   dropped, and with them nodes that have fewer than l left. This removes nearly every document without a partner,
   also those that share a common passage with thousands of others.
2. Of a node's k shared prefix elements the k - l + 1 rarest bring nodes together. Each element first ties its nodes to
   one of them (a star). The more others a node meets, its cost, the longer its prefix becomes, and the more elements
   (the smaller l of both) have to be shared before a pair is verified; verified links become components. Only nodes of
   different components that still meet are left. Of those with a low cost, all meetings are gone through.
3. The prefix of a node whose cost stays high grows to its whole set, of which it has to share ceil(t |x|) elements or
   more, depending on the partner's size. Stars and components come first here too, then what is left. So a group of
   thousands of copies costs a few tests per member, and no link between components is lost.
4. Every candidate is tested exactly on the full sets.

Equal sets are known by 64 bits, proved by 64 more: if two sets ever share the first and not the second, all is done anew
with another salt. Elements are 64-bit hashes of shingles. What hangs on one very common element is joined with one row a
key, or one of a few: a join whose hot partitions adaptive execution splits.

Defined results: null or word-less text: no shingles, a component of its own; fewer than five words: the sequence
is the one element; very long texts: whole, as a slice of their own; equal rows and ties: same component; null key: counts
as a document, component ids take the smallest non-null key; keys of any type that orders; empty table: no rows; other
columns, of any name, pass through `without_near_duplicates` and are not carried by `near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm.arrow import alone
from glyphmill.llm.graph import extended, no_roots
from glyphmill.llm.shared import forget, small_batches, written
from glyphmill.llm.words import mix, scans

WIDTH, PERCENT = 5, 80
#: A node is costly if it still meets more than this many others per element, on average.
COSTLY = 8
#: Turns of stars at each level.
TURNS = 2
_BAND = 1.0625
#: Bytes of text whose words are hashed at once; that takes several arrays of 8 bytes for each.
_SLICE_BYTES = 1 << 18


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for scan in scans(column, lower=True, slice_bytes=_SLICE_BYTES):
        hashes = scan.hashes()
        at, grams = scan.windows(hashes, width)
        cuts = np.searchsorted(at, scan.bounds)
        words = np.diff(scan.bounds)
        short = {w: dict(zip(*(x.tolist() for x in scan.windows(hashes, w)), strict=True)) for w in range(1, width) if (words == w).any()}
        for d, n in enumerate(words.tolist()):
            if n >= width:
                yield np.unique(grams[cuts[d] : cuts[d + 1]])
            elif n:
                yield mix(np.array([short[n][int(scan.bounds[d])]], np.uint64) ^ np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def least_overlap(n: int, percent: int) -> int:
    """The fewest elements that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def base_matches(n: int, percent: int) -> int:
    """l of the first prefix: small sets show all their elements."""
    return least_overlap(n, percent) if n <= 64 else max(4, n // 64)


def prefix_length(n: int, matches: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + matches)


def sure_matches(n: int, percent: int) -> int:
    """The fewest prefix elements that a set of n shares with a partner of any size that can link to it."""
    low, high = least_overlap(n, percent), 100 * n // percent
    return min(base_matches(s, percent) for s in {low, n, high, *(s for s in (64, 65) if low <= s <= high)})


def _prepare(docs: DataFrame, percent: int, width: int, salt: int) -> DataFrame:
    """key, tk -> n, sig, proof, need (matches that a partner surely has), prefix of the base level."""
    schema = T.StructType([*docs.select("key", "tk").schema.fields, *T._parse_datatype_string("n long, sig long, proof long, need int, prefix array<long>").fields])

    def run(batches):
        for batch in batches:
            n, sig, proof, need, prefix, lengths = [], [], [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                k = len(s)
                n.append(k)
                sig.append(_signature(s, salt))
                proof.append(_signature(s, -1))
                need.append(sure_matches(k, percent) if k else 0)
                q = prefix_length(k, base_matches(k, percent), percent) if k else 0
                prefix.append(s[:q].view(np.int64))
                lengths.append(q)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(proof, pa.int64()), pa.array(need, pa.int32()), lists], names=schema.names)

    return docs.mapInArrow(alone(run), schema)


def _signature(s: np.ndarray, salt: int) -> int:
    """64 bits of a set; other salts give independent ones."""
    start = mix(np.array([salt], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(mix(s ^ start).sum(dtype=np.uint64) + start + np.uint64(len(s)))[0].view(np.int64))


def _full(docs: DataFrame, percent: int, width: int, salt: int) -> DataFrame:
    """text -> sig, n, need (of the whole set), elements."""
    schema = T._parse_datatype_string("sig long, n long, need int, elements array<long>")

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), width))
            sizes = [len(s) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([_signature(s, salt) for s in sets], pa.int64()), pa.array(sizes, pa.int64()), pa.array([least_overlap(n, percent) for n in sizes], pa.int32()), lists], names=schema.names)

    return docs.mapInArrow(alone(run), schema)


def _shared(tokens: DataFrame, needs: DataFrame) -> DataFrame:
    """tokens (token, node) that at least two nodes have, with their number of nodes `df`, the node's number of them `k`
    and its `need`; without nodes that have fewer than they need."""
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = written(tokens.join(often, "token"), "kept")
    enough = kept.groupBy("node").agg(F.count(F.lit(1)).alias("k")).join(needs, "node").where("k >= need")
    out = written(kept.join(enough, "node"), "shared")
    forget(tokens.sparkSession, kept)
    return out


def _ranked(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """shared with n and the rank r of each element in its node, rarest first; a node's elements are bounded by its text."""
    order = Window.partitionBy("node").orderBy("df", "token")
    sized = shared.join(sets.select(F.col("sig").alias("node"), "n"), "node")
    return sized.withColumn("r", F.row_number().over(order)).withColumn("room", F.col("k") - F.col("r") + 1)


def _first_level(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, i, j, node, band, n, room): the k - need + 1 rarest elements of each node; no bands at this level."""
    zero = F.lit(0)
    return _ranked(shared, sets).where("r <= k - need + 1").select("token", zero.alias("i"), zero.alias("j"), "node", zero.alias("band"), "n", "room")


def _band(n: Column) -> Column:
    """Sizes within about 6 % of each other have the same number."""
    return F.floor(F.log(n.cast("double")) / math.log(_BAND)).cast("int")


def _whole_level(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, i, j, node, band, n, room): the rarest elements of a node for partners of each band of sizes it can
    link to, with the number of its elements from this one on.

    A partner of size m shares at least percent / (100 + percent) * (n + m) elements, all of them in the room that
    both have left at the first they share. Nodes of the bands i and j meet under (token, i, j), whichever is larger.
    """
    sized = _ranked(shared.drop("need"), sets).withColumn("band", _band(F.col("n")))
    partners = F.sequence(_band(F.ceil(F.col("n") * percent / 100)), _band(F.floor(F.col("n") * 100 / percent)))
    smallest = F.greatest(F.floor(F.pow(F.lit(_BAND), F.col("other").cast("double"))) - 1, F.lit(0))
    need = F.ceil((F.col("n") + smallest) * percent / (100 + percent) - 1e-6)
    rows = sized.where(F.col("r") <= F.col("k") - F.ceil(F.col("n") * percent / 100) + 1).withColumn("other", F.explode(partners))
    return rows.where(F.col("r") <= F.col("k") - need + 1).select("token", F.least("band", "other").alias("i"), F.greatest("band", "other").alias("j"), "node", "band", "n", "room")


def _open(dense: DataFrame, roots: DataFrame) -> DataFrame:
    """dense where nodes that meet are still in different components, with the root and the meetings of each row."""
    placed = dense.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    key = ["token", "i", "j"]
    sizes = placed.groupBy(*key, "root").agg(F.count_if(F.col("band") == F.col("i")).alias("a"), F.count_if(F.col("band") == F.col("j")).alias("b"))
    groups = sizes.groupBy(*key).agg(F.count(F.lit(1)).alias("roots"), F.sum("a").alias("all_a"), F.sum("b").alias("all_b"), F.sum(F.col("a") * F.col("b")).alias("same"))
    groups = groups.where("all_a * all_b > same").drop("roots", "same")
    # a row meets the other band's nodes; those of its own root are not known here, so this counts a little too many
    meets = F.when(F.col("band") == F.col("i"), F.col("all_b")).otherwise(F.col("all_a"))
    return written(placed.join(groups, key).withColumn("meets", meets).drop("all_a", "all_b"), "open")


def _meeting(open_: DataFrame, percent: int, turn: int | None = None, whole: bool = True, only: str = "true") -> DataFrame:
    """Pairs of different components that meet: all of them, or those with one centre of each group, by turn."""
    key = ["token", "i", "j"]
    other = open_.select(*key, *(F.col(c).alias(c + "2") for c in ("node", "root", "band", "n", "room")))
    if turn is not None:
        # the node with most shared elements is close to most others
        side = "i" if turn % 2 == 0 else "j"
        centre = F.min_by(F.struct("node2", "root2", "band2", "n2", "room2"), F.struct(-F.col("room2"), F.xxhash64("node2", F.lit(turn))))
        other = other.where(f"band2 = {side}").groupBy(*key).agg(centre.alias("c")).select(*key, "c.*")
    fits = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    if whole:
        fits += f" and {100 + percent} * least(room, room2) >= {percent} * (n + n2)"
    return open_.where(only).join(other, key).where(f"root <> root2 and (i = j or band <> band2) and {fits}").select(*_pair("node", "node2")).distinct()


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _prefixes(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, matches, tokens: the prefix of each node that meets others, lengthened by its cost, the number of others it
    meets by an element on average: each doubling adds a twentieth of the set to l, and so to the prefix."""
    cost = open_.groupBy(F.col("node").alias("sig")).agg((F.sum("meets") / F.count(F.lit(1))).alias("cost"))
    least = F.ceil(F.col("n") * percent / 100)
    base = F.when(F.col("n") <= 64, least).otherwise(F.greatest(F.lit(4), F.floor(F.col("n") / 64)))
    longer = F.ceil(F.col("n") / 20 * F.log2(1 + F.col("cost")))
    matches = F.least(least, F.greatest(base, longer)).cast("int")
    rows = sets.join(cost, "sig").withColumn("matches", matches)
    return written(rows.select(F.col("sig").alias("node"), "matches", F.slice("elements", F.lit(1), (F.col("n") - least).cast("int") + F.col("matches")).alias("tokens")), "prefixes")


def _matching(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many elements as the smaller l of both: the first l common elements of two
    sets that link lie in the prefixes of both, whatever longer prefixes hold."""
    side = lambda s: prefixes.select(F.col("node").alias(s), F.col("matches").alias(f"l{s}"), F.col("tokens").alias(f"t{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.size(F.array_intersect("ta", "tb")) >= F.least("la", "lb")).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""
    sizes = sets.select("sig", "n")
    pairs = pairs.join(sizes.select(F.col("sig").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("sig").alias("b"), F.col("n").alias("nb")), "b")
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    left = pairs.join(sets.select(F.col("sig").alias("a"), F.col("elements").alias("ea")), "a")
    both = left.join(sets.select(F.col("sig").alias("b"), F.col("elements").alias("eb")), "b")
    common = F.size(F.array_intersect("ea", "eb")).cast("long")
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


class _Tested:
    """Pairs that were verified: each is verified once."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent, self.pairs = sets, percent, []

    def links(self, pairs: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
        """Those of the pairs that link, and were not verified before."""
        for before in self.pairs:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        if prefixes is not None:
            pairs = _matching(pairs, prefixes)
        self.pairs.append(written(pairs, "pairs"))
        return _links(self.pairs[-1], self.sets, self.percent)

    def forget(self) -> None:
        forget(self.sets.sparkSession, *self.pairs)


def _tie(level: DataFrame, roots: DataFrame, tested: _Tested, prefixes: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """roots after turns of stars; with prefixes, at the first level. first: what is open before the first turn."""
    for turn in range(TURNS):
        open_ = first if turn == 0 and first is not None else _open(level, roots)
        if open_.isEmpty():
            break
        roots = extended(roots, tested.links(_meeting(open_, tested.percent, turn, prefixes is None), prefixes))
        forget(level.sparkSession, open_)
    return roots


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the smallest key that links reach)."""
    return _components(df, key, text, percent, width).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """df with one row of each component, that of the smallest key (of equal keys, of the smallest text checksum)."""
    found = _components(df, key, text, percent, width)
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "tk")).alias("r"))
    kept = first.select(F.xxhash64("r.key").alias("__kh"), F.col("r.tk").alias("__tk"))
    marked = df.withColumn("__tk", F.xxhash64(text)).withColumn("__kh", F.xxhash64(key))
    blank = F.coalesce(~F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))
    one = marked.where(~blank).dropDuplicates(["__tk", "__kh"]).join(kept, ["__tk", "__kh"], "left_semi")
    return one.unionByName(marked.where(blank)).select(*df.columns)


def _components(df: DataFrame, key: str, text: str, percent: int, width: int) -> DataFrame:
    """key, tk (checksum of the text), n, root (null without shingles), component_id of each row."""
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("tk"), F.xxhash64(key).alias("kh"), F.col(text).alias("text"))
    salt = 0
    while True:
        with small_batches(spark):
            prepared = written(_prepare(docs.select("key", "tk", "text"), percent, width, salt), "shingles")
        if prepared.groupBy("sig").agg((F.min("proof") != F.max("proof")).alias("clash")).where("clash").isEmpty():
            break
        salt += 1
        forget(spark, prepared)
    nodes = prepared.where("n > 0").groupBy("sig").agg(F.min_by(F.struct("prefix"), F.struct("key", "tk")).alias("r"))
    tokens = nodes.select(F.explode("r.prefix").alias("token"), F.col("sig").alias("node"))
    needs = prepared.where("n > 0").groupBy(F.col("sig").alias("node")).agg(F.min("need").alias("need"))
    first = _shared(tokens, needs)
    wanted = prepared.where("n > 0").groupBy("sig").agg(F.min(F.struct("key", "tk")).alias("r")).join(first.select(F.col("node").alias("sig")).distinct(), "sig")
    wanted = wanted.select(F.xxhash64("r.key").alias("kh"), "r.tk")
    texts = docs.select("tk", "kh", "text").dropDuplicates(["tk", "kh"]).join(wanted, ["tk", "kh"]).select("text")
    with small_batches(spark):
        sets = written(_full(texts, percent, width, salt), "sets")

    # a second count drops elements whose other nodes have gone
    again = _shared(first.select("token", "node"), needs)
    forget(spark, first)
    level = written(_first_level(again, sets), "level")
    tested, open_ = _Tested(sets, percent), _open(level, no_roots(spark))
    prefixes = _prefixes(open_, sets, percent)
    roots = _tie(level, no_roots(spark), tested, prefixes, open_)
    open_ = _open(level, roots)
    if not open_.isEmpty():
        costly = open_.groupBy("node").agg((F.sum("meets") > COSTLY * F.count(F.lit(1))).alias("costly"))
        marked = written(open_.join(costly, "node"), "open")
        forget(spark, open_)
        roots = extended(roots, tested.links(_meeting(marked, percent, whole=False, only="not costly"), prefixes))
        grown = sets.join(marked.where("costly").select(F.col("node").alias("sig")).distinct(), "sig")
        whole = grown.select(F.explode("elements").alias("token"), F.col("sig").alias("node"))
        shared = _shared(whole, sets.select(F.col("sig").alias("node"), "need"))
        forget(spark, level, marked)
        level = written(_whole_level(shared, sets, percent), "level")
        roots = _tie(level, roots, tested)
        roots = extended(roots, tested.links(_meeting(_open(level, roots), percent)))
    out = prepared.select("key", "tk", "n", "sig").join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left")
    out = out.withColumn("root", F.coalesce("root", "sig"))
    smallest = out.where("n > 0").groupBy("root").agg(F.min("key").alias("component_id"))
    placed = out.where("n > 0").join(smallest, "root").select("key", "tk", "n", "root", "component_id")
    alone = out.where("n = 0").select("key", "tk", "n", F.lit(None).cast("long").alias("root"), F.col("key").alias("component_id"))
    tested.forget()
    forget(spark, again, level, prefixes)
    return placed.unionByName(alone)


#: DuckDB SQL for the rows of the query.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS g FROM s), n AS (SELECT doc_id, len(g) AS n FROM s),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.c AS component_id FROM n JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = n.doc_id
"""


def op5(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
