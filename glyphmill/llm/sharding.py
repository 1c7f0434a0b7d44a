"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, DataFrame functions only.

Each row's key is a point on a ring of 2**62 positions; each shard owns `vnodes` arcs. A shard keeps its own keys,
in ring order, up to its capacity; a key that finds its shard full continues clockwise to the next virtual node
whose shard has room. Capacities are floor(N / shards) or one more, so counts are at most one apart.

Rows are ranked within ring cells whose number follows the row count, counts of cells are summed along each arc, and
only the counts of the arcs (shards x vnodes, a fixed number) reach the driver, which plans the overflow. Repeated
rows (same key, same text) count as one weighted row until the end, so a hot key is never sorted or held as rows.

Defined results: null key: a key of its own; keys of any type that hashes; null or empty text: size 1, checksum 0; very
long texts: only their size and checksum are carried; ties and repeated rows: each gets its own slot; empty table: no
rows; other columns of the input, of any name, are not carried (the key, size and checksum identify the row).
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 62
_CELL_ROWS = 4096
_CHUNK = 4096


def ring(n_shards: int, vnodes: int, cell_bits: int = 14) -> list[tuple[int, int]]:
    """(cell where the arc ends, shard) of each virtual node, clockwise; ends are distinct cells of 2**cell_bits."""
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            cell = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") >> (64 - cell_bits)
            while cell in taken:
                cell = (cell + 1) % (1 << cell_bits)
            taken[cell] = shard
    return sorted(taken.items())


def overflow_plan(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): which ranks of each arc go where.

    counts and owners by arc, clockwise. Own keys come first; the rest walks on clockwise, first come first served.
    """
    room, used, at = list(capacity), [0] * len(capacity), [0] * len(counts)
    plan = []

    def give(arc: int, shard: int, most: int) -> int:
        n = min(most, room[shard])
        if n:
            plan.append((arc, at[arc], at[arc] + n, shard, used[shard]))
            at[arc] += n
            used[shard] += n
            room[shard] -= n
        return n

    left = [count - give(arc, owners[arc], count) for arc, count in enumerate(counts)]
    walking: deque[list[int]] = deque()
    for step in range(3 * len(counts)):
        arc = step % len(counts)
        while walking and room[owners[arc]]:
            walking[0][1] -= give(walking[0][0], owners[arc], walking[0][1])
            if not walking[0][1]:
                walking.popleft()
        if step < len(counts) and left[arc]:
            walking.append([arc, left[arc]])
    return plan


def _values(df: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    rows = rows or [(-1,) * len(names.split(", "))]
    return df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(f'({", ".join(f"{x}L" for x in r)})' for r in rows)} AS t({names})")


def shard(df: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", vnodes: int = 64) -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot."""
    body: Column = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("_pos", F.shiftrightunsigned(F.xxhash64(F.lit(17), "_key", "text_crc32", "size"), 64 - RING_BITS))
    ends = ring(n_shards, vnodes)
    total = df.count()
    cell_bits = max(14, (total // _CELL_ROWS).bit_length())
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    cells = [(cell, arc) for cell, arc in _cells_of_arcs(ends)]
    arcs = _values(df, cells, "_coarse, _arc")
    rows = rows.groupBy("_pos", "_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_cell", F.shiftright("_pos", RING_BITS - cell_bits)).withColumn("_coarse", F.shiftright("_pos", RING_BITS - 14))
    per_cell = rows.groupBy("_coarse", "_cell").agg(F.sum("_n").alias("_in_cell")).join(F.broadcast(arcs), "_coarse")
    per_arc = {r["_arc"]: r["n"] for r in per_cell.groupBy("_arc").agg(F.sum("_in_cell").alias("n")).collect()}
    plan = overflow_plan([per_arc.get(a, 0) for a in range(len(ends))], [s for _, s in ends], capacity)
    # cells of the arc that passes position 0 come in ring order too: those above the last virtual node first
    around = F.when((F.col("_arc") == 0) & (F.col("_coarse") > F.lit(ends[0][0])), 0).otherwise(1)
    along = Window.partitionBy("_arc").orderBy(around, "_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = per_cell.select("_cell", "_arc", F.coalesce(F.sum("_in_cell").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cell").orderBy("_pos", "_key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(before, "_cell")
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in"))
    chunks = ranked.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _CHUNK))))
    few, many = chunks.where(F.col("_n") <= _CHUNK), chunks.where(F.col("_n") > _CHUNK).repartition(F.col("_pos"), F.col("_chunk"))
    last = F.least(F.lit(_CHUNK).cast("long"), F.col("_n") - F.col("_chunk") * _CHUNK) - 1
    single = few.unionByName(many).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    single = single.withColumn("_rank", F.col("_rank") + F.col("_chunk") * _CHUNK + F.col("_i"))
    segments = _values(df, plan, "_to_arc, _lo, _hi, _shard, _base")
    placed = single.join(F.broadcast(segments), (F.col("_arc") == F.col("_to_arc")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", F.col("_shard").cast("int").alias("shard"), (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("slot"))


def _cells_of_arcs(ends: list[tuple[int, int]], cell_bits: int = 14) -> list[tuple[int, int]]:
    """(cell, arc) for each coarse cell; cells behind the last virtual node belong to arc 0."""
    out, arc = [], 0
    for cell in range(1 << cell_bits):
        if arc < len(ends) and cell > ends[arc][0]:
            arc += 1
        out.append((cell, arc % len(ends)))
    return out


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(docs.select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
