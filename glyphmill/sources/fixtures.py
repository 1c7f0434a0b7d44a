"""Synthetic tables for demonstrations and tests, made from expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that random text is made of (fixed values).
WORDS = ("amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heron", "inlet", "jasper", "kelp", "larch", "maple", "north", "ochre", "pine", "quartz", "reed", "slate", "thorn")
KINDS = ("items", "orders", "parts", "deliveries", "customers")


def random_words(n: Column | int, seed: Column | int = 0) -> Column:
    """n words, the same for the same seed."""
    n, seed = (F.lit(x) if isinstance(x, int) else x for x in (n, seed))
    names = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda i: F.element_at(names, (F.pmod(F.xxhash64(seed, i), F.lit(len(WORDS))) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), pick), " ")


def test_table(spark, kind: str = "items", rows: int = 100) -> DataFrame:
    """A table of one of the kinds items, orders, parts, deliveries, customers."""
    base = spark.range(1, rows + 1)
    tables = {
        "items": lambda: base.select("id", random_words(6, F.col("id")).alias("description"), (F.col("id") % 5 + 1).cast("int").alias("rating"), (F.col("id") % 3 == 0).alias("in_stock"), F.struct(F.lit("red").alias("color")).alias("metadata")),
        "orders": lambda: base.select(F.col("id").alias("order_id"), (F.col("id") % 20 + 1).alias("item_id"), (F.col("id") % 4 + 1).cast("int").alias("quantity"), random_words(2, F.col("id") + 1000).alias("customer_name")),
        "parts": lambda: base.select(F.col("id").alias("part_id"), F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("parent_part_id"), random_words(3, F.col("id") + 2000).alias("description")),
        "deliveries": lambda: base.select(F.col("id").alias("delivery_id"), F.expr("make_interval(0, 0, 0, cast(id % 30 as int))").alias("after"), F.struct(F.col("id").cast("double").alias("lower"), (F.col("id") + 10).cast("double").alias("upper"), F.lit(True).alias("lower_inc"), F.lit(False).alias("upper_inc")).alias("weights")),
        "customers": lambda: base.select("id", random_words(2, F.col("id") + 3000).alias("name"), F.to_json(F.struct((F.col("id") % 90).alias("age"))).alias("crm_data")),
    }
    return tables[kind]()
