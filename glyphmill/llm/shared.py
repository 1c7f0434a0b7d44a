"""Files that the driver and every executor can see, and lineage cuts that outlive a lost executor."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where it is unset, one of this process's own, which only a
    session that runs in this process may use (tests): on a cluster its executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    return _own[app]


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A folder name under the shared root that no other run uses."""
    return f"{shared_root(spark)}/glyphmill/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: later stages no longer depend on executors."""
    spark = df.sparkSession
    to = fresh_folder(spark, label)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows for the jobs run inside, where rows are long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder under the shared root."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the files of tables that `written` made and nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/glyphmill/" in folder:
                remove(spark, folder)


#: At most so many keys count as hot (so their list may be broadcast whatever the data), and each is dealt so many ways.
HOT_KEYS, HOT_WAYS, HOT_ROWS = 4096, 64, 1000


def over_ways(hot: Column) -> Column:
    """The ways that a key's row is repeated for."""
    return F.when(hot, F.sequence(F.lit(0), F.lit(HOT_WAYS - 1))).otherwise(F.array(F.lit(0)))


def join_split(rows: DataFrame, by_key: DataFrame, on: list[str], count: str = "n", how: str = "inner", way: str | None = None) -> DataFrame:
    """rows joined with by_key, which has one row a key and in `count` how many of `rows` have it.

    Keys of more than 1/HOT_KEYS of the rows are hot: their rows are dealt over HOT_WAYS tasks, and their row of by_key is
    repeated for each. by_key is read three times, so it should be a written table. way: keep each row's way, and whether
    its key is hot, in the columns `way` and `hot`."""
    total = by_key.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, -(-int(total) // HOT_KEYS))
    hot = by_key.where(F.col(count) >= least).select(*on, F.lit(True).alias("__hot"))
    dealt = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith(("array", "map"))]), F.lit(HOT_WAYS)).cast("int")
    left = rows.join(F.broadcast(hot), on, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    left = left.withColumn("__way", F.when(F.col("__hot"), dealt).otherwise(F.lit(0)))
    out = left.join(by_key.withColumn("__way", F.explode(over_ways(F.col(count) >= least))), [*on, "__way"], how)
    if way:
        return out.withColumnsRenamed({"__way": way, "__hot": "hot"})
    return out.drop("__way", "__hot")


def partitions(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """How many parts to deal df into: the session's number, or more where Catalyst's estimate of its size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a plan of unknown size counts as unlimited; the session's number is all there is to go by then
    wanted = -(-size // bytes_each) if size < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def dealt_files(listing: DataFrame) -> DataFrame:
    """A listing of files, a few of them to a task. Its rows are small, so they are dealt by number and not by size."""
    parts = max(int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-listing.count() // 4))
    return listing.repartition(parts, "file")


def whole_number_key(df: DataFrame, key: str) -> None:
    """Refuse keys that are not whole numbers: the order of keys decides, and they are carried as 64-bit integers."""
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"column {key} holds {kind}; the operator takes whole numbers as keys")
