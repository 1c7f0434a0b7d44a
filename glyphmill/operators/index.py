"""An inverted index as DataFrames: postings with positions, field lengths, the term dictionary, corpus statistics.

Texts are tokenized once: postings are grouped from the tokens, lengths from the postings, and the dictionary from the
postings too. A stored index (`save`, `load`) keeps all of them, and the statistics, so that a query reads the buckets
of its terms and tokenizes nothing. Buckets are as many as the size asks for; the postings of a term that very many
rows hold are dealt over several files of its bucket.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.tokenizers import Tokenizer, exploded

K1, B = 1.2, 0.75
#: Postings of a bucket; of a term from which on it is dealt over files; how many terms at most may be dealt so.
BUCKET_POSTINGS, HOT_POSTINGS, HOT_TERMS, HOT_FILES = 4_000_000, 1_000_000, 50_000, 32


@dataclass
class Index:
    """rows: the indexed rows (key and all fields, the columnar side); postings: key, field, term, tf, positions;
    lengths: key, field, len; fields: text fields and their tokenizers; dictionary: field, term, df, where it is stored."""

    rows: DataFrame
    key: str
    fields: dict[str, Tokenizer]
    postings: DataFrame
    lengths: DataFrame
    buckets: int | None = None
    dictionary: DataFrame | None = None
    _stats: dict[str, tuple[int, float]] = field(default_factory=dict)

    def stats(self, name: str) -> tuple[int, float]:
        """(documents, mean length) of a field: two numbers, taken once."""
        if name not in self._stats:
            r = self.lengths.where(F.col("field") == name).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("a")).first()
            self._stats[name] = (r["n"], float(r["a"] or 0.0))
        return self._stats[name]

    def of_field(self, name: str, terms: list[str] | None = None) -> DataFrame:
        """The postings of a field, or of some of its terms; of a stored index, only the buckets of these terms."""
        out = self.postings.where(F.col("field") == name)
        if terms is not None:
            out = out.where(F.col("term").isin(terms))
            if self.buckets:
                out = out.where(F.col("bucket").isin([F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int") for t in terms]))
        return out

    def terms(self, name: str) -> DataFrame:
        """The term dictionary of a field: term, df."""
        if self.dictionary is not None:
            return self.dictionary.where(F.col("field") == name).select("term", "df")
        return self.postings.where(F.col("field") == name).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def schema(self) -> DataFrame:
        """One row per field: its type and options."""
        session, out = self.rows.sparkSession, []
        for f in self.rows.schema:
            options = self.fields.get(f.name)
            out.append((f.name, f.dataType.simpleString(), f.name == self.key, options is not None, options.kind if options else None))
        return session.createDataFrame(out, "name string, type string, is_key boolean, tokenized boolean, tokenizer string")

    def info(self) -> DataFrame:
        """Size figures of each field: documents, terms, postings, tokens."""
        per = self.postings.groupBy("field").agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))
        return per.join(self.lengths.groupBy("field").agg(F.count(F.lit(1)).alias("documents")), "field")

    def checksum(self) -> DataFrame:
        """One order-independent checksum of each field's postings."""
        return self.postings.groupBy("field").agg(F.bit_xor(F.xxhash64(self.key, "term", "tf", "positions")).alias("checksum"))

    def files(self) -> DataFrame:
        """One row per file of the postings: field, bucket, its name, terms, postings, tokens, bytes of the terms."""
        named = self.postings.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
        keys = ["field", *(["bucket"] if self.buckets else []), "file"]
        return named.groupBy(*keys).agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"), F.sum(F.octet_length("term")).alias("term_bytes"))

    def save(self, path: str, buckets: int | None = None) -> None:
        """Parquet, by field and hash of the term, sorted by term: a term look-up reads one bucket's row groups."""
        spark = self.rows.sparkSession
        self.rows.write.parquet(f"{path}/rows")
        staged = f"{path}/staged"
        self.postings.write.parquet(staged)
        postings = spark.read.schema(self.postings.schema).parquet(staged)
        postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{path}/terms")
        counts = spark.read.parquet(f"{path}/terms")
        total = counts.agg(F.sum("df")).first()[0] or 0
        buckets = buckets or max(1, -(-total // BUCKET_POSTINGS))
        hot = counts.where(F.col("df") >= max(HOT_POSTINGS, -(-total // HOT_TERMS))).select("field", "term", F.lit(HOT_FILES).alias("_files"))
        placed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).join(F.broadcast(hot), ["field", "term"], "left")
        placed = placed.withColumn("_part", F.when(F.col("_files").isNotNull(), F.pmod(F.xxhash64(self.key), F.lit(HOT_FILES))).otherwise(0))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets * len(self.fields))
        placed = placed.repartition(parts, "field", "bucket", "_part").drop("_files", "_part").sortWithinPartitions("field", "bucket", "term")
        placed.write.partitionBy("field", "bucket").parquet(f"{path}/postings")
        # texts without a token have no postings, but a length
        sums = postings.groupBy(self.key, "field").agg(F.sum("tf").alias("len"))
        keys = self.rows.select(self.key, F.explode(F.array(*map(F.lit, self.fields))).alias("field"))
        lengths = keys.join(sums, [self.key, "field"], "left").select(self.key, "field", F.coalesce("len", F.lit(0)).cast("long").alias("len"))
        lengths.write.partitionBy("field").parquet(f"{path}/lengths")
        stats = spark.read.parquet(f"{path}/lengths").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average"))
        stats.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/meta")
        _remove(spark, staged)


def _remove(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def compact(spark, path: str, to: str, files: int = 1) -> None:
    """The stored postings rewritten with so many files per bucket."""
    postings = spark.read.parquet(f"{path}/postings")
    postings.repartition(files, "field", "bucket").sortWithinPartitions("field", "bucket", "term").write.partitionBy("field", "bucket").parquet(f"{to}/postings")
    for name in ("lengths", "rows", "meta", "terms"):
        df = spark.read.parquet(f"{path}/{name}")
        (df.write.partitionBy("field") if name == "lengths" else df.write).parquet(f"{to}/{name}")


def storage(spark, path: str) -> DataFrame:
    """part, files, bytes of a stored index: postings, lengths, rows, terms, meta. Only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    part = F.regexp_extract("path", "/(postings|lengths|rows|terms|meta)/", 1)
    return files.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def version_info(spark) -> DataFrame:
    from glyphmill import __version__

    return spark.createDataFrame([(__version__, spark.version)], "version string, spark string")


def load(spark, path: str, key: str, fields: dict[str, Tokenizer]) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    meta = read("meta").collect()  # one row a field
    stats = {r["field"]: (r["n"], float(r["average"] or 0.0)) for r in meta}
    stats |= {name: (0, 0.0) for name in fields if name not in stats}
    return Index(read("rows"), key, fields, read("postings"), read("lengths"), max((r["buckets"] for r in meta), default=1), read("terms"), stats)


_stored: dict[tuple, tuple[str, Index]] = {}


def stored(df: DataFrame, key: str, fields: dict[str, Tokenizer], folder: str) -> Index:
    """The index of df under a folder that driver and executors share: built and saved once in an application for the
    same files in the same state, then loaded."""
    spark = df.sparkSession
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    state = []
    for name in sorted(df.inputFiles()):
        at = path_of(name)
        status = at.getFileSystem(conf).getFileStatus(at)
        state.append((name, status.getModificationTime(), status.getLen()))
    known = (spark.sparkContext.applicationId, key, tuple(df.columns), tuple(sorted(fields.items(), key=str)), tuple(state))
    if known in _stored:  # unless someone has removed its files
        done = path_of(f"{_stored[known][0]}/meta/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            del _stored[known]
    if known not in _stored:
        path = f"{folder.rstrip('/')}/index-{uuid.uuid4().hex}"
        build_index(df, key, fields).save(path)
        _stored[known] = path, load(spark, path, key, fields)
    return _stored[known][1]


def build_index(df: DataFrame, key: str, fields: dict[str, Tokenizer]) -> Index:
    """Index the given text fields of df; the other columns stay searchable as they are."""
    tokens = None
    for name, options in fields.items():
        each = exploded(df.select(F.col(key), F.lit(name).alias("field"), F.col(name).alias("_text")), "_text", options, "term")
        tokens = each if tokens is None else tokens.unionByName(each)
    postings = tokens.groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))
    # texts without a token have no postings, but a length
    sums = postings.groupBy(key, "field").agg(F.sum("tf").alias("len"))
    keys = df.select(F.col(key), F.explode(F.array(*map(F.lit, fields))).alias("field"))
    lengths = keys.join(sums, [key, "field"], "left").select(key, "field", F.coalesce("len", F.lit(0)).cast("long").alias("len"))
    return Index(df, key, fields, postings, lengths)
