"""The corpus pipeline: stages over documents, each calling one operator of glyphmill.llm.

Toxic documents go; of each group of near duplicates the document with the smallest id stays; passages that an earlier
document has already are cut from the texts; documents that hold benchmark items go; what is left is encoded.

Each stage is written to the shared folder and read again, so that a lost executor costs a stage at most. Defined results:
null or empty texts: never toxic or contaminated, near duplicates of nothing, kept, and encoded as no ids; null keys:
kept as documents, the largest where keys are compared; repeated rows and copies: one stays; very long texts: whole;
empty tables: no rows (no benchmark: nothing goes; no labels: nothing is toxic); other columns, of any name, pass through
all stages but the last, in which doc_id is the only one carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe_text, decontamination, jaccard_join, substring_dedup, toxicity
from glyphmill.llm.shared import shared_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that are not predicted to be toxic, by a model of the labelled rows among them."""
    model = toxicity.train(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the passages of 50 words and more that documents with smaller ids hold."""
    cut = substring_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item."""
    return decontamination.without_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of each text, their number, and digests of them and of the text they decode to."""
    import public_tokenizers

    out = bpe_text.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), ids_too=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding_and_decoding", encode),
]

#: The stages are not expressible in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        to = f"{shared_root(spark)}/glyphmill/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return STAGES[-1][1](spark, docs, sf_dir)
