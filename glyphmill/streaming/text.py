"""The same column functions over streams: tokens as they come, windowed term counts, and an index kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.tokenizers import Tokenizer, tokenize
from glyphmill.operators.index import build_index


def token_stream(stream: DataFrame, text: str, options: Tokenizer = Tokenizer()) -> DataFrame:
    """One row per token; stateless, so any output mode works."""
    return stream.select("*", F.explode(tokenize(F.col(text), options)).alias("token")).drop(text)


def windowed_term_counts(stream: DataFrame, time: str, text: str, window: str = "10 minutes", late: str = "10 minutes", options: Tokenizer = Tokenizer()) -> DataFrame:
    """Counts of each token by event-time window; rows later than the watermark are dropped with their windows' state."""
    tokens = token_stream(stream.withWatermark(time, late), text, options)
    return tokens.groupBy(F.window(time, window).alias("window"), "token").agg(F.count(F.lit(1)).alias("n"))


def index_stream(stream: DataFrame, key: str, fields: dict[str, Tokenizer], path: str, checkpoint: str):
    """Append each micro-batch's postings and lengths as Parquet, by batch: a batch that is retried writes its own
    folder again, so that nothing is counted twice."""

    def write(batch: DataFrame, number: int) -> None:
        index = build_index(batch, key, fields)
        for name, df in (("postings", index.postings), ("lengths", index.lengths), ("rows", index.rows)):
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
