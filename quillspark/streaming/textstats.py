"""Statistics of transcripts as they arrive.

An addition: running counts by language and hour of a stream of transcripts, with a watermark, in the terms of the batch
statistics. Counts are sums, so the stream's result over a closed table equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import has_digits, is_blank, words


def running(texts: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(window, lang, n_utts, n_chars, n_words, n_blank, n_with_digits)."""
    kept = texts.withWatermark(time, late)
    return kept.groupBy(F.window(time, width).alias("window"), "lang").agg(
        F.count("*").alias("n_utts"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.sum(F.size(words(F.col("text")))), F.lit(0)).cast("long").alias("n_words"),
        F.count_if(is_blank(F.col("text"))).alias("n_blank"),
        F.count_if(has_digits(F.coalesce("text", F.lit("")))).alias("n_with_digits"),
    )


def from_folder(spark: SparkSession, path: str, schema: str = "ts timestamp, lang string, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def to_folder(stats: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stats.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
