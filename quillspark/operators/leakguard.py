"""Training rows without anything of the evaluation rows: neither a recording nor a speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IN_EVAL, EVAL_SPEAKER, KEPT = "in_eval_splits", "eval_speaker_clips", "kept"


def dispositions(validated: DataFrame, evaluation: DataFrame, path: str = "path", speaker: str = "client_id") -> DataFrame:
    """validated with ``disposition``. The recording is tested first, then the speaker.

    Keys of the evaluation side are distinct before the join, so that repeated ones don't multiply rows.
    """
    paths = evaluation.select(F.coalesce(F.col(path).cast("string"), F.lit("")).alias("__path")).distinct().withColumn("__by_path", F.lit(True))
    speakers = evaluation.select(F.coalesce(F.col(speaker).cast("string"), F.lit("")).alias("__speaker")).distinct().withColumn("__by_speaker", F.lit(True))
    left = validated.withColumn("__p", F.coalesce(F.col(path).cast("string"), F.lit(""))).withColumn("__s", F.coalesce(F.col(speaker).cast("string"), F.lit("")))
    both = left.join(paths, F.col("__p") == F.col("__path"), "left").join(speakers, F.col("__s") == F.col("__speaker"), "left")
    what = F.when(F.col("__by_path"), IN_EVAL).when(F.col("__by_speaker"), EVAL_SPEAKER).otherwise(KEPT)
    return both.withColumn("disposition", what).drop("__p", "__s", "__path", "__speaker", "__by_path", "__by_speaker")


def require_speakers(*tables: DataFrame, speaker: str = "client_id") -> None:
    """The guard needs a speaker on every row; refuses otherwise."""
    for t in tables:
        missing = t.where(F.coalesce(F.trim(F.col(speaker).cast("string")), F.lit("")) == "").count()
        if missing:
            raise ValueError(f"{missing} rows have no {speaker}: the speaker guard can't be applied")


def accounting(marked: DataFrame, by: list[str] | None = None, speaker: str = "client_id", seconds: str | None = None) -> DataFrame:
    """Rows kept and removed by reason, distinct leaked speakers, and seconds, in one aggregate."""
    leaked = F.col("disposition") == EVAL_SPEAKER
    columns = [
        F.count("*").alias("n_validated"),
        F.count_if(F.col("disposition") == KEPT).alias("n_kept"),
        F.count_if(F.col("disposition") == IN_EVAL).alias("n_in_eval_splits"),
        F.count_if(leaked).alias("n_eval_speaker_clips"),
        F.count_distinct(F.when(leaked, F.col(speaker))).alias("n_leaked_speakers"),
    ]
    if seconds:
        columns += [F.sum(F.when(F.col("disposition") == KEPT, F.col(seconds)).otherwise(0.0)).alias("seconds_kept"), F.sum(F.when(leaked, F.col(seconds)).otherwise(0.0)).alias("seconds_removed_by_guard")]
    return marked.groupBy(*(by or [])).agg(*columns)


def not_covered(official: DataFrame, kept: DataFrame, key: str = "path") -> DataFrame:
    """Official training rows that the guarded selection lacks: must be none."""
    return official.join(kept.select(key).distinct(), key, "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides: must be none where two splits may not share a speaker."""
    return a.select(key).distinct().intersect(b.select(key).distinct())


def require_empty(df: DataFrame, what: str) -> None:
    found = df.take(5)
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")
