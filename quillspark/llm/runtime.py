"""Session helpers of the corpus operators: tables, Arrow batches, and results written where all executors see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import file_system, new_folder
from ..shipping import ship

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Workers get this package; Arrow batches are bounded by bytes as well, so that long texts don't meet in one; shuffle
    files of a finished step are deleted. The settings are the session's, as results are lazy and need them when they run."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """Tables of one query, written under the shared folder; lineage ends there, so a lost executor costs one step. The
    folder's store deletes it when the driver ends, since results are lazy and may read it until then."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root, self.count = spark, new_folder(spark, what), 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the rows as Parquet and read them again. Most columns are hashes, for which dictionaries are no use."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("parquet.enable.dictionary", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that no plan reads any more."""
        for t in tables:
            if (held := self.paths.pop(id(t), None)) is not None:
                store, path = file_system(self.spark, held[1])
                store.delete(path, True)


def text_column(df: DataFrame, name: str = "text") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), F.lit("")))
