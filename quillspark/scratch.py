"""Folders that all executors see, gone when the session ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset (local tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.gettempdir() + "/quillspark-shared"
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple[object, object]:
    """The store of a path, and the path in its terms."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own; its store deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    store, p = file_system(spark, path)
    store.mkdirs(p)
    store.deleteOnExit(p)
    return path


def write_file(spark: SparkSession, path: str, content: str) -> str:
    """One small file in whatever store the path names."""
    store, p = file_system(spark, path)
    out = store.create(p, True)
    out.write(bytearray(content.encode()))
    out.close()
    return path


def write_lines(df: DataFrame, path: str, rows_a_file: int = 0) -> str:
    """The one column of df as text files, a row a line; with ``rows_a_file`` no file holds more."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).text(path)
    return path


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True, quoted: bool = False) -> str:
    """df as delimited text; without quoting, values are written as they are."""
    writer = df.write.mode("overwrite").option("sep", sep).option("header", header).option("emptyValue", "").option("nullValue", "")
    writer = writer.option("quote", '"').option("escape", '"') if quoted else writer.option("quote", "\u0000").option("escape", "\u0000")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def keep(df: DataFrame, what: str) -> DataFrame:
    """The rows written under the shared folder and read again: lineage ends there, and what was drawn by place stays."""
    path = new_folder(df.sparkSession, what) + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
