"""Archives made of rows of the test tables, and what they hold."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources import archives
from .registry import query, table

#: Customers of one archive.
SIZE = 100


def _name() -> Column:
    """A member's name: some leave the folder, some are written in an odd way, and some are the same in every archive."""
    key = F.col("c_custkey")
    plain = F.concat_ws("/", "c_mktsegment", F.concat(key.cast("string"), F.lit(".wav")))
    return F.when(key % 17 == 0, F.concat(F.lit("../"), plain)).when(key % 19 == 0, F.concat(F.lit("/"), plain)).when(key % 23 == 0, F.concat(F.lit("./x//"), plain)).when(key % 29 == 0, F.lit("all/same.wav")).otherwise(plain)


_NAMES_SQL = f"""p AS (SELECT c_custkey AS k, c_custkey // {SIZE} AS a, c_mktsegment || '/' || c_custkey || '.wav' AS plain, octet_length(encode(c_name)) AS size FROM customer),
m AS (SELECT k, a, 'a' || a || ['.tar', '.zip', '.tar.gz'][a % 3 + 1] AS archive, CASE a % 3 WHEN 1 THEN 'zip' ELSE 'tar' END AS kind,
  CASE WHEN k % 17 = 0 THEN '../' || plain WHEN k % 19 = 0 THEN '/' || plain WHEN k % 23 = 0 THEN './x//' || plain WHEN k % 29 = 0 THEN 'all/same.wav' ELSE plain END AS name,
  CASE WHEN k % 17 = 0 OR k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN 'x/' || plain WHEN k % 29 = 0 THEN 'all/same.wav' ELSE plain END AS landing, size FROM p WHERE a % 7 <> 5)"""


def packed(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of a group's members, with a folder among them."""
    path, out = rows["path"].iloc[0], io.BytesIO()
    pairs = list(zip(rows["name"], rows["body"], strict=True))
    if path.endswith(".zip"):
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("all/", b"")
            for name, body in pairs:
                info = zipfile.ZipInfo()
                info.filename = name  # as it is: an absolute name too
                z.writestr(info, bytes(body))
    else:
        with tarfile.open(fileobj=out, mode="w:gz" if path.endswith("gz") else "w") as t:
            folder = tarfile.TarInfo("all")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
            for name, body in pairs:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(bytes(body)))
    whole = out.getvalue()
    return pd.DataFrame({"path": [path], "content": [whole[: len(whole) // 2] if path.split(".")[0].endswith("~") else whole]})


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of a hundred customers each, and their members. Of every seventh only the first half arrived."""
    ship(spark)
    c, number = table(spark, sf_dir, "customer"), F.expr(f"c_custkey div {SIZE}")
    ending = F.element_at(F.array(F.lit(".tar"), F.lit(".zip"), F.lit(".tar.gz")), (number % 3 + 1).cast("int"))
    path = F.concat(F.lit("a"), number.cast("string"), F.when(number % 7 == 5, "~").otherwise(""), ending)
    rows = c.select(path.alias("path"), _name().alias("name"), F.col("c_name").cast("binary").alias("body"))
    made = rows.groupBy("path").applyInPandas(packed, "path string, content binary")
    return archives.members(made, verify=True)


@query(f"WITH {_NAMES_SQL} SELECT archive, kind, name, CAST(size AS BIGINT) AS size, landing FROM m")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all archives that can be read, and where each would be unpacked to."""
    return archives.landed(members(spark, sf_dir)).where("error is null").select("archive", "kind", "name", "size", "landing")


@query(f"WITH {_NAMES_SQL} SELECT archive, name FROM m WHERE landing IS NULL")
def archive_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that would leave the folder they are unpacked to."""
    return archives.refused(members(spark, sf_dir)).select("archive", "name")


@query(f"WITH {_NAMES_SQL} SELECT kind, landing, count(*) AS n, count(DISTINCT archive) AS archives FROM m WHERE landing IS NOT NULL GROUP BY kind, landing HAVING count(*) > 1")
def archive_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that several members share, among the archives of one kind."""
    return archives.clashes(members(spark, sf_dir), ["kind"])


@query(f"SELECT 'a' || a || '~' || ['.tar', '.zip', '.tar.gz'][a % 3 + 1] AS archive FROM (SELECT DISTINCT c_custkey // {SIZE} AS a FROM customer) WHERE a % 7 = 5")
def archive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that were cut off: each says so in a row of its own, and the others are read."""
    return members(spark, sf_dir).where("error is not null").select("archive")
