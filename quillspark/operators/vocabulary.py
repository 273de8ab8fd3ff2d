"""Character vocabularies: build, floor, expand, encode, decode.

A vocabulary is a table (char, id). Ids 0 and 1 are the blank and the unknown character; the rest are in code point order,
and an expansion appends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policies import Policy
from ..functions.text import characters

BLANK, UNKNOWN = "<blank>", "<unk>"
ANY_LANGUAGE = "*"


def character_counts(texts: DataFrame, text: str = "normalized") -> DataFrame:
    """(char, n). Counted within each row first, so what is shuffled is one row for a character and task."""
    return texts.select(F.explode(characters(F.col(text))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def floored(counts: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Characters that occur often enough, and those that the floor evicts."""
    return counts.where(F.col("n") >= least), counts.where(F.col("n") < least)


def numbered(chars: DataFrame, after: int) -> DataFrame:
    """(char, id) in code point order, ids from ``after`` + 1. A vocabulary is some thousands of rows at most."""
    return chars.select("char", (F.row_number().over(Window.orderBy("char")) + after).cast("int").alias("id"))


def build(spark: SparkSession, counts: DataFrame, least: int = 1) -> DataFrame:
    kept, _ = floored(counts, least)
    reserved = spark.createDataFrame([(BLANK, 0), (UNKNOWN, 1)], "char string, id int")
    return reserved.unionByName(numbered(kept, 1))


def build_checked(spark: SparkSession, counts: DataFrame, least: int = 1) -> DataFrame:
    """The same, refusing a vocabulary without characters."""
    if floored(counts, least)[0].isEmpty():
        raise ValueError(f"a floor of {least} evicts every character")
    return build(spark, counts, least)


def expand(vocabulary: DataFrame, counts: DataFrame, least: int = 1, size: int | None = None) -> DataFrame:
    """The vocabulary with new characters appended; the floor applies to new ones only, known ids stay."""
    fresh = counts.join(vocabulary, "char", "left_anti").where(F.col("n") >= least)
    size = vocabulary.agg(F.max("id")).collect()[0][0] if size is None else size
    return vocabulary.unionByName(numbered(fresh, size))


def require_same_policy(known: Policy | None, asked: Policy, code: str) -> None:
    if known is not None and known.digest() != asked.digest():
        raise ValueError(f"{code}: the vocabulary was built under {known.version}/{known.digest()}, not {asked.version}/{asked.digest()}")


def policy_of(policies: dict[str, Policy], code: str) -> Policy:
    if code in policies or ANY_LANGUAGE in policies:
        return policies.get(code, policies.get(ANY_LANGUAGE))
    raise KeyError(f"the vocabulary has no policy for {code!r}")


def spaces(vocabularies: DataFrame, by: list[str]) -> DataFrame:
    """(by, usable): does each vocabulary hold the space, and not as the blank? A spaced script needs it."""
    return vocabularies.groupBy(*by).agg(F.coalesce(F.bool_or((F.col("char") == " ") & (F.col("id") > 0)), F.lit(False)).alias("usable"))


def require_space(vocabulary: DataFrame) -> None:
    if not spaces(vocabulary, []).first().usable:
        raise ValueError("the vocabulary has no usable space")


def encode(texts: DataFrame, vocabulary: DataFrame, text: str = "normalized", out: str = "ids") -> DataFrame:
    """texts with the ids of their characters; an unknown one is 1. Nothing is normalized here.

    A vocabulary has no more rows than there are code points; it goes to the workers as a table of them, by which a batch of texts is looked
    up at once, so a character costs the same whatever the size of the vocabulary."""
    known = [(ord(r.char), r.id) for r in vocabulary.where(F.length("char") == 1).select("char", "id").collect()]
    by_point = np.ones(max([p for p, _ in known], default=0) + 2, np.int32)  # the last stands for all beyond
    by_point[[p for p, _ in known]] = [k for _, k in known]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(values: pa.Array) -> pa.Array:
        filled = values.fill_null("")
        points = np.frombuffer("".join(filled.to_pylist()).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(pc.utf8_length(filled).to_numpy())]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(by_point[np.minimum(points, len(by_point) - 1)]))

    return texts.withColumn(out, ids(F.col(text)))


def collapse(ids: Column) -> Column:
    """Drops an id equal to the one before it, then the reserved ids 0 and 1."""
    size = F.size(ids)
    kept = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.struct(F.get(ids, i - 1).alias("id"), F.get(ids, i - 2).alias("before"))), lambda x: x["id"].isNotNull() & ~x["id"].eqNullSafe(x["before"]) & (x["id"] > 1))
    return F.transform(kept, lambda x: x["id"])


def decode(frames: DataFrame, vocabulary: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
    """frames with the text of their collapsed ids; ids outside the vocabulary are dropped."""
    by_id = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("id", "char"))).alias("__by"), F.max("id").alias("__last"))
    # The characters in the order of ids, so that a lookup is one step.
    chars = by_id.select(F.transform(F.sequence(F.lit(0), F.coalesce("__last", F.lit(0))), lambda k: F.try_element_at("__by", k)).alias("__chars"))
    named = F.filter(F.transform(collapse(F.col(ids)), lambda k: F.get("__chars", k)), lambda c: c.isNotNull())
    return frames.crossJoin(F.broadcast(chars)).withColumn(out, F.array_join(named, "")).drop("__chars")


def greedy(scores: Column, length: Column) -> Column:
    """The best id of each frame up to ``length``; of equal scores the first. ``scores``: array of arrays."""
    best = F.transform(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int"))
    return F.slice(best, F.lit(1), length)
