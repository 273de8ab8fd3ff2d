"""Mixing sources to target weights (operator 3).

Sizes are added up by source (partial sums before the shuffle, so a source with a third of all rows costs no more than
another), target weights become repetition rates, and every document is emitted floor(rate) times plus once more with
probability equal to the fraction. That last draw is a function of a seed and the document's id, so reruns agree.

Targets share 100 % of all words by weight; none may exceed ``cap`` times what its source has, and the excess is
reshared by weight until none does. The fixed point is min(cap * size, level * weight) for one common level. Sources
sorted by cap * size / weight reach their caps in that order, so running sums over the sources give it in one pass.
That pass runs over one row a source; it is one task, of 40 bytes a source.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order;
equal ids draw alike (ties and repeated rows give equal decisions); an empty table gives an empty result; other columns
are carried by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Scratch, table

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: One more than the largest draw.
DRAWS = 1 << 52


def n_words(text: Column) -> Column:
    """Runs of characters outside 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone; 52 bits, so it is exact in a double."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("-"))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(DRAWS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size)."""
    one = F.lit(0)
    rank = F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("double"))
    full = ranked.withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    by_level = Window.partitionBy(one).orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy(one)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # Until the first source whose cap isn't reached, sources hold their caps; from it on, all follow its level.
    open_ = F.when(level * F.col("weight") <= F.col("most"), level)
    found = full.withColumn("level", open_).withColumn("level", F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return found.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0).alias("rate"))


def plan(documents: DataFrame, scratch: Scratch, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each document with its size, its source's size and target, and how many copies the mix takes."""
    sized = documents.select(*carry, "source", n_words(F.col("text")).alias("size"))
    totals = documents.select("source", n_words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source, written: so Spark knows its size before it plans the join, and broadcasts it if that is small;
    # else a shuffle joins, split where one source has very many rows.
    goal = scratch.keep(targets(totals).withColumnRenamed("source", "goal_source"))
    whole = F.floor("rate")
    copies = F.least(whole + (draw(F.col("doc_id")) < F.col("rate") - whole).cast("long"), F.lit(CAP))
    return sized.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn("copies", copies.cast("long"))


def mix(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, all columns unchanged."""
    kept = documents.columns
    sized = plan(documents.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in kept])), scratch, ("doc_id", "__row"))
    return sized.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
   / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
o AS (SELECT *, (SELECT level FROM l b WHERE b.level * b.weight <= b.most ORDER BY b.most / b.weight, b.source NULLS LAST LIMIT 1) AS shared FROM l),
t AS (SELECT source, source_size, CASE WHEN shared IS NULL OR most / weight < shared THEN most ELSE least(most, shared * weight) END AS target FROM o),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate FROM t),
j AS (SELECT doc_id, size, source_size, target, rate, CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 13) AS BIGINT) AS DOUBLE) / {DRAWS}.0 AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken FROM j
"""
