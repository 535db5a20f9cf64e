"""Mixing sources to target weights.

Words are counted per source, targets follow from the weights, and each document is emitted
floor(rate) times plus one more time with probability rate - floor(rate), where
rate = target / size of its source. The draw is a hash of seed and document id, so reruns,
retries and any partitioning agree.

Defined results: null text has size 0; a null source is a source of its own, ordered last;
a source without words has target 0; rows that repeat a doc_id share its draw; an empty
table gives no rows; other columns are carried along (plan_mixture replaces those named mix_size, mix_source_size,
mix_target, mix_copies or mix_taken; mix_sources keeps them as they are).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkwright.llm.batches import apart, fresh
from linkwright.plans.staging import broadcast_if_small, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(key: Column, seed: int) -> Column:
    """A double in [0, 1) from 52 bits of a hash of the seed and the key."""
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code point order take the weights in turn. A target is min(cap, level * weight) with
    cap = max_repeat * source_size; the level is where the targets add up to share of all words, which is
    where resharing every excess by weight ends. Its windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    per = per.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).alias("weight"))
    per = per.withColumn("cap", F.lit(max_repeat) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    chosen = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(chosen, F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def plan_mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = 1.0, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_copies and mix_taken (words taken, repeats counted).

    Two scans of docs and no shuffle of texts: the first reduces to a row per source and task, the second
    joins the staged source table, broadcast if it has no more than BROADCAST_ROWS rows.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    key = fresh("mix_source", docs.columns)
    targets = staged(source_targets(sizes, weights, share, max_repeat), "mix-targets").select(F.col("source").alias(key), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    extra = unit_draw(F.col(id_col), seed) < rate - F.floor(rate)
    return (
        docs.withColumn("mix_size", word_count(F.col(text_col)))
        .join(broadcast_if_small(targets), F.col(source_col).eqNullSafe(F.col(key)), "left")
        .drop(key)
        .withColumn("mix_copies", (F.floor(rate) + extra.cast("long")).cast("int"))
        .withColumn("mix_taken", F.col("mix_size") * F.col("mix_copies"))
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as the plan takes it, in the columns of docs."""
    needed = {options.get(f"{c}_col", default) for c, default in (("id", "doc_id"), ("text", "text"), ("source", "source"))}
    inner, back = apart(docs, needed)
    copy = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return back(plan_mixture(inner, **options).filter("mix_copies > 0").select("*", copy.alias("mix_copy")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return plan_mixture(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, [1, 2, 3][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM per
), capped AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight::DOUBLE AS ratio FROM weighed
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(CASE WHEN level <= ratio THEN level END) OVER () * weight) AS target FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), taken AS (
  SELECT *, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM taken
"""
