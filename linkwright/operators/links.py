"""Relations between records and targets: as rows of pairs, or as keys that are equal on both sides.

The pairs of equal keys grow with the square of a key's records. What is asked of them mostly doesn't need them: counts are
sizes of groups, membership is a comparison of two records' keys, and only who asks for the pairs gets them as rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkwright.plans.staging import broadcast_if_small, staged

#: Targets of a key that make one array; a key with more is dealt to several tasks.
CHUNK = 1024


def repeats(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() > 0


def expand(left: DataFrame, right: DataFrame, keys: list[str], held: DataFrame | None = None) -> DataFrame:
    """(s1_id, target_id): all pairs of left (s1_id, keys) and right (target_id, keys) with equal keys, without the pairs of held.

    Targets come as arrays of some CHUNK, so no pair is a row before the last step, and no pair is shuffled. If neither side repeats a row, no pair comes twice.
    """
    sizes = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK)
    crowded = broadcast_if_small(staged(sizes.select(*keys, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "crowded-keys"))
    chunks = F.coalesce("chunks", F.lit(1))
    # explicit numbers, so that partitions of few bytes but many pairs aren't put together
    tasks = 8 * right.sparkSession.sparkContext.defaultParallelism
    dealt = right.join(crowded, keys, "left").select(*keys, "target_id", F.pmod(F.xxhash64("target_id"), chunks).cast("int").alias("chunk")).repartition(tasks, *keys, "chunk")
    asking = left.join(crowded, keys, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    if held is None:
        arrays = dealt.groupBy(*keys, "chunk").agg(F.collect_list("target_id").alias("targets"))
        asking = asking.repartition(tasks, *keys, "chunk")
        return asking.hint("shuffle_hash").join(arrays, [*keys, "chunk"]).select("s1_id", F.explode("targets").alias("target_id"))
    # a held pair goes to the one array that has its target, as a place in it: places are numbers, so what is left of them is found without comparing ids
    placed = dealt.dropna(subset=keys).withColumn("place", F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("target_id")) - 1)
    arrays = placed.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("place", "target_id")))["target_id"].alias("targets"))
    kept = held.select("s1_id", "target_id").join(placed, "target_id").select("s1_id", *keys, "chunk", "place")
    both = asking.withColumn("place", F.lit(None).cast("int")).unionByName(kept).repartition(tasks, *keys, "chunk")
    asking = both.groupBy("s1_id", *keys, "chunk").agg(F.collect_list("place").alias("held"), F.max(F.col("place").isNull()).alias("asks")).filter("asks").drop("asks")
    left_over = F.explode(F.array_except(F.sequence(F.lit(0), F.size("targets") - 1), "held"))
    return asking.hint("shuffle_hash").join(arrays, [*keys, "chunk"]).select("s1_id", "targets", left_over.alias("place")).select("s1_id", F.get("targets", "place").alias("target_id"))


@dataclass
class Rows:
    """Pairs (s1_id, target_id) as they are, repeats included."""

    rows: DataFrame

    def pairs(self) -> DataFrame:
        return self.rows.select("s1_id", "target_id")

    def distinct(self) -> Rows:
        return Rows(self.pairs().distinct())

    def total(self) -> DataFrame:
        return self.rows.agg(F.count(F.lit(1)).alias("n"))

    def counts(self) -> DataFrame:
        """(s1_id, n)"""
        return self.rows.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))

    def mark(self, pairs: DataFrame, flag: str) -> DataFrame:
        """pairs with flag: whether they are in the relation."""
        return pairs.join(self.pairs().distinct().withColumn(flag, F.lit(True)), ["s1_id", "target_id"], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))

    def met(self, pairs: DataFrame) -> DataFrame:
        """One row, n: how many of the relation are among pairs."""
        return self.rows.join(pairs.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_semi").agg(F.count(F.lit(1)).alias("n"))

    def only(self, records: DataFrame | None = None, targets: DataFrame | None = None) -> Rows:
        """The part of these records (s1_id) and targets (target_id)."""
        rows = self.rows if records is None else self.rows.join(records, "s1_id", "left_semi")
        return Rows(rows if targets is None else rows.join(targets, "target_id", "left_semi"))

    def without(self, pairs: DataFrame) -> DataFrame:
        return self.pairs().join(pairs.select("s1_id", "target_id"), ["s1_id", "target_id"], "left_anti")


@dataclass
class Keyed:
    """All pairs of left (s1_id, keys) and right (target_id, keys) whose keys are equal and not null. An id stands on its side once at most."""

    left: DataFrame
    right: DataFrame
    keys: list[str]

    def pairs(self) -> DataFrame:
        return expand(self.left, self.right, self.keys)

    def distinct(self) -> Keyed:
        return self

    def counts(self) -> DataFrame:
        sizes = self.right.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        return self.left.join(sizes, self.keys).select("s1_id", "n")

    def total(self) -> DataFrame:
        return self.counts().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def mark(self, pairs: DataFrame, flag: str) -> DataFrame:
        side = lambda df, key, p: df.select(key, *[F.col(k).alias(f"__{p}_{k}") for k in self.keys])
        both = pairs.join(side(self.left, "s1_id", "l"), "s1_id", "left").join(side(self.right, "target_id", "r"), "target_id", "left")
        equal: Column = reduce(lambda a, b: a & b, [F.col(f"__l_{k}") == F.col(f"__r_{k}") for k in self.keys])
        return both.select(*pairs.columns, F.coalesce(equal, F.lit(False)).alias(flag))

    def met(self, pairs: DataFrame) -> DataFrame:
        return self.mark(pairs.select("s1_id", "target_id").distinct(), "hit").filter("hit").agg(F.count(F.lit(1)).alias("n"))

    def only(self, records: DataFrame | None = None, targets: DataFrame | None = None) -> Keyed:
        left = self.left if records is None else self.left.join(records, "s1_id", "left_semi")
        return Keyed(left, self.right if targets is None else self.right.join(targets, "target_id", "left_semi"), self.keys)

    def without(self, pairs: DataFrame) -> DataFrame:
        return expand(self.left, self.right, self.keys, pairs)

    def both(self, other: Keyed) -> Keyed:
        """What is in either relation. The same records and targets stand on the sides of both, or those that don't are in neither."""
        name = lambda df, key, r, p: df.select(key, *[F.col(k).alias(f"{p}_{k}") for k in r.keys])
        join = lambda key, a, b: name(a, key, self, "x").join(name(b, key, other, "y"), key)
        return Keyed(join("s1_id", self.left, other.left), join("target_id", self.right, other.right), [*[f"x_{k}" for k in self.keys], *[f"y_{k}" for k in other.keys]])


def links(found: DataFrame | Rows | Keyed) -> Rows | Keyed:
    return Rows(found) if isinstance(found, DataFrame) else found
