"""Union of candidates with provenance, the best of each record, and recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkwright.operators import blocking
from linkwright.operators.links import Keyed, Rows, links, repeats
from linkwright.plans.staging import staged

FLAGS = ("gen_exact", "gen_token", "gen_tfidf", "gen_address")
MAX_CANDIDATES = 45


def _bits(*flags: str) -> int:
    return sum(1 << FLAGS.index(f) for f in flags)


def _flagged(rows: DataFrame) -> DataFrame:
    """(s1_id, target_id, bits) with a column for each flag, and their count."""
    return rows.select("s1_id", "target_id", *[(F.col("bits").bitwiseAND(1 << k) != 0).alias(f) for k, f in enumerate(FLAGS)], F.bit_count("bits").cast("int").alias("gen_count"))


def _capped(s1: DataFrame, targets: DataFrame, enable_tfidf: bool, min_similarity: float, top_k: int) -> DataFrame:
    """(s1_id, target_id, bits), repeats included, of the strategies that are bounded for each record: all but the exact keys, whose bit is set where it belongs."""
    found = {"gen_token": blocking.token_pairs(s1, targets), "gen_address": blocking.address_pairs(s1, targets)}
    if enable_tfidf:
        alike = staged(blocking.by_similarity(s1, targets, min_similarity, top_k).select("s1_id", "target_id"), "similar")
        found["gen_tfidf"] = blocking.mark_exact(alike, s1, targets, "exact")
    exact = F.when(F.col("exact"), _bits("gen_exact")).otherwise(0)
    rows = reduce(DataFrame.unionByName, [pairs.select("s1_id", "target_id", F.lit(_bits(f)).bitwiseOR(exact).alias("bits")) for f, pairs in found.items()])
    if not (repeats(s1, "entity_id") or repeats(targets, "entity_id")):
        return rows
    # an id that several records share has the flags of all of them
    marked = blocking.mark_exact(_once(rows), s1, targets, "exact")
    return marked.select("s1_id", "target_id", F.col("bits").bitwiseOR(exact).alias("bits"))


def _once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s1_id", "target_id").agg(F.bit_or("bits").alias("bits"))


def union_with_provenance(s1: DataFrame, targets: DataFrame, enable_tfidf: bool = False, min_similarity: float = blocking.MIN_SIMILARITY, top_k: int = blocking.TOP_K) -> DataFrame:
    """(s1_id, target_id, gen_exact, gen_token, gen_tfidf, gen_address, gen_count).

    Exact pairs may be many: those that no other strategy finds are made last and meet no shuffle.
    """
    capped = staged(_once(_capped(s1, targets, enable_tfidf, min_similarity, top_k)), "capped-candidates")
    exact = _bits("gen_exact")
    rest = blocking.exact_union(s1, targets, held=capped.filter(F.col("bits").bitwiseAND(exact) != 0))
    return _flagged(capped.unionByName(rest.withColumn("bits", F.lit(exact))))


def best_candidates(s1: DataFrame, targets: DataFrame, limit: int = MAX_CANDIDATES, enable_tfidf: bool = False, min_similarity: float = blocking.MIN_SIMILARITY, top_k: int = blocking.TOP_K) -> DataFrame:
    """top_candidates of union_with_provenance, the same rows, without all exact pairs.

    What only the exact keys find comes after all that another strategy finds too, in order of target_id. So every exact pair before it in that
    order is before it among the candidates as well, and none beyond a record's first limit exact pairs can be chosen.
    """
    exact = blocking.first_exact(s1, targets, limit).withColumn("bits", F.lit(_bits("gen_exact")))
    rows = _capped(s1, targets, enable_tfidf, min_similarity, top_k).unionByName(exact).repartition("s1_id")
    return top_candidates(_flagged(_once(rows)), limit)


def top_candidates(candidates: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    order = Window.partitionBy("s1_id").orderBy(F.desc("gen_count"), F.desc("gen_exact"), F.desc("gen_token"), F.desc("gen_tfidf"), "target_id")
    return candidates.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit).drop("r")


def recall(candidates: DataFrame, truth: DataFrame | Rows | Keyed, asked: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: recall of true pairs, candidates per record, and the share of all pairs that is spared. asked: (s1_id) of the truth."""
    own = candidates.select("s1_id", "target_id").join(asked.select("s1_id"), "s1_id", "left_semi")
    counts = (
        links(truth).total().withColumnRenamed("n", "total_gt_pairs")
        .crossJoin(links(truth).met(own).withColumnRenamed("n", "recalled_gt_pairs"))
        .crossJoin(own.agg(F.count(F.lit(1)).alias("total_candidates_generated")))
        .crossJoin(asked.agg(F.count(F.lit(1)).alias("total_s1")))
        .crossJoin(targets.agg(F.count(F.lit(1)).alias("total_targets")))
    )
    part = F.col("recalled_gt_pairs") / F.greatest("total_gt_pairs", F.lit(1))
    return counts.select(
        "total_s1", "total_gt_pairs", "recalled_gt_pairs", F.round(part, 5).alias("candidate_recall"), F.round(part * 100, 2).alias("candidate_recall_pct"), "total_candidates_generated",
        F.round(F.col("total_candidates_generated") / F.greatest("total_s1", F.lit(1)), 2).alias("avg_candidates_per_s1"),
        F.round(1 - F.col("total_candidates_generated") / F.greatest(F.col("total_s1") * F.col("total_targets"), F.lit(1)), 6).alias("reduction_ratio"),
    )


def recall_by_strategy(candidates: DataFrame, truth: DataFrame | Rows | Keyed) -> DataFrame:
    """(strategy, candidates, recalled) by the flags of the candidates that are left, and for all of them."""
    hit = links(truth).mark(candidates, "hit").withColumn("hit", F.col("hit").cast("int"))
    kinds = F.array(F.struct(F.lit("union").alias("strategy"), F.lit(True).alias("on")), *[F.struct(F.lit(f.removeprefix("gen_")).alias("strategy"), F.col(f).alias("on")) for f in FLAGS])
    each = hit.select("hit", F.explode(kinds).alias("k")).select("hit", "k.*")
    return each.groupBy("strategy").agg(F.sum(F.col("on").cast("long")).alias("candidates"), F.sum(F.when(F.col("on"), F.col("hit")).otherwise(0)).cast("long").alias("recalled"))
