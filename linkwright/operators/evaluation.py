"""Precision-weighted F score per record, macro averages, threshold sweeps and error analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkwright.operators.links import Keyed, Rows, links
from linkwright.plans.staging import staged


def f_score(tp: Column, predicted: Column, true: Column, beta: float = 0.5) -> tuple[Column, Column, Column]:
    """Precision, recall and F of counts: 1 where both are empty, 0 where one is."""
    p, r = tp / F.greatest(predicted, F.lit(1)), tp / F.greatest(true, F.lit(1))
    weighted = F.when(tp > 0, (1 + beta**2) * p * r / (F.lit(beta**2) * p + r)).otherwise(0.0)
    case = lambda c: F.when((predicted == 0) & (true == 0), 1.0).when((predicted == 0) | (true == 0), 0.0).otherwise(c)
    return case(p), case(r), case(weighted)


Relation = DataFrame | Rows | Keyed


def entity_counts(predicted: Relation, truth: Relation, asked: DataFrame) -> DataFrame:
    """(s1_id, n_pred, n_gt, tp) for each asked record: sizes of groups where relations are keys, else from one pass over marked pairs."""
    predicted, truth = links(predicted), links(truth)
    if isinstance(truth, Keyed):
        if isinstance(predicted, Keyed):
            found, hits = predicted.counts(), predicted.both(truth).counts()
        else:
            own = truth.mark(predicted.distinct().pairs(), "hit").groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
            found, hits = own.select("s1_id", "n"), own.select("s1_id", F.col("hits").alias("n"))
        out = asked.select("s1_id")
        for name, counts in (("n_pred", found), ("n_gt", truth.counts()), ("tp", hits)):
            out = out.join(counts.withColumnRenamed("n", name), "s1_id", "left")
    else:
        both = predicted.pairs().select("*", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.pairs().select("*", F.lit(0).alias("p"), F.lit(1).alias("t")))
        pairs = both.groupBy("s1_id", "target_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
        counts = pairs.groupBy("s1_id").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_gt"), F.sum(F.col("p") * F.col("t")).alias("tp"))
        out = asked.select("s1_id").join(counts, "s1_id", "left")
    return out.select("s1_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "n_gt", "tp")])


def entity_f05(predicted: Relation, truth: Relation, asked: DataFrame) -> DataFrame:
    counts = entity_counts(predicted, truth, asked)
    p, r, f = f_score(F.col("tp"), F.col("n_pred"), F.col("n_gt"))
    return counts.select("s1_id", "n_pred", "n_gt", "tp", p.alias("precision"), r.alias("recall"), f.alias("f05"))


def macro_f05(predicted: Relation, truth: Relation, asked: DataFrame) -> DataFrame:
    each = entity_f05(predicted, truth, asked)
    single = F.col("n_gt") == 0
    return each.agg(
        F.count(F.lit(1)).alias("num_entities"),
        F.round(F.avg("precision"), 5).alias("macro_precision"),
        F.round(F.avg("recall"), 5).alias("macro_recall"),
        F.round(F.avg("f05"), 5).alias("macro_f05"),
        F.coalesce(F.sum(single.cast("long")), F.lit(0)).alias("singleton_count"),
        F.round(F.coalesce(F.avg(F.when(single, F.col("f05"))), F.lit(0.0)), 5).alias("singleton_accuracy"),
        F.round(F.coalesce(F.avg(F.when(~single, F.col("f05"))), F.lit(0.0)), 5).alias("non_singleton_f05"),
    )


def thresholds(low: float = 0.15, high: float = 0.85, step: float = 0.02) -> list[float]:
    n = int((high + step / 2 - low) / step + 1e-9) + 1
    return [round(low + k * step, 4) for k in range(n) if low + k * step < high + step / 2]


def threshold_sweep(scored: DataFrame, truth: Relation, asked: DataFrame, low: float = 0.15, high: float = 0.85, step: float = 0.02) -> DataFrame:
    """(threshold, macro_f05): scored (s1_id, target_id, prob) is reduced to counts per record and threshold bin before thresholds come in."""
    values = thresholds(low, high, step)
    reached = F.aggregate(F.array(*map(F.lit, values)), F.lit(0), lambda n, t: n + (F.col("prob") >= t).cast("int"))
    hits = links(truth).mark(scored, "t").select("s1_id", reached.alias("n"), F.col("t").cast("int").alias("t"))
    bins = hits.filter("n > 0").groupBy("s1_id", "n").agg(F.count(F.lit(1)).alias("c"), F.sum("t").alias("h")).groupBy("s1_id").agg(F.collect_list(F.struct("n", "c", "h")).alias("bins"))
    real = links(truth).distinct().counts().withColumnRenamed("n", "n_gt")
    each = asked.select("s1_id").join(bins, "s1_id", "left").join(real, "s1_id", "left").withColumn("n_gt", F.coalesce("n_gt", F.lit(0)))
    each = each.select("n_gt", "bins", F.posexplode(F.array(*map(F.lit, values))).alias("k", "threshold"))
    above = lambda field: F.coalesce(F.aggregate("bins", F.lit(0).cast("long"), lambda acc, b: acc + F.when(b["n"] > F.col("k"), b[field]).otherwise(F.lit(0).cast("long"))), F.lit(0))
    each = each.select("threshold", "n_gt", above("c").alias("n_pred"), above("h").alias("tp"))
    _, _, f = f_score(F.col("tp"), F.col("n_pred"), F.col("n_gt"))
    return each.groupBy("threshold").agg(F.round(F.avg(f), 5).alias("macro_f05"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The best macro F, at the lowest threshold that has it."""
    return sweep.orderBy(F.desc("macro_f05"), "threshold").limit(1)


def error_totals(predicted: Relation, truth: Relation, asked: DataFrame) -> DataFrame:
    counts = entity_counts(predicted, truth, asked)
    none = F.col("n_gt") == 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(
        total(F.col("tp")).alias("total_tp_pairs"),
        total(F.col("n_pred") - F.col("tp")).alias("total_fp_pairs"),
        total(F.col("n_gt") - F.col("tp")).alias("total_fn_pairs"),
        total((none & (F.col("n_pred") > 0)).cast("int")).alias("singleton_false_positives_count"),
        total((~none & (F.col("n_pred") == 0)).cast("int")).alias("singleton_false_negatives_count"),
    )


def error_samples(predicted: Relation, truth: Relation, asked: DataFrame, most: int = 15) -> DataFrame:
    """(kind, s1_id, target_id): the first false pairs of each kind by record and target; a report, so it is limited to most rows of a kind."""
    counts = entity_counts(predicted, truth, asked).filter("n_gt > 0 and n_pred > 0 and (n_pred > tp or n_gt > tp)")
    # each record with an error gives a row of its kind at least, so the first most records have all that is asked for; no others become pairs
    wrong = staged(counts, "records-with-errors")
    few = staged(reduce(DataFrame.unionByName, [wrong.filter(f"{n} > tp").orderBy("s1_id").limit(most).select("s1_id") for n in ("n_pred", "n_gt")]).distinct(), "first-errors")
    p, t = (staged(links(r).only(F.broadcast(few)).distinct().pairs(), "pairs-with-errors") for r in (predicted, truth))
    fp = p.join(t, ["s1_id", "target_id"], "left_anti").withColumn("kind", F.lit("false_positive"))
    fn = t.join(p, ["s1_id", "target_id"], "left_anti").withColumn("kind", F.lit("false_negative"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("s1_id", "target_id"))
    return fp.unionByName(fn).withColumn("r", rank).filter(F.col("r") <= most).select("kind", "s1_id", "target_id")


def multi_match_errors(predicted: Relation, truth: Relation, asked: DataFrame, most: int = 15) -> DataFrame:
    """The first records of several matches that are found in part; a report of most rows."""
    each = entity_f05(predicted, truth, asked).filter("n_gt > 1 and n_pred > 0 and (n_pred > tp or n_gt > tp)")
    return each.orderBy("s1_id").limit(most).select("s1_id", F.col("n_gt").alias("true_count"), F.col("n_pred").alias("pred_count"), F.col("tp").alias("tp_count"), F.round("f05", 4).alias("f05"))
