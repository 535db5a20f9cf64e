"""Bounded samples of labelled texts, and what the classifiers share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.plans.staging import broadcast_if_small, staged

FOLDS, HELD_OUT = 5, 0
#: Labelled rows of either class that a classifier is fitted on, at most, and the code points of one.
PER_CLASS = 3000
MAX_CHARS = 50_000


def fold(id_col: str, folds: int = FOLDS) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


@dataclass
class Sample:
    texts: list[str]
    langs: list[str]
    y: np.ndarray
    #: log odds of label 1 among all labelled rows outside of the held-out fold, less those in the sample
    shift: float


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): labelled ids outside of the held-out fold. Of an id's labels the least counts; ids that are null teach nothing."""
    learn = labels.filter((fold("doc_id") != HELD_OUT) & F.col(label).isin(0, 1)).filter("doc_id is not null")
    return learn.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("y"))


def every(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Staged (doc_id, text, lang, y) of all labelled rows outside of the held-out fold, in an order by a hash of their id. Of an id's texts the first in code point order counts."""
    learn = broadcast_if_small(staged(learnable(labels, label), "labels"))
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang")).join(learn, "doc_id")
    if docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t"), F.min("y").alias("y")).select("doc_id", "t.text", "t.lang", "y")
    hashed = rows.withColumn("h", F.xxhash64(F.lit(label), "doc_id"))
    return staged(hashed.repartition("h").sortWithinPartitions("h", "doc_id").drop("h"), "labelled-texts")


def draw(docs: DataFrame, labels: DataFrame, label: str, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Sample:
    """Up to per_class labelled rows of either class, first by a hash of their id, outside of the held-out fold.

    Of an id's labels the least counts, of its texts the first in code point order, so reruns agree. Ids that are null teach nothing.

    Only ids and labels are ordered; their texts come from a scan of docs joined with these few ids.
    """
    learn = learnable(labels, label)
    count = {r.y: r["count"] for r in learn.groupBy("y").count().collect()}
    chosen = [learn.filter(F.col("y") == v).orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang")).filter(F.length("text") <= max_chars)
    rows = texts.join(few, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("t"), F.min("y").alias("y")).select("doc_id", "t.text", "t.lang", "y").toArrow().to_pydict()
    order = np.argsort(np.array(rows["doc_id"], dtype=np.int64), kind="stable")
    y = np.array(rows["y"], dtype=np.float64)[order]
    odds = lambda ones, all_: np.log((ones + 1) / (all_ - ones + 1))
    shift = odds(count.get(1, 0), sum(count.values())) - odds(y.sum(), len(y))
    return Sample([rows["text"][i] for i in order], [rows["lang"][i] for i in order], y, float(shift))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)
