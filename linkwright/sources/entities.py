"""Business records over the driver's tables, and their ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkwright.operators.links import Keyed

#: Eight words of a text are used: a whole one isn't lowered and split for them. The ninth stays, as how the eighth is lowered may depend on it.
HEAD = r"regexp_extract(text, r'^[^\p{L}\p{N}]*+(?:[\p{L}\p{N}]++[^\p{L}\p{N}]*+){0,9}', 0)"
WORDS = rf"split(trim(regexp_replace(lower({HEAD}), r'[^\p{{L}}\p{{N}}]+', ' ')), ' ') as ws"
COLUMNS = [
    "doc_id as ingest_seq",
    "case doc_id % 3 when 0 then 1 when 1 then 2 else 3 end as source",
    "concat(case doc_id % 3 when 0 then 'S1-' when 1 then 'S2-' else 'S3-' end, cast(doc_id as string)) as entity_id",
    "concat(array_join(slice(ws, 1, 3), ' '), case doc_id % 5 when 0 then ' Pvt Ltd' when 1 then ' Ltd' when 2 then ', Inc.' when 3 then ' SARL' else '' end) as business_name",
    "case when doc_id % 30 = 7 then '' else concat(cast(n_chars % 97 + 1 as string), ' ', coalesce(get(ws, 3), 'x'), ' St, ', coalesce(get(ws, 4), 'y'), ' ', cast(10000 + n_chars % 53 as string)) end as business_address",
    "case lang when 'en' then 'usa' when 'fr' then 'FR' when 'de' then 'germany' else 'India' end as country",
    "array_join(slice(ws, 1, 8), ' ') as gt_key",
]


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr("doc_id", "lang", "n_chars", WORDS).selectExpr(*COLUMNS)


def truth_pairs(records: DataFrame) -> DataFrame:
    """(s1_id, target_id): equal country and gt_key."""
    left = records.filter("source = 1").selectExpr("entity_id as s1_id", "country", "gt_key")
    right = records.filter("source > 1").selectExpr("entity_id as target_id", "country", "gt_key")
    return left.join(right, ["country", "gt_key"]).select("s1_id", "target_id")


def truth_keys(records: DataFrame) -> Keyed:
    """truth_pairs of records whose ids are distinct, by their keys."""
    side = lambda which, name: records.filter(which).selectExpr(f"entity_id as {name}", "country", "gt_key")
    return Keyed(side("source = 1", "s1_id"), side("source > 1", "target_id"), ["country", "gt_key"])


def truth_entities(records: DataFrame) -> DataFrame:
    return records.filter("source = 1").selectExpr("entity_id as s1_id")
