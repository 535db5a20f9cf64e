"""Profiles of sources and of ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.tables import ACCENTS, DEVANAGARI_RANGE, GUJARATI_RANGE
from linkwright.plans.heads import marked

SAMPLE = 250_000


def _field(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _percent(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, digits)


def profile_source(records: DataFrame, sample_limit: int = SAMPLE, by: str = "source") -> DataFrame:
    """A row per source: totals and missing fields over all records; lengths, duplicates and scripts over the first sample_limit in order of ingest_seq.

    The sample is a report's own limit.
    """
    df = marked(records, by, "ingest_seq", sample_limit, "s").select(by, _field("business_name").alias("n"), _field("business_address").alias("a"), _field("country").alias("c"), "s")
    sampled = F.sum(F.col("s").cast("long"))
    count = lambda c: F.sum(c.cast("long"))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("s"), c)), F.lit(0.0)), 2)
    tokens = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    twice = lambda *c: _percent(sampled - F.count_distinct(F.when(F.col("s"), F.struct(*c))), sampled, 2)
    script = lambda pattern: _percent(count(F.col("s") & F.col("n").rlike(pattern)), sampled, 2)
    total = F.count(F.lit(1))
    return df.groupBy(by).agg(
        total.alias("total_records"), sampled.alias("sampled_records"),
        *[x for c, one, many in (("n", "name", "names"), ("a", "address", "addresses"), ("c", "country", "countries")) for x in (count(F.col(c) == "").alias(f"missing_{many}"), _percent(count(F.col(c) == ""), total, 4).alias(f"missing_{one}_pct"))],
        twice("n").alias("sample_duplicate_name_pct"), twice("a").alias("sample_duplicate_addr_pct"), twice("n", "a").alias("sample_duplicate_combo_pct"),
        mean(F.length("n")).alias("name_length_mean"), mean(tokens(F.col("n"))).alias("name_tokens_mean"),
        mean(F.length("a")).alias("addr_length_mean"), mean(tokens(F.col("a"))).alias("addr_tokens_mean"),
        script(DEVANAGARI_RANGE).alias("devanagari_script_pct"), script(GUJARATI_RANGE).alias("gujarati_script_pct"), script(ACCENTS).alias("accented_chars_pct"),
    )


def country_histogram(records: DataFrame, by: str = "source") -> DataFrame:
    """Raw labels; records without one are left out."""
    return records.select(by, _field("country").alias("country")).filter("country <> ''").groupBy(by, "country").agg(F.count(F.lit(1)).alias("records"))


def _match_counts(truth_lines: DataFrame) -> DataFrame:
    """(n, s2, s3) of each line (s1_id, matched string); repeated ids count."""
    ids = F.filter(F.transform(F.split(F.coalesce("matched", F.lit("")), ","), lambda i: F.trim(i)), lambda i: i != "")
    begins = lambda p: F.size(F.filter("ids", lambda i: F.startswith(i, F.lit(p))))
    return truth_lines.select(ids.alias("ids")).select(F.size("ids").alias("n"), begins("S2-").alias("s2"), begins("S3-").alias("s3"))


def profile_truth(truth_lines: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n = F.col("n")
    parts = [("singletons_zero_matches", "singletons_pct", n == 0), ("one_match", "one_match_pct", n == 1), ("multi_matches", "multi_matches_pct", n > 1)]
    pairs = F.coalesce(F.sum("n"), F.lit(0))
    return _match_counts(truth_lines).agg(
        total.alias("total_s1_entities"), *[x for name, pct, c in parts for x in (count(c).alias(name), _percent(count(c), total, 2).alias(pct))],
        pairs.alias("total_matched_pairs"), F.round(pairs / F.greatest(total, F.lit(1)), 3).alias("mean_matches_per_s1"), F.coalesce(F.max("n"), F.lit(0)).alias("max_matches"),
        F.coalesce(F.sum("s2"), F.lit(0)).alias("total_s2_matches"), F.coalesce(F.sum("s3"), F.lit(0)).alias("total_s3_matches"),
    )


def truth_histogram(truth_lines: DataFrame) -> DataFrame:
    return _match_counts(truth_lines).groupBy(F.col("n").alias("matches")).agg(F.count(F.lit(1)).alias("entities"))
