"""From documents to token ids: quality rules, language ID, near duplicates, mixture, SentencePiece.

Each stage takes what its predecessor kept and returns the columns of documents; the last one returns a row per chunk
of token ids for each copy that the mixture takes. Null and empty texts fail the quality rules; an empty table
passes through all stages; further columns of documents are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import langid, mixing, neardup, quality, sentpiece
from linkwright.llm.batches import apart
from linkwright.plans.staging import staged

#: Share of a text's trigrams, corrected for false positives, that its language must contain.
LEAST_COVER = 0.5


#: The columns that stages read; all others travel under names of their own, whatever they are called.
READ = {"doc_id", "text", "lang", "source"}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their language's perplexity band reject."""
    inner, back = apart(docs, READ)
    return back(quality.judge(inner).filter("q_kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; one that lacks a language gets the one found."""
    inner, back = apart(docs, READ)
    found = langid.identify(inner, langid.Filters.fit(inner))
    kept = found.filter((F.col("l_pred") != "und") & (F.col("l_cover") >= LEAST_COVER))
    return back(kept.withColumn("lang", F.coalesce("lang", "l_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose 5-word shingles are 4/5 alike or more."""
    return neardup.keep_similar(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix_sources(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, chunk, n_tokens, ids, lossless)."""
    return sentpiece.encode(docs, sentpiece.read_model(), carry=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("source mixture", source_mixture),
    ("SentencePiece", sentencepiece),
]

#: Perplexities, Bloom filters, XXH64 fingerprints and BPE are beyond SQL: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
