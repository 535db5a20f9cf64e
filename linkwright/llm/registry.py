"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from linkwright.llm import bytequality, chat, fingerprint, langid, mixing, neardup, quality, sentpiece, shards, toxicity

QUERIES = {
    "op1_chat_rotation": chat.query,
    "op2_source_mixture": mixing.query,
    "op3_simhash_near_dedup": neardup.query,
    "op4_quality_rules": quality.query,
    "op5_toxicity": toxicity.query,
    "op6_language_id": langid.query,
    "op7_document_fingerprints": fingerprint.query,
    "op8_byte_quality": bytequality.query,
    "op9_size_tiered_shards": shards.query,
    "op10_sentencepiece": sentpiece.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op1_chat_rotation": chat.ORACLE,
    "op2_source_mixture": mixing.ORACLE,
}
