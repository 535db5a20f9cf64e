"""Language identification by bit-sliced Bloom filters of character trigrams.

One array of SLOTS words of 64 bits holds a Bloom filter for each of 64 languages, one bit of a word each (more
languages: more arrays). A look-up takes the AND of HASHES words and so returns all languages that contain a
trigram at once. A language's filter has the trigrams that make up at least MIN_SHARE of its training text and
at least RIVAL of the share that they have in any language, so at most 1 / MIN_SHARE trigrams each. The hits of a
language, as a share h of a text's trigrams, are corrected for its rate f of false positives, its share of set
bits to the power HASHES: (h - f) / (1 - f). The largest wins, ties go to the first in code point order.

Trigrams are taken from the text in lower case with each run of other characters than letters as one space.
The score is the winner's part of all positive corrected shares.

Defined results: null text and text without a letter is "und" with score 0, as is any text where nothing is
learned; a null language is not learned from; repeated rows each get their row; an empty table gives no rows;
further columns are carried along (existing l_* columns are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkwright.llm.batches import PAD, Counts, Trigrams, by_label, code_points, slices, text_parts, with_columns, xxhash_longs
from linkwright.llm.labelled import fold
from linkwright.plans.staging import broadcast_if_small, staged

SLOT_BITS = 22
HASHES = 3
MIN_SHARE = 2e-6
RIVAL = 0.1
MAX_LANGUAGES = 4096
FOLDS, HELD_OUT = 3, 1
FIELDS = [("l_pred", T.StringType()), ("l_score", T.DoubleType()), ("l_cover", T.DoubleType())]


class _Letters:
    """Whether a code point is a letter; made once in each process, and left behind when code travels."""

    def __init__(self):
        self.table: np.ndarray | None = None

    def __reduce__(self):
        return (_Letters, ())

    def get(self) -> np.ndarray:
        if self.table is None:
            self.table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        return self.table


_LETTERS = _Letters()


def letters_only(texts: Sequence[str]) -> list[str]:
    """Each text in lower case, runs of non-letters as one space; "" if there is no letter."""
    out = []
    for part in text_parts([t.lower() for t in texts]):
        codes = code_points("".join(p[c:] for _, p, c in part)).copy()
        letter = _LETTERS.get()[codes]
        codes[~letter] = 32
        ends = np.cumsum([len(p) - c for _, p, c in part])
        starts = ends - [len(p) - c for _, p, c in part]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        # a piece goes on where the one before it ended
        after = np.array([c > 0 and bool(_LETTERS.get()[ord(p[c - 1])]) for _, p, c in part])
        keep[starts] = letter[starts] | after
        total = np.concatenate([[0], np.cumsum(keep)])
        text = codes[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        out += [(i, text[total[s] : total[e]]) for (i, _, _), s, e in zip(part, starts, ends)]
    joined = [""] * len(texts)
    for i, piece in out:
        joined[i] += piece
    return joined


def count_by_language(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Staged (lang, key, n) over all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in slices(batches, 1):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, rows in by_label(langs).items():
                for part in text_parts(letters_only([texts[i] for i in rows])):
                    grams = Trigrams(part)
                    counts.add(lang, grams.keys, grams.counts)
        yield from counts.batches()

    pairs = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text <> ''")
    return staged(pairs.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "language-trigrams")


def _hash_column(key: Column, k: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), k * SLOT_BITS % 64).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) if k < 2 else F.shiftrightunsigned(F.xxhash64(F.xxhash64(key)), 64 - SLOT_BITS)


def _hashes(keys: np.ndarray) -> list[np.ndarray]:
    first = xxhash_longs(keys, 42)
    second = xxhash_longs(first.view(np.int64), 42)
    low = np.uint64((1 << SLOT_BITS) - 1)
    return [(first & low).astype(np.int64), ((first >> np.uint64(SLOT_BITS)) & low).astype(np.int64), (second >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]


class Filters:
    """names: languages in code point order. planes: for each 64 of them, the slots that have a bit set, in order, and their words."""

    def __init__(self, names: list[str], planes: list[tuple[np.ndarray, np.ndarray]]):
        self.names, self.sparse, self.planes = names, planes, []
        self.false_rate = np.zeros(len(names))
        for p, (slots, words) in enumerate(planes):
            full = np.zeros(1 << SLOT_BITS, np.uint64)
            full[slots] = words
            self.planes.append(full)
            for bit in range(min(64, len(names) - 64 * p)):
                self.false_rate[64 * p + bit] = (((words >> np.uint64(bit)) & np.uint64(1)).sum() / (1 << SLOT_BITS)) ** HASHES

    @classmethod
    def fit(cls, docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> Filters:
        """Counts cover all of docs; the driver gets at most 2**SLOT_BITS rows for each 64 languages."""
        counts = count_by_language(docs, lang_col, text_col)
        names = sorted((r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()), key=lambda s: s.encode())
        if len(names) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        if not names:
            return cls([], [])
        spark = docs.sparkSession
        ids = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "lang string, id long")
        totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        share = counts.join(broadcast_if_small(staged(totals.join(F.broadcast(ids), "lang"), "languages")), "lang").select("id", "key", (F.col("n") / F.col("total")).alias("share"))
        most = F.max("share").over(Window.partitionBy("key"))
        chosen = share.withColumn("most", most).filter((F.col("share") >= MIN_SHARE) & (F.col("share") >= RIVAL * F.col("most")))
        bit = F.expr("shiftleft(1L, cast(id % 64 as int))")
        set_bits = chosen.select(F.expr("id div 64").alias("plane"), F.explode(F.array(*[_hash_column(F.col("key"), k) for k in range(HASHES)])).alias("slot"), bit.alias("bit")).groupBy("plane", "slot").agg(F.bit_or("bit").alias("word"))
        rows = staged(set_bits, "language-filters").toArrow()
        plane, slot, word = (rows.column(c).to_numpy() for c in ("plane", "slot", "word"))
        return cls(names, [(slot[plane == p], word[plane == p].view(np.uint64)) for p in range(-(-len(names) // 64))])

    def languages_of(self, keys: np.ndarray) -> list[np.ndarray]:
        """For each plane, the words whose bits are the languages that contain each trigram."""
        at = _hashes(keys)
        return [plane[at[0]] & plane[at[1]] & plane[at[2]] for plane in self.planes]

    def covers(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) corrected shares, and the number of trigrams of each text."""
        hits, sizes = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        for part in text_parts(letters_only(texts)):
            grams = Trigrams(part)
            np.add.at(sizes, grams.index, grams.lengths)
            for p, words in enumerate(self.languages_of(grams.keys)):
                for bit in range(min(64, len(self.names) - 64 * p)):
                    np.add.at(hits[:, 64 * p + bit], grams.index, grams.position_sums(((words >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)[grams.at]))
        return (hits / np.maximum(sizes, 1)[:, None] - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), sizes

    def decide(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and corrected share of each text."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        cover, sizes = self.covers(texts)
        best = cover.argmax(axis=1)
        top = np.clip(cover[np.arange(len(texts)), best], 0, 1)
        score = np.where(top > 0, top / np.maximum(np.clip(cover, 0, None).sum(axis=1), 1e-12), 0)
        none = sizes == 0
        return ["und" if n else self.names[b] for n, b in zip(none, best)], np.where(none, 0, score), np.where(none, 0, top)


def identify(docs: DataFrame, filters: Filters, *, text_col: str = "text") -> DataFrame:
    """docs with l_pred, l_score and l_cover."""
    docs = docs.drop(*[n for n, _ in FIELDS])
    shared = docs.sparkSession.sparkContext.broadcast((filters.names, filters.sparse))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in FIELDS]])
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*shared.value)
        for batch in slices(batches, text_at):
            lang, score, cover = own.decide([t or "" for t in batch.column(text_at).to_pylist()])
            yield with_columns(batch, [n for n, _ in FIELDS], [pa.array(lang, pa.string()), pa.array(score), pa.array(cover)])

    return docs.mapInArrow(run, schema)


def learned_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(fold(id_col, FOLDS) != HELD_OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = Filters.fit(learned_rows(docs))
    found = identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("l_pred").alias("lang_pred"), F.col("l_score").alias("score"), F.col("l_cover").alias("cover"))
