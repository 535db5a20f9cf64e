"""Quality rules: text statistics and bands of n-gram perplexity.

The model is a modified Kneser-Ney model of character trigrams for each language, counted by Spark over all
documents: tasks reduce their texts to distinct trigrams, and counts, continuation counts, discounts,
probabilities and back-off weights follow by joins and aggregates, each written out before the next one starts. The
finished table names every n-gram of every order by a hash of 64 bits. Up to BROADCAST_ENTRIES rows it travels to the
executors as a sorted array of hashes beside their values; a larger one stays a table, which documents' trigrams
are joined with (score). Both give the same scores, and no n-gram is left out of either.

A document is rejected if its mean surprise per character lies outside of its language's band: the
quartiles, extended by FENCE times their distance (MIN_SPREAD at least), and by SHORT / sqrt(characters),
as short texts scatter. Quartiles are exact to half of BIN and taken over all distinct texts, each counted by its
characters up to BAND_CHARS, so that neither copies nor scraps draw the band.

Defined results: null text has no words and is a failure of the base rules (n_words < 20), as is an empty
one; a null language is a language of its own; repeated rows each get their row; an empty table gives no
rows; further columns are carried along (existing q_* columns are replaced). A long text is hashed in blocks and scored in
parts: beside the text itself, memory is some 150 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkwright.llm.batches import Counts, Trigrams, by_label, fresh, mixed, slices, text_parts, with_columns, xxhash_longs
from linkwright.plans.staging import broadcast_if_small, staged

#: Rows of a model that every executor may hold, at 12 bytes each.
BROADCAST_ENTRIES = 1 << 22
FENCE, MIN_SPREAD, SHORT = 2.0, 0.02, 1.5
BAND_CHARS = 200
BIN = 0.001
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
WINDOW = 8
_ORDERS = {"tri": 1, "bi": 2, "uni": 3, "back2": 4, "back1": 5, "none": 6}
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)

BASE_FIELDS = [(n, T.LongType()) for n in ("q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words")]
SCORE_FIELDS = [("q_chars", T.LongType()), ("q_surprise", T.DoubleType())]


#: Values that are hashed at once.
BLOCK = 1 << 16


class _Powers:
    """Powers of the base and of its inverse up to a block; made once in each process, and left behind when code travels."""

    def __init__(self):
        self.up = self.down = None

    def __reduce__(self):
        return (_Powers, ())

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, b, np.uint64)])) for b in (_U(_BASE), _U(_INVERSE)))
        return self.up, self.down


_POWERS = _Powers()


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], the same for the same content and length wherever it stands. starts and ends ascend.

    values: hashes, or bytes, which then count by their _VALUE. Prefix sums are kept at starts and ends alone.
    """
    up, down = _POWERS.get()
    first, last = np.empty(len(starts), np.uint64), np.empty(len(ends), np.uint64)
    shift = np.empty(len(starts), np.uint64)
    total, power, inverse = _U(0), 1, 1
    with np.errstate(over="ignore"):
        for at in range(0, len(values) + 1, BLOCK):
            block = values[at : at + BLOCK]
            block = _VALUE[block] if block.dtype == np.uint8 else block
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(block * up[: len(block)], dtype=np.uint64)]) * _U(power) + total
            for places, out in ((starts, first), (ends, last)):
                low, high = np.searchsorted(places, [at, at + BLOCK])
                out[low:high] = prefix[places[low:high] - at]
                if places is starts:
                    shift[low:high] = down[places[low:high] - at] * _U(inverse)
            total = prefix[-1]
            power, inverse = power * int(up[BLOCK]) % (1 << 64), inverse * int(down[BLOCK]) % (1 << 64)
        return mixed((last - first) * shift + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def _repeated(keys: np.ndarray, later: bool) -> np.ndarray:
    """Which keys stand more than once; with later, which stand somewhere before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if not later:
        out[order[:-1][same]] = True
    return out


def base_statistics(texts: Sequence[str]) -> np.ndarray:
    """(5, n): words, code points in words, symbols, repeated lines, words in repeated windows of 8 words."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    doc_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    word = ~_SPACE[data]
    edges = np.flatnonzero(np.concatenate([[False], word]) != np.concatenate([word, [False]]))
    starts, ends = edges[::2], edges[1::2]
    word_doc = doc_of(starts)
    out = np.zeros((5, n), np.int64)
    out[0] = np.bincount(word_doc, minlength=n)

    def by_doc(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, offsets[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)

    out[1] = by_doc(word & ((data & 0xC0) != 0x80))
    out[2] = by_doc(_SYMBOL[data])
    line_ends = np.flatnonzero(data == 10)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_doc = doc_of(line_starts)
    apart = lambda h, doc: mixed(h + doc.astype(np.uint64) * _U(0xBF58476D1CE4E5B9))
    again = _repeated(apart(_range_hashes(data, line_starts, line_ends), line_doc), later=True)
    out[3] = np.bincount(line_doc[again], minlength=n)
    if len(starts) >= WINDOW:
        first = np.arange(len(starts) - WINDOW + 1)
        first = first[word_doc[: len(first)] == word_doc[WINDOW - 1 :]]
        windows = _range_hashes(_range_hashes(data, starts, ends), first, first + WINDOW)
        begin = first[_repeated(apart(windows, word_doc[first]), later=False)]
        cover = np.cumsum(np.bincount(begin, minlength=len(starts) + WINDOW) - np.bincount(begin + WINDOW, minlength=len(starts) + WINDOW))[: len(starts)] > 0
        out[4] = np.bincount(word_doc[cover], minlength=n)
    return out


def _seed(order: str, lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), int(xxhash_longs(np.array([_ORDERS[order]]), 42)[0]))


def _slot(order: str, lang: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(_ORDERS[order]).cast("long"), lang, key)


def count_trigrams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Staged (lang, key, n) over all documents; a key packs three code points in 21 bits each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in slices(batches, 1):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, rows in by_label(langs).items():
                for part in text_parts([texts[i] for i in rows]):
                    grams = Trigrams(part)
                    counts.add(lang, grams.keys, grams.counts)
        yield from counts.batches()

    pairs = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    return staged(pairs.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "trigrams")


def _discounts(orders: dict[str, DataFrame]) -> DataFrame:
    """Staged, a row per language: d1, d2, d3 of each order (as <order>_d1, ...), and of the unigrams the floor below them and its weight."""
    out = None
    for name, counts in orders.items():
        n = [F.sum((F.col("n") == k).cast("double")) for k in range(1, 5)]
        tally = counts.groupBy("lang").agg(*[x.alias(f"n{k + 1}") for k, x in enumerate(n)], F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"), *[F.sum((F.col("n") >= 3).cast("double")).alias("more")])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        known = tally.select("*", *[F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.least(F.lit(k - 0.1), F.greatest(F.lit(0.1), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(0.5 * k)).alias(f"{name}_d{k}") for k in (1, 2, 3)])
        if name == "uni":
            gamma = (F.col("n1") * F.col("uni_d1") + F.col("n2") * F.col("uni_d2") + F.col("more") * F.col("uni_d3")) / F.col("total")
            known = known.select("*", F.col("total").alias("uni_total"), (gamma / (F.col("kinds") + 1)).alias("floor"))
        known = known.drop("n1", "n2", "n3", "n4", "kinds", "total", "more")
        out = known if out is None else out.join(known, "lang")
    return staged(out, "discounts")


def _smoothed(counts: DataFrame, order: str, discounts: DataFrame, context: str, lower: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(lang, key, n) -> staged (lang, key, value) probabilities and staged (lang, context, gamma). lower: (lang, key, value) of the order below."""
    d = [F.col(f"{order}_d{k}") for k in (1, 2, 3)]
    given = counts.join(broadcast_if_small(discounts.select("lang", *d)), "lang")
    discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    given = given.select("lang", "key", F.expr(context).alias("context"), "n", discount.alias("discount"))
    totals = staged(given.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("gamma")), f"{order}-contexts")
    share = given.join(totals, ["lang", "context"]).select("lang", "key", ((F.col("n") - F.col("discount")) / F.col("total")).alias("share"), "gamma", key.alias("below"))
    below = lower.select("lang", F.col("key").alias("below"), F.col("value").alias("less"))
    out = share.join(below, ["lang", "below"]).select("lang", "key", (F.col("share") + F.col("gamma") * F.col("less")).alias("value"))
    return staged(out, f"{order}-probabilities"), totals.select("lang", F.col("context").alias("key"), F.col("gamma").alias("value"))


def kneser_ney(trigrams: DataFrame) -> DataFrame:
    """Staged (slot, value): log probabilities and log back-off weights of all orders by the hash of order, language and n-gram.

    trigrams: staged (lang, key, n). An order's counts, contexts and probabilities are each a table of their own, so no plan
    holds more than one of these steps. Discounts are one row per language; all other joins go by the n-grams' own keys.
    """
    c, bc = F.col("key").bitwiseAND(F.lit((1 << 21) - 1)), F.col("key").bitwiseAND(F.lit((1 << 42) - 1))
    bi = staged(trigrams.groupBy("lang", bc.alias("key")).agg(F.count(F.lit(1)).alias("n")), "bigrams")
    uni = staged(bi.groupBy("lang", c.alias("key")).agg(F.count(F.lit(1)).alias("n")), "unigrams")
    discounts = _discounts({"tri": trigrams, "bi": bi, "uni": uni})
    d = [F.col(f"uni_d{k}") for k in (1, 2, 3)]
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    p1 = uni.join(broadcast_if_small(discounts), "lang").select("lang", "key", ((F.col("n") - cut) / F.col("uni_total") + F.col("floor")).alias("value"))
    p1 = staged(p1, "uni-probabilities")
    p2, g1 = _smoothed(bi, "bi", discounts, "shiftright(key, 21)", p1, c)
    p3, g2 = _smoothed(trigrams, "tri", discounts, "shiftright(key, 21)", p2, bc)
    none = discounts.select("lang", F.lit(0).cast("long").alias("key"), F.col("floor").alias("value"))
    out = None
    for order, df in (("tri", p3), ("bi", p2), ("uni", p1), ("back2", g2), ("back1", g1), ("none", none)):
        own = df.select(_slot(order, F.col("lang"), F.col("key")).alias("slot"), F.log("value").cast("float").alias("value"))
        out = own if out is None else out.unionByName(own)
    return staged(out, "kneser-ney")


class Model:
    """Sorted hashes (uint64) and their values (float32)."""

    def __init__(self, slots: np.ndarray, values: np.ndarray):
        if len(slots) and (slots[1:] < slots[:-1]).any():
            order = np.argsort(slots)
            slots, values = slots[order], values[order]
        self.slots, self.values = slots.astype(np.uint64, copy=False), values.astype(np.float32, copy=False)

    @classmethod
    def of(cls, table: DataFrame) -> Model:
        """The arrays of a table that was found to be small."""
        rows = table.toArrow()
        return cls(rows.column("slot").to_numpy().view(np.uint64), rows.column("value").to_numpy())

    def _find(self, order: str, lang: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        slots = xxhash_longs(keys, _seed(order, lang))
        at = np.minimum(np.searchsorted(self.slots, slots), len(self.slots) - 1)
        return self.slots[at] == slots, self.values[at]

    def log_probabilities(self, lang: str, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = np.zeros(len(c), np.float64)
        rest = np.arange(len(c))
        for order, key, back, context in (("tri", lambda r: (a[r] << 42) | (b[r] << 21) | c[r], "back2", lambda r: (a[r] << 21) | b[r]), ("bi", lambda r: (b[r] << 21) | c[r], "back1", lambda r: b[r]), ("uni", lambda r: c[r], None, None)):
            hit, value = self._find(order, lang, key(rest))
            out[rest[hit]] += value[hit]
            rest = rest[~hit]
            if back and len(rest):
                known, value = self._find(back, lang, context(rest))
                out[rest[known]] += value[known]
        if len(rest):
            known, value = self._find("none", lang, np.zeros(1, np.int64))
            out[rest] += value[0] if known[0] else np.log(1 / 0x110000)
        return out

    def surprise(self, lang: str, texts: Sequence[str]) -> np.ndarray:
        """Sum of -log p over the characters of each text."""
        total = np.zeros(len(texts))
        for part in text_parts(texts):
            grams = Trigrams(part)
            np.add.at(total, grams.index, -grams.sums(self.log_probabilities(lang, grams.a, grams.b, grams.c)))
        return total


def score(docs: DataFrame, table: DataFrame, *, lang_col: str = "lang", text_col: str = "text", keep_text: bool = True, entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Staged docs (without the text unless keep_text) with q_text (a hash), q_words, q_word_chars, q_symbols, q_dup_lines, q_repeat_words, q_chars, q_surprise (mean per character, null without any).

    table: of kneser_ney. One with more than so many entries stays where it is: the trigrams of each text meet it by joins.
    """
    small = table.limit(entries + 1).count() <= entries
    model = Model.of(table) if small else None
    shared = docs.sparkSession.sparkContext.broadcast((model.slots, model.values) if model else None)
    fields = BASE_FIELDS + SCORE_FIELDS
    docs = docs.drop("q_text", *[n for n, _ in fields]).withColumn("q_text", F.xxhash64(text_col))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    lang_at, text_at = docs.columns.index(lang_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value) if shared.value else None
        for batch in slices(batches, text_at, 1 << 20):
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            langs = [v or "" for v in batch.column(lang_at).to_pylist()]
            base = base_statistics(texts)
            chars = np.array([len(t) for t in texts])
            surprise = np.zeros(len(texts))
            for lang, rows in by_label(langs).items() if own else ():
                surprise[rows] = own.surprise(lang, [texts[i] for i in rows])
            mean = pa.array(surprise / np.maximum(chars, 1), mask=chars == 0)
            yield with_columns(batch, [n for n, _ in fields], [*map(pa.array, base), pa.array(chars), mean])

    found = docs.mapInArrow(run, schema)
    if small:
        return staged(found if keep_text else found.drop(text_col), "scored")
    row = fresh("q_row", docs.columns)
    found = staged(found.withColumn(row, F.monotonically_increasing_id()), "unscored")
    asked = found.select(F.col(row).alias("row"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    total = surprise_by_joins(asked, table).withColumnRenamed("row", row)
    found = found.join(total, row, "left").withColumn("q_surprise", F.when(F.col("q_chars") > 0, F.col("total") / F.col("q_chars"))).drop(row, "total")
    return staged(found if keep_text else found.drop(text_col), "scored")


def surprise_by_joins(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(row, lang, text) -> (row, total): the sum of -log p over the characters, as Model.surprise, for a model of any size.

    Each trigram that occurs is looked up once, in all orders at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            row, langs, texts = (batch.column(k).to_pylist() for k in range(3))
            for part in text_parts([t or "" for t in texts]):
                grams = Trigrams(part)
                piece = np.repeat(np.arange(len(grams.index)), grams.lengths)
                seen, n = np.unique(piece * np.int64(len(grams.keys)) + grams.at, return_counts=True)
                of, key = grams.index[seen // len(grams.keys)], grams.keys[seen % len(grams.keys)]
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for i in of], pa.int64()), pa.array([langs[i] for i in of], pa.string()), pa.array(key), pa.array(n)], ["row", "lang", "key", "n"])

    counted = staged(rows.mapInArrow(count, "row long, lang string, key long, n long"), "text-trigrams")
    low = lambda bits: F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    keys = {"tri": F.col("key"), "back2": F.shiftright("key", 21), "bi": low(42), "back1": F.shiftright(low(42), 21), "uni": low(21), "none": F.lit(0).cast("long")}
    each = F.explode(F.array(*[F.struct(F.lit(order).alias("order"), _slot(order, F.col("lang"), key).alias("slot")) for order, key in keys.items()])).alias("of")
    asked = counted.select("lang", "key").distinct().select("lang", "key", each).select("lang", "key", "of.order", "of.slot")
    value = {order: F.max(F.when(F.col("order") == order, F.col("value"))) for order in keys}
    looked = asked.join(table, "slot", "left").groupBy("lang", "key").agg(*[v.alias(order) for order, v in value.items()])
    back = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    lowest = F.coalesce("uni", "none", F.lit(float(np.log(1 / 0x110000))))
    logp = F.coalesce("tri", back("back2") + F.coalesce("bi", back("back1") + lowest)).cast("double")
    return counted.join(looked.select("lang", "key", logp.alias("p")), ["lang", "key"]).groupBy("row").agg((-F.sum(F.col("n") * F.col("p"))).alias("total"))


def bands(scored: DataFrame, lang_col: str = "lang") -> DataFrame:
    """(__lang, q_low, q_high) from the weights of distinct texts by language and bin."""
    lang = F.coalesce(F.col(lang_col), F.lit("")).alias("__lang")
    once = scored.filter("q_chars > 0").groupBy(lang, "q_text", "q_chars").agg(F.min("q_surprise").alias("q_surprise"))
    bins = once.groupBy("__lang", F.floor(F.col("q_surprise") / BIN).alias("bin")).agg(F.sum(F.least("q_chars", F.lit(BAND_CHARS))).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("__lang").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("__lang"))
    placed = bins.select("__lang", ((F.col("bin") + 0.5) * BIN).alias("at"), upto.alias("upto"), total.alias("total"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("at")))
    two = placed.groupBy("__lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_SPREAD)) * FENCE
    return two.select("__lang", (F.col("q1") - spread).alias("q_low"), (F.col("q3") + spread).alias("q_high"))


def judge(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", keep_text: bool = True, entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """docs with the statistics, q_low and q_high of their language, q_base_failed and q_kept.

    Scores are staged with the columns of docs (without the text unless keep_text), so texts are scored once.
    """
    docs = docs.drop("q_low", "q_high", "q_base_failed", "q_kept")
    table = kneser_ney(count_trigrams(docs, lang_col, text_col))
    scored = score(docs, table, lang_col=lang_col, text_col=text_col, keep_text=keep_text, entries=entries)
    own = fresh("q_lang", scored.columns)
    limits = staged(bands(scored, lang_col).withColumnRenamed("__lang", own), "bands")
    out = scored.join(broadcast_if_small(limits), F.coalesce(F.col(lang_col), F.lit("")) == F.col(own), "left").drop(own, "q_text")
    failed = (F.col("q_words") < MIN_WORDS) | (100 * F.col("q_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_words"))
    slack = SHORT / F.sqrt(F.greatest(F.col("q_chars"), F.lit(1)))
    outside = (F.col("q_surprise") < F.col("q_low") - slack) | (F.col("q_surprise") > F.col("q_high") + slack)
    return out.withColumn("q_base_failed", failed).withColumn("q_kept", ~failed & ~F.coalesce(outside, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs, keep_text=False).select(
        "doc_id",
        F.col("q_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
        F.exp("q_surprise").alias("perplexity"),
        F.exp("q_low").alias("lowest"),
        F.exp("q_high").alias("highest"),
    )
