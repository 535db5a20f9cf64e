"""Document fingerprints: SimHash of weighted terms, permuted block tables for the search. SQL functions alone.

Terms are pairs of neighbouring words in lower case, each weighted by the length of its first word (WEIGHT_CAP
at most); two hashes of 64 bits vote on a fingerprint of 128 bits. Two fingerprints within a radius differ in at
most so many blocks, so they agree on all others: one table for each choice of agreeing blocks is keyed by
them and finds all candidates, whose distance is then taken in full.

The order of documents comes from ids and hashes alone: they are sorted by ranges, so each key (id and hash of the
text) learns its neighbours, and texts are shuffled once by key; half of each goes to the key before it. Keys are spread by
hashes, however ids lie.

Defined results: null text is as empty; a text without words has fingerprint zero; one word is a term of its
own; null ids come first in the order of documents, rows of one id go by a hash of their text; of rows alike in id and text
each but the last is followed by its like; a single document is its own next; an empty table gives no rows; further
columns don't matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkwright.llm.simhash import hex64, positions, vote, words_of
from linkwright.plans.staging import broadcast_if_small, staged

BITS = 128
WEIGHT_CAP = 15
RADIUS = 6
BLOCKS = 8
#: Documents whose id this divides ask which fingerprints are within RADIUS of their own.
ASKING = 100
NULL_ID = -(1 << 63)


def fingerprint(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, fp0, fp1) of the texts; keys name a row each and are of fixed width."""
    words = df.select(*keys, words_of(F.lower(F.col(text_col))).alias("words"))
    pairs = words.select(*keys, "words", F.explode(positions(F.col("words"), 2)).alias("i"))
    first, second = F.get("words", F.col("i")), F.get("words", F.col("i") + 1)
    some = F.size("words") > 0
    terms = pairs.select(*keys, F.when(some, F.xxhash64(first, second)).alias("h0"), F.when(some, F.xxhash64(F.lit(1), second, first)).alias("h1"), F.least(F.length(first), F.lit(WEIGHT_CAP)).cast("long").alias("weight"))
    return vote(terms, keys, [F.col("h0"), F.col("h1")], F.col("weight"))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The cosine of the weighted terms that the differing bits speak for, 0 where it is negative: 1 for equal fingerprints."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(3.141592653589793 / BITS)))


def document_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, fp0, fp1), one row per row of docs, without a shuffle of texts."""
    named = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    return fingerprint(named, ["rid", "doc_id"], "text").withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def _blocks(blocks: int) -> list[Column]:
    """The fingerprint in blocks of equal width, of whole bytes."""
    parts = [F.shiftrightunsigned(F.col(f"fp{i}"), s).bitwiseAND(F.lit(0xFF)) for i in range(2) for s in range(0, 64, 8)]
    size = 16 // blocks
    return [F.concat_ws(".", *[p.cast("string") for p in parts[k * size : (k + 1) * size]]) for k in range(blocks)]


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(q0, q1, fp0, fp1, bits): all distinct fingerprints within the radius of each distinct query (itself included).

    Copies are reduced to one fingerprint on both sides first. A pair turns up in each table that it agrees in and is
    kept in the first of these alone: the one named by its first agreeing blocks.
    """
    if not 0 <= radius < blocks or blocks not in (2, 4, 8, 16):
        raise ValueError("radius must be less than blocks: 2, 4, 8 or 16")
    choices = list(combinations(range(blocks), blocks - radius))

    def tables(df: DataFrame) -> DataFrame:
        parts = _blocks(blocks)
        keyed = F.array(*[F.xxhash64(F.lit(n), *[parts[k] for k in choice]) for n, choice in enumerate(choices)])
        return df.select("fp0", "fp1").distinct().select("fp0", "fp1", F.posexplode(keyed).alias("table", "key"))

    left = tables(queries).select(F.col("fp0").alias("q0"), F.col("fp1").alias("q1"), "table", "key")
    bits = distance((F.col("q0"), F.col("q1")), (F.col("fp0"), F.col("fp1")))
    width = 8 * (16 // blocks)
    differ = [F.col(f"q{k // (blocks // 2)}").bitwiseXOR(F.col(f"fp{k // (blocks // 2)}")) for k in range(blocks)]
    part = lambda k: F.shiftrightunsigned(differ[k], width * (k % (blocks // 2))).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
    agree = sum((F.when(part(k) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(blocks)), F.lit(0))
    masks = F.array(*[F.lit(sum(1 << k for k in choice)) for choice in choices])
    upto = F.array(*[F.lit((2 << choice[-1]) - 1) for choice in choices])
    first = agree.bitwiseAND(F.get(upto, F.col("table"))) == F.get(masks, F.col("table"))
    # 28 rows for each query by default; a crowded key beyond a broadcast is split by Spark's skew join, the queries' side being the small one
    return tables(fps).join(broadcast_if_small(staged(left, "asked-tables")), ["table", "key"]).withColumn("bits", bits).filter((F.col("bits") <= radius) & first).select("q0", "q1", "fp0", "fp1", "bits")


_KEY = ["known", "id", "k0", "k1"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(known, id, k0, k1, text): known is false for a null id; k0 and k1 are hashes of the text."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("id"), text)
    return rows.select("known", "id", F.xxhash64("text").alias("k0"), F.xxhash64(F.lit(1), "text").alias("k1"), "text")


def neighbours(rows: DataFrame) -> DataFrame:
    """Staged: each key of rows (of _keyed) with its number of rows, the length of its text, the keys before and after it, and the length before.

    Keys are sorted by ranges. What the ranges begin and end with is a row per range, joined back; the last is followed by the first.
    """
    keys = staged(rows.select(*_KEY, F.length("text").alias("n")).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")), "keys")
    ranged = staged(keys.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()), "ranged-keys")
    key = F.struct(*_KEY, "n")
    ends = ranged.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    parts, rest = Window.orderBy("part"), Window.unboundedPreceding
    whole = parts.rowsBetween(rest, Window.unboundedFollowing)
    ends = staged(ends.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("beyond"), F.coalesce(F.lag("last").over(parts), F.last("last").over(whole)).alias("ahead")), "range-ends")
    along = Window.partitionBy("part").orderBy(*_KEY)
    near = ranged.select("*", F.lag(key).over(along).alias("p"), F.lead(key).over(along).alias("a")).join(F.broadcast(ends), "part")
    near = near.select(*_KEY, "rows", "n", F.coalesce("p", "ahead").alias("p"), F.coalesce("a", "beyond").alias("a"))
    return staged(near.select(*_KEY, "rows", "n", *[F.col(f"p.{c}").alias(f"p_{c}") for c in (*_KEY, "n")], *[F.col(f"a.{c}").alias(f"a_{c}") for c in _KEY]), "neighbours")


def edited_texts(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(key, rows, n, text, edited, again): each text beside the edited text of its last row, and that of the rows before it (null for a single row)."""
    texts = rows if near.filter("rows > 1").limit(1).count() == 0 else rows.groupBy(*_KEY).agg(F.first("text").alias("text"))
    here = texts.join(near, _KEY)
    heads = here.select(*[F.col(f"p_{c}").alias(c) for c in _KEY], F.substring(F.col("text"), F.lit(1), F.floor(F.col("p_n") / 2).cast("int")).alias("head"))
    half = F.floor(F.col("n") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n") - half)
    again = F.when(F.col("rows") > 1, F.concat(kept, F.substring(F.col("text"), F.lit(1), half)))
    return here.select(*_KEY, "rows", "n", "text").join(heads, _KEY).select(*_KEY, "rows", "n", "text", F.concat(kept, "head").alias("edited"), again.alias("again"))


def _long_of_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, asking: int = ASKING) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp0, fp1, edited0, edited1, near_edited, near_next, n_within).

    n_within: for documents whose id is divisible by asking, how many rows have a fingerprint within radius bits, its own
    included; null for others. The digest travels through the votes as four numbers, so that their keys are of fixed width.
    """
    rows = _keyed(docs, id_col, text_col)
    near = neighbours(rows)
    texts = edited_texts(rows, near)
    digest = F.sha2(F.col("body").cast("binary"), 256)
    body = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("body"))
    each = F.array(body(0, "text"), body(1, "edited"), body(2, "again"))
    sides = texts.select(*_KEY, "rows", "n", F.explode(F.filter(each, lambda x: x["body"].isNotNull())).alias("of"))
    # what the next explode carries along is read from these structs, not computed anew for each term
    sides = sides.select(*_KEY, "rows", "n", "of.side", "of.body")
    hexed = F.when(F.col("side") == 0, F.lit(None).cast("string")).otherwise(digest)
    parts = sides.select(*_KEY, "rows", "n", F.struct("side", "body", *[_long_of_hex(F.substring(hexed, 1 + 16 * k, 16)).alias(f"d{k}") for k in range(4)]).alias("of"))
    parts = parts.select(*_KEY, "rows", "n", F.explode(F.array("of")).alias("of")).select(*_KEY, "rows", "n", "of.*")
    voted = fingerprint(parts, [*_KEY, "rows", "n", "side", *[f"d{k}" for k in range(4)]], "body")
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    names = {0: "own", 1: "edited", 2: "again"}
    one = voted.groupBy(*_KEY, "rows", "n").agg(*[at(side, f"fp{k}").alias(f"{name}{k}") for side, name in names.items() for k in range(2)], *[at(side, f"d{k}").alias(f"{name}_d{k}") for side, name in names.items() if side for k in range(4)])
    one = staged(one, "compared")
    after = one.select(*[F.col(c).alias(f"a_{c}") for c in _KEY], F.col("own0").alias("next0"), F.col("own1").alias("next1"))
    both = one.join(near.select(*_KEY, *[f"a_{c}" for c in _KEY]), _KEY).join(after, [f"a_{c}" for c in _KEY])
    # of rows alike in id and text all but one are followed by their like
    place = F.explode(F.when(F.col("rows") > 1, F.array(F.struct(F.lit(False).alias("last"), (F.col("rows") - 1).alias("times")), F.struct(F.lit(True).alias("last"), F.lit(1).cast("long").alias("times")))).otherwise(F.array(F.struct(F.lit(True).alias("last"), F.lit(1).cast("long").alias("times")))))
    both = both.select("*", place.alias("copy")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copy.times"))))
    pick = lambda last, other: F.when(F.col("copy.last"), F.col(last)).otherwise(F.col(other))
    out = both.select("known", "id", F.col("n").cast("long").alias("n_chars"), F.col("own0").alias("fp0"), F.col("own1").alias("fp1"), *[pick(f"edited{k}", f"again{k}").alias(f"edited{k}") for k in range(2)], *[pick(f"edited_d{k}", f"again_d{k}").alias(f"d{k}") for k in range(4)], *[pick(f"next{k}", f"own{k}").alias(f"next{k}") for k in range(2)])
    own, edit, following = ((F.col(f"{n}0"), F.col(f"{n}1")) for n in ("fp", "edited", "next"))
    asks = F.col("known") & (F.pmod(F.col("id").cast("long"), F.lit(asking)) == 0)
    counts = one.groupBy("own0", "own1").agg(F.sum("rows").alias("rows"))
    found = within_radius(one.filter(asks).select(F.col("own0").alias("fp0"), F.col("own1").alias("fp1")), counts.select(F.col("own0").alias("fp0"), F.col("own1").alias("fp1")), radius)
    total = staged(found.join(counts, (F.col("fp0") == F.col("own0")) & (F.col("fp1") == F.col("own1"))).groupBy("q0", "q1").agg(F.sum("rows").alias("n_within")), "within")
    out = out.join(broadcast_if_small(total), (F.col("fp0") == F.col("q0")) & (F.col("fp1") == F.col("q1")), "left")
    return out.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_chars", F.concat(*[hex64(F.col(f"d{k}")) for k in range(4)]).alias("edited_sha256"), "fp0", "fp1", "edited0", "edited1",
        likeness(own, edit).alias("near_edited"), likeness(own, following).alias("near_next"), F.when(asks, F.col("n_within")).alias("n_within"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = compare_with_edits(docs)
    hexed = lambda n: F.concat(hex64(F.col(f"{n}1")), hex64(F.col(f"{n}0")))
    return found.select("doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"), "near_edited", "near_next", "n_within")
