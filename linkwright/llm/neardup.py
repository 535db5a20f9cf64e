"""Near duplicates by SimHash and multi-index hashing.

Fingerprints: XXH64 (seed 42) of 3-word shingles, a bit set if over half of the hashes have it. Links: at
most 3 differing bits. Of two halves of 32 bits, one then differs in one bit at most, so each distinct
fingerprint is filed under each half and under every half one bit above it (a ball of radius 1; of two
halves that differ in a bit, one lacks it). Members of a bucket are compared in full. A bucket of more than
LIMIT members is dealt out again by the halves of its other half, and once more, so that no case is
dropped and no task holds an unbounded group. A bucket yields its links where small, else a spanning
forest of them, so rows grow with the members, not with their pairs. Components come from alternating
large-star and small-star passes over distinct fingerprints.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; texts of one
or two words have one shingle; repeated rows each get their row; a null doc_id never names a component
(component_id is null if all of them are null); an empty table gives no rows; further columns don't matter.

keep_similar is the pipeline's stage: texts are linked if the Jaccard similarity of their sets of 5-word shingles is
4/5 or more, exactly. SimHash and multi-index hashing as above find the first links, which whole sets verify; as 64 bits can't tell
such a similarity (at 4/5 some ten of them differ), what they miss is found by shingles: in one order of all shingles (those that a sample
finds in many texts last), two such sets share one of the first n - ceil(4n/5) + 1 shingles of each, which are the tables that
texts are filed in. Texts that meet there are candidates: first each with a few of its buckets, then, in buckets whose members
aren't yet all connected, those of different components. The Hamming distance of their sketches, which never exceeds
that of the sets, rules most of them out; the others are verified over whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from linkwright.llm.batches import apart, mixed, slices, with_columns
from linkwright.llm.quality import _SPACE, _range_hashes
from linkwright.llm.simhash import LOW, ascii_lower, hex64, positions, vote, words_of
from linkwright.plans.staging import broadcast_if_small, discard, staged

SHINGLE = 3
RADIUS = 3
#: Members of a bucket that are compared in one go.
LIMIT = 2048
#: Buckets of so many members yield all their links, larger ones a spanning forest.
SMALL = 6
#: Words of a shingle in keep_similar.
WIDTH = 5
#: Of one document in SAMPLE shingles are counted; those found OFTEN there, MOST at most, come last in the order of shingles.
SAMPLE, OFTEN, MOST = 16, 8, 1 << 18
#: Times that texts are compared with few others before all pairs that are left.
ROUNDS = 2
#: Members of a crowded bucket that one task compares with as many others.
CHUNK = 512
#: Bits of the smallest sketch of a set, each the parity of the shingles that fall on it: sets differ in as many shingles as their sketches do in bits, or more.
SKETCH = 256


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, fp): one row per row of docs; no shuffle of texts, each row's votes are summed in its own task."""
    words = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words_of(ascii_lower(F.col(text_col))).alias("words"))
    shingles = words.select("rid", "doc_id", "words", F.explode(positions(F.col("words"), width)).alias("i"))
    text = F.concat_ws(" ", *[F.get("words", F.col("i") + k) for k in range(width)])
    hashed = shingles.select("rid", "doc_id", F.when(F.size("words") > 0, F.xxhash64(text)).alias("h"))
    return vote(hashed, ["rid", "doc_id"], [F.col("h")], F.lit(1).cast("long")).withColumnRenamed("fp0", "fp")


def _deal(rows: DataFrame, prefix: Column, halves: Column, bits: int) -> DataFrame:
    """(key, fp): each row under both halves (an array of two) and under each half with one more bit set. The key is prefix, place, half."""
    placed = rows.select("fp", prefix.alias("prefix"), F.posexplode(halves).alias("place", "half"))
    ball = F.explode(F.concat(F.array(F.col("half")), F.filter(F.transform(F.array(*[F.lit(1 << b) for b in range(bits)]), lambda bit: F.col("half").bitwiseOR(bit)), lambda h: h != F.col("half"))))
    return placed.select(((F.col("prefix") * 2 + F.col("place")) * (1 << bits)).alias("prefix"), ball.alias("half"), "fp").select((F.col("prefix") + F.col("half")).alias("key"), "fp")


def _halves(value: Column, bits: int) -> Column:
    return F.array(F.shiftrightunsigned(value, bits).bitwiseAND(F.lit((1 << bits) - 1)), value.bitwiseAND(F.lit((1 << bits) - 1)))


def _forest(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the first member of its component, by blocks of rows."""
    n, label = len(f), np.arange(len(f))
    step = max(1, (1 << 21) // n)
    while True:
        new = label.copy()
        for at in range(0, n, step):
            near = np.bitwise_count(f[at : at + step, None] ^ f[None, :]) <= radius
            new[at : at + step] = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return f[moved], f[label[moved]]


def _links_of_runs(key: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    for n in range(2, SMALL + 1):
        members = f[starts[lengths == n][:, None] + np.arange(n)]
        for i in range(n):
            for j in range(i + 1, n):
                near = np.bitwise_count(members[:, i] ^ members[:, j]) <= radius
                a.append(members[near, j])
                b.append(members[near, i])
    for at in np.flatnonzero(lengths > SMALL):
        x, y = _forest(f[starts[at] : starts[at] + lengths[at]], radius)
        a.append(x)
        b.append(y)
    return np.concatenate(a or [f[:0]]), np.concatenate(b or [f[:0]])


def _matcher(radius: int, limit: int | None):
    """Rows (key, fp) sorted by key -> (crowded, x, y): links, or the (key, fp) of buckets over the limit."""

    def rows(crowded: bool, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), crowded)), pa.array(x.astype(np.int64)), pa.array(y.view(np.int64))], ["crowded", "x", "y"])

    def links(key: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key):
            x, y = _links_of_runs(key, f, radius)
            pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1).view(np.int64), axis=0) if len(x) else np.empty((0, 2), np.int64)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]] if len(pairs) else pairs
            if len(pairs):
                yield rows(False, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]).view(np.uint64))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, crowd = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if crowd is not None:
                n = int(np.searchsorted(k, crowd, "right"))
                if n:
                    yield rows(True, k[:n], f[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    held_k, held_f = k, f
                    continue
                crowd = None
            last = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
            done_k, done_f = k[:last], f[:last]
            if limit is not None and len(done_k) > limit:
                starts = np.flatnonzero(np.r_[True, done_k[1:] != done_k[:-1]])
                lengths = np.diff(np.r_[starts, len(done_k)])
                over = np.repeat(lengths > limit, lengths)
                if over.any():
                    yield rows(True, done_k[over], done_f[over])
                    done_k, done_f = done_k[~over], done_f[~over]
            yield from links(done_k, done_f)
            held_k, held_f = k[last:], f[last:]
            if limit is not None and len(held_k) > limit:
                crowd = held_k[0]
                yield rows(True, held_k, held_f)
                held_k, held_f = held_k[:0], held_f[:0]
        yield from links(held_k, held_f)

    return match


def near_links(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Staged (a, b) that connect exactly what links at radius (up to 3) bits connect; fps: distinct (fp)."""
    if not 0 <= radius <= 3:
        raise ValueError("the balls of radius 1 around halves find links up to radius 3")
    out, rest = None, [F.lit(0).cast("long"), _halves(F.col("fp"), 32), 32]
    rows = fps.select("fp")
    for level in range(3):
        dealt = _deal(rows, *rest).distinct() if level else _deal(rows, *rest)
        found = staged(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_matcher(radius, limit if level < 2 else None), "crowded boolean, x long, y long"), f"links-{level}")
        edges = found.filter("NOT crowded").select(F.col("x").alias("a"), F.col("y").alias("b"))
        out = edges if out is None else out.unionByName(edges)
        crowded = found.filter("crowded").select(F.col("x").alias("key"), F.col("y").alias("fp"))
        if level == 2 or crowded.limit(1).count() == 0:
            break
        # what is left of the fingerprint: the half that the key doesn't hold, then the half of that
        place = F.shiftrightunsigned(F.col("key"), 32).bitwiseAND(F.lit(1))
        other = F.when(place == 0, F.col("fp").bitwiseAND(F.lit(LOW))).otherwise(F.shiftrightunsigned(F.col("fp"), 32))
        if level == 1:
            first = F.shiftrightunsigned(F.col("key"), 49).bitwiseAND(F.lit(1))
            other = F.when(first == 0, F.col("fp").bitwiseAND(F.lit(LOW))).otherwise(F.shiftrightunsigned(F.col("fp"), 32))
            second = F.shiftrightunsigned(F.col("key"), 16).bitwiseAND(F.lit(1))
            other = F.when(second == 0, other.bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned(other, 16))
        rest = [F.col("key"), _halves(other, 16 >> level), 16 >> level]
        rows = crowded
    return staged(out.distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """Staged (a, b): every node but the least of its component, with that least node. Alternates large-star and small-star."""

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, seen = edges, mark(edges)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        centre = least(both).select("u", F.least("m", "u").alias("m"))
        large = staged(both.filter("v > u").join(centre, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        centre = least(down)
        small = down.join(centre, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(centre.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = staged(small.distinct(), "small-star")
        discard(large)
        if now is not edges:
            discard(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    return now


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(rid, doc_id, fp, component_id), a row per row of docs. Copies are one fingerprint throughout; they meet their component in the last join."""
    found = staged(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    return _with_component(found, distinct, components(near_links(distinct, radius, limit))).select("rid", "doc_id", "fp", "component_id")


def _with_component(found: DataFrame, distinct: DataFrame, label: DataFrame) -> DataFrame:
    """found (doc_id, fp, ...) with component_id, the least id of the component; distinct: (fp, first), label: of components."""
    nodes = label.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(label.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    linked = nodes.join(distinct, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    joined = linked.join(least, "root").select("fp", "component_id")
    of_fp = distinct.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # staged, so that both sides of the join come from shuffles and Spark can split the rows of a fingerprint with many copies
    return found.join(broadcast_if_small(staged(of_fp, "component-of-fingerprint")), "fp")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of its least id; of repeated rows with that id, any one, whole."""
    return _least_of_each(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, radius=radius), id_col)


def _least_of_each(docs: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    own, back = apart(docs, {id_col})
    kept = staged(groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("kept_rows")), "kept")
    # as many ids as documents: never a side to broadcast, whatever the size of the corpus
    out = own.join(kept.hint("merge"), F.col(id_col).eqNullSafe(F.col("kept_id")))
    once = back(out.filter("kept_rows = 1"))
    if kept.filter("kept_rows > 1").limit(1).count() == 0:
        return once
    return once.unionByName(back(out.filter("kept_rows > 1").dropDuplicates(["kept_id"])))


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def shingle_sets(texts: list[str], hot: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (63-bit hashes) of all texts, text by text in the order of shingles, and how many each text has.

    hot: the shingles that come last, in their order; all others come before them by hash.
    """
    n = len(texts)
    raw = [_lowered(t) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~_SPACE[data], [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    words = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=n)
    first_word = np.cumsum(words) - words
    count = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    of = np.repeat(np.arange(n), count)
    begin = first_word[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    token = _range_hashes(_range_hashes(data, starts, ends), begin, begin + np.minimum(words, width)[of]) >> np.uint64(1)
    key = token.copy()
    if len(hot):
        by_hash = np.argsort(hot)
        at = np.minimum(np.searchsorted(hot[by_hash], token), len(hot) - 1)
        last = hot[by_hash][at] == token
        key[last] = np.uint64(1 << 63) + by_hash[at[last]].astype(np.uint64)
    order = np.lexsort((key, of))
    token, of = token[order], of[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
    return token[new], np.bincount(of[new], minlength=n)


def _sketches(token: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """The sketch of each set: the least power of two of bits that is twice the size of the set or more (SKETCH at least)."""
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    at = np.repeat(begin, n) + (token & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(bits // 64)]), pa.int32()), pa.array(np.packbits(parity).view(np.int64)))


def _sets(docs: DataFrame, id_col: str, text_col: str, hot: np.ndarray, whole: bool) -> DataFrame:
    """(doc_id, fp, n, shingles, sketch): a hash of each text's set, its size, its first shingles and its sketch, or all shingles and no sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in slices(batches, 1, 1 << 20):
            token, n = shingle_sets([t or "" for t in batch.column(1).to_pylist()], last)
            ends = np.cumsum(n)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(token), dtype=np.uint64)])
            fp = mixed(total[ends] - total[ends - n] + n.astype(np.uint64))
            size = n if whole else np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
            place = np.arange(len(token)) - np.repeat(ends - n, n)
            held = token[place < np.repeat(size, n)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(held))
            sketches = pa.nulls(len(n), pa.list_(pa.int64())) if whole else _sketches(token, n)
            yield with_columns(batch.select([0]), ["fp", "n", "shingles", "sketch"], [pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64)), lists, sketches])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("shingles", "sketch")]])
    return narrow.mapInArrow(run, schema)


def _frequent(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, DataFrame]:
    """Shingles that many texts of a sample have, the rarest first, and (token) of them. Which they are bears on the cost alone."""
    some = docs.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.lit(SAMPLE)) == 0)
    sets = _sets(some, id_col, text_col, np.empty(0, np.uint64), True).dropDuplicates(["fp"])
    often = sets.select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    found = staged(often.orderBy(F.desc("n"), "token").limit(MOST), "frequent-shingles")
    return found.orderBy("n", "token").toArrow().column("token").to_numpy().astype(np.int64).view(np.uint64), found.select("token")


def _may_share(n: Column, place: Column, m: Column, other: Column) -> Column:
    """Whether two sets can be 4/5 alike if what stands at these places is the first shingle they share: all before it isn't shared."""
    return 9 * F.least(n - place, m - other) >= 4 * (n + m)


def _postings(owners: DataFrame, hot: DataFrame) -> DataFrame:
    """Staged (token, fp, n, place, size): the first shingles of each set that other sets have among theirs, with the number of these sets.

    Frequent shingles are counted with partial sums and get their counts back by a broadcast (MOST rows at most): any number of sets may have one.
    """
    posted = owners.select(F.posexplode("shingles").alias("place", "token"), "fp", "n")
    common = posted.join(F.broadcast(hot), "token")
    counted = staged(common.groupBy("token").agg(F.count(F.lit(1)).alias("size")), "frequent-postings")
    common = common.join(F.broadcast(counted), "token").select("token", "fp", "n", "place", "size")
    rare = posted.join(F.broadcast(hot), "token", "left_anti").select("token", "fp", "n", "place", F.count(F.lit(1)).over(Window.partitionBy("token")).alias("size"))
    return staged(rare.unionByName(common).filter("size > 1"), "postings")


def _open(posted: DataFrame, label: DataFrame) -> DataFrame:
    """Staged postings of the shingles whose sets aren't all in one component, with their roots. label: (a, b), of components."""
    nodes = label.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    placed = posted.drop("root").join(nodes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    split = placed.groupBy("token").agg((F.min("root") != F.max("root")).alias("open")).filter("open").select("token")
    return staged(placed.join(split, "token").select("token", "fp", "n", "place", "size", "root"), "open-postings")


def _to_centres(placed: DataFrame, k: int) -> DataFrame:
    """(a, b): each set with two others of each of its buckets: the one that has the shingle first, and one drawn by a hash of k.

    The fewer rare shingles a set has of its own, the earlier come those that it shares: the first set of a bucket is a typical one.
    """
    member = F.struct("fp", "n", "place", "root")
    centres = placed.groupBy("token").agg(F.min(F.struct("place", "n", "fp", member.alias("x"))).alias("first"), F.min(F.struct(F.xxhash64("fp", F.lit(k)).alias("draw"), member.alias("x"))).alias("drawn"))
    centres = centres.select("token", F.array("first.x", "drawn.x").alias("centres"))
    met = placed.join(centres, "token").select("fp", "n", "place", "root", F.explode("centres").alias("o"))
    met = met.filter((F.col("root") != F.col("o.root")) & _may_share(F.col("n"), F.col("place"), F.col("o.n"), F.col("o.place")))
    return met.select(F.col("fp").alias("a"), F.col("o.fp").alias("b"))


def _all_pairs(placed: DataFrame) -> DataFrame:
    """(a, b): in each bucket, all pairs of different components that may be alike. Crowded buckets are dealt in squares of CHUNK."""
    chunks = F.ceil(F.col("size") / CHUNK)
    dealt = placed.withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks)).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    dealt = dealt.select("token", F.least("chunk", "x").alias("lo"), F.greatest("chunk", "x").alias("hi"), "chunk", "fp", "n", "place", "root")
    other = dealt.select("token", "lo", "hi", *[F.col(c).alias(f"o_{c}") for c in ("chunk", "fp", "n", "place", "root")])
    met = dealt.join(other, ["token", "lo", "hi"]).filter("fp > o_fp and root <> o_root and (lo = hi or chunk <> o_chunk)").filter(_may_share(F.col("n"), F.col("place"), F.col("o_n"), F.col("o_place")))
    return met.select(F.col("fp").alias("a"), F.col("o_fp").alias("b"))


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ; the larger one is folded to the size of the other, as its bits fall there."""
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2 + 1).cast("int"), (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    small, large = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    even = F.when(F.size(a) == F.size(b), large).otherwise(fold(large))
    return F.aggregate(F.zip_with(small, even, lambda p, q: p.bitwiseXOR(q)), F.lit(0), lambda total, x: total + F.bit_count(x))


def _possible(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Staged (a, b, n_a, n_b, bits): pairs that their sketches don't rule out. Sets 4/5 alike differ in at most a ninth of their joint size."""
    known = lambda x: owners.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"k_{x}"))
    both = pairs.distinct().join(known("a"), "a").join(known("b"), "b").withColumn("bits", _apart(F.col("k_a"), F.col("k_b")))
    return staged(both.filter(9 * F.col("bits") <= F.col("n_a") + F.col("n_b")).select("a", "b", "n_a", "n_b", "bits"), "candidates")


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, owners: DataFrame) -> DataFrame:
    """Staged (a, b): the pairs whose sets of shingles are 4/5 alike or more. owners: (fp, first), a document of each set."""
    wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    ids = staged(owners.select("fp", "first").join(wanted, "fp").select(F.col("first").alias("__id")).distinct(), "asked")
    own = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text"))
    texts = own.join(broadcast_if_small(ids), F.col("__own").eqNullSafe(F.col("__id")), "left_semi")
    sets = staged(_sets(texts, "__own", "__text", np.empty(0, np.uint64), True).select("fp", "shingles"), "shingles")
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    out = staged(both.filter(9 * F.size(F.array_intersect("s_a", "s_b")) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct(), "similar")
    for table in (sets, ids):
        discard(table)
    return out


def _nearest(pairs: DataFrame) -> DataFrame:
    """Staged: of the pairs of each a, the one whose sketches differ least."""
    best = pairs.groupBy("a").agg(F.min(F.struct("bits", "b", "n_a", "n_b")).alias("x"))
    return staged(best.select("a", "x.b", "x.n_a", "x.n_b"), "nearest")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components of label with further links."""
    return components(label.unionByName(links)) if links.limit(1).count() else label


def _by_simhash(docs: DataFrame, owners: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Staged (a, b): sets of shingles that SimHash links (RADIUS bits at most) and that are 4/5 alike or more."""
    own = owners.select("first", F.col("fp").alias("set"))
    bits = fingerprints(docs, id_col=id_col, text_col=text_col).groupBy("doc_id").agg(F.min("fp").alias("bits"))
    known = staged(bits.join(own, bits["doc_id"].eqNullSafe(own["first"])).select("bits", "set"), "simhash")
    # sets of one fingerprint meet the least of them, and those of linked fingerprints meet by these
    least = staged(known.groupBy("bits").agg(F.min("set").alias("least")), "distinct-simhash")
    linked = near_links(least.select(F.col("bits").alias("fp")))
    side = lambda x: least.select(F.col("bits").alias(x), F.col("least").alias(f"set_{x}"))
    pairs = linked.join(side("a"), "a").join(side("b"), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    same = known.join(least, "bits").filter("set <> least").select(F.col("set").alias("a"), F.col("least").alias("b"))
    return _verified(_possible(pairs.unionByName(same), owners), docs, id_col, text_col, owners)


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), a row per row of docs: components of texts whose sets of 5-word shingles are 4/5 alike or more.

    ROUNDS times each text not yet in one component with all it meets is compared with the likeliest of a few others; what is still
    apart after that, and may be alike, is compared pair by pair.
    """
    order, hot = _frequent(docs, id_col, text_col)
    found = staged(_sets(docs, id_col, text_col, order, False), "shingle-sets")
    owners = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "shingles", "sketch")]), "distinct-sets")
    placed = _postings(owners, hot).withColumn("root", F.col("fp"))
    label = _joined(docs.sparkSession.createDataFrame([], "a long, b long"), _by_simhash(docs, owners, id_col, text_col))
    placed = _open(placed, label)
    for k in range(ROUNDS):
        links = _verified(_nearest(_possible(_to_centres(placed, k), owners)), docs, id_col, text_col, owners)
        if links.limit(1).count() == 0:
            break
        label = _joined(label, links)
        placed = _open(placed, label)
    rest = _possible(_all_pairs(placed), owners)
    if rest.limit(1).count():
        label = _joined(label, _verified(rest, docs, id_col, text_col, owners))
    return _with_component(found.select("doc_id", "fp"), owners.select("fp", "first"), label).select("doc_id", "fp", "component_id")


def keep_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of similar(): that of its least id, as keep_one."""
    return _least_of_each(docs, similar(docs, id_col=id_col, text_col=text_col), id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
