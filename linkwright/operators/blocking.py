"""Candidate generation as joins. Records are normalized (operators.normalize.entities_normalized); the left side asks, the right one is indexed.

Exact keys join class by class and become pairs in the last step, hot keys dealt to many tasks; posting lists are capped in order of (source,
ingest_seq), which is a rank limit that Spark applies before its shuffle too; the similarity join runs block against block
over arrays, with bounds on what is left of either vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkwright.functions.tables import COMMON_TOKENS
from linkwright.operators.links import Keyed, Rows, expand, repeats
from linkwright.plans.staging import staged

TOKEN_POSTINGS = 150
ADDRESS_POSTINGS = 100
MIN_SIMILARITY = 0.25
TOP_K = 20
#: Records of a block of either side: a cell holds some 1 KB for each of them.
ASK_BLOCK, TARGET_BLOCK = 1 << 14, 1 << 16
#: Products are added up while the tails of both vectors could share so much; SLACK covers rounding.
FAR_TAIL, SLACK = 0.1, 1e-9


def sides(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    return normalized.filter("source = 1"), normalized.filter("source > 1")


def _pairs(s1: DataFrame, targets: DataFrame, left: Column, right: Column, keep: Column) -> DataFrame:
    a = s1.select("ckey", left.alias("key"), F.col("entity_id").alias("s1_id"))
    b = targets.filter(keep).select("ckey", right.alias("key"), F.col("entity_id").alias("target_id"))
    return a.join(b, ["ckey", "key"]).select("s1_id", "target_id")


def core_links(s1: DataFrame, targets: DataFrame) -> Rows | Keyed:
    """Equal country and core name, as keys; as rows if an id stands on a side twice."""
    key, long = F.col("name.core_name").alias("core"), F.length("name.core_name") >= 3
    sides = [df.filter(long).select("ckey", key, F.col("entity_id").alias(name)) for df, name in ((s1, "s1_id"), (targets, "target_id"))]
    if repeats(s1, "entity_id") or repeats(targets, "entity_id"):
        return Rows(expand(*sides, ["ckey", "core"]).distinct())
    return Keyed(*sides, ["ckey", "core"])


def exact_core(s1: DataFrame, targets: DataFrame) -> DataFrame:
    return core_links(s1, targets).pairs()


def exact_sorted(s1: DataFrame, targets: DataFrame) -> DataFrame:
    key = F.col("name.sorted_tokens")
    return _pairs(s1, targets, key, key, F.size("name.tokens") >= 2).distinct()


def exact_alphanumeric(s1: DataFrame, targets: DataFrame) -> DataFrame:
    key = F.col("name.alphanumeric")
    return _pairs(s1, targets, key, key, F.length(key) >= 4).distinct()


def exact_keys(df: DataFrame, *columns: str | Column) -> DataFrame:
    """columns, ckey and the three exact keys; one that is too short to join by is empty."""
    long = {"core": (F.col("name.core_name"), F.length("name.core_name") >= 3), "sorted": (F.col("name.sorted_tokens"), F.size("name.tokens") >= 2), "alnum": (F.col("name.alphanumeric"), F.length("name.alphanumeric") >= 4)}
    return df.select(*columns, "ckey", *[F.when(ok, key).otherwise(F.lit("")).alias(k) for k, (key, ok) in long.items()])


EXACT = ["core", "sorted", "alnum"]


def _kinds(keyed: DataFrame, *columns: str) -> DataFrame:
    """A row (columns, ckey, kind, key) for each exact key there is."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in EXACT]))
    return keyed.select(*columns, "ckey", each.alias("k")).select(*columns, "ckey", "k.kind", "k.key").filter("key <> ''")


def exact_union(s1: DataFrame, targets: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """All three keys, each pair once, without the pairs of held.

    Records with the same three keys are a class. Classes are joined, kind and key together, and made distinct; only then do they
    become pairs of records, so copies cost no more than the pairs that come out.
    """
    mine, theirs = exact_keys(s1, F.col("entity_id").alias("s1_id")), exact_keys(targets, F.col("entity_id").alias("target_id"))
    key = ["ckey", *EXACT]
    classes = staged(mine.select(key).unionByName(theirs.select(key)).distinct().withColumn("class", F.monotonically_increasing_id()), "name-classes")
    kinds = _kinds(classes, "class")
    alike = kinds.withColumnRenamed("class", "mine").join(kinds, ["ckey", "kind", "key"]).select("mine", "class").distinct()
    asking = mine.join(classes.withColumnRenamed("class", "mine"), key).select("s1_id", "mine").join(alike, "mine").select("s1_id", "class")
    found = expand(asking, theirs.join(classes, key).select("target_id", "class"), ["class"], held)
    return found.distinct() if repeats(s1, "entity_id") or repeats(targets, "entity_id") else found


def first_exact(s1: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """(s1_id, target_id), repeats included: of each record's exact pairs at least the first limit by target_id, and no others than exact pairs."""
    rank = F.dense_rank().over(Window.partitionBy("ckey", "kind", "key").orderBy("target_id"))
    first = _kinds(exact_keys(targets, F.col("entity_id").alias("target_id")), "target_id").withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")
    return _kinds(exact_keys(s1, F.col("entity_id").alias("s1_id")), "s1_id").join(first, ["ckey", "kind", "key"]).select("s1_id", "target_id")


def _alike(left: str, right: str) -> Column:
    alike = [(F.col(f"{left}{k}") == F.col(f"{right}{k}")) & (F.col(f"{left}{k}") != "") for k in EXACT]
    return alike[0] | alike[1] | alike[2]


def mark_exact(pairs: DataFrame, s1: DataFrame, targets: DataFrame, flag: str) -> DataFrame:
    """pairs with flag: whether both records have an exact key in common."""
    side = lambda df, key, p: exact_keys(df, F.col("entity_id").alias(key)).select(key, *[F.col(c).alias(f"__{p}_{c}") for c in ("ckey", *EXACT)])
    both = pairs.join(side(s1, "s1_id", "l"), "s1_id").join(side(targets, "target_id", "r"), "target_id")
    return both.select(*pairs.columns, ((F.col("__l_ckey") == F.col("__r_ckey")) & _alike("__l_", "__r_")).alias(flag))


def _capped(postings: DataFrame, cap: int, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("ckey", "key").orderBy("source", "ingest_seq", *order))
    return postings.withColumn("rank", rank).filter(F.col("rank") <= cap).drop("rank")


def _met(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """(s1_id, target_id, exact), repeats included: both sides bring their exact keys, so a pair is marked where it is made."""
    left, right = (df.withColumnsRenamed({k: f"__{p}_{k}" for k in EXACT}) for df, p in ((asked, "l"), (postings, "r")))
    return left.join(right, ["ckey", "key"]).select("s1_id", "target_id", _alike("__l_", "__r_").alias("exact"))


def token_pairs(s1: DataFrame, targets: DataFrame, cap: int = TOKEN_POSTINGS) -> DataFrame:
    """Pairs of by_token as they are met, with their exact flag."""
    postings = exact_keys(targets, "source", "ingest_seq", F.col("entity_id").alias("target_id"), F.posexplode("name.tokens").alias("pos", "key"))
    postings = postings.filter((F.length("key") >= 4) & ~F.col("key").isin(COMMON_TOKENS))
    asked = exact_keys(s1, F.col("entity_id").alias("s1_id"), F.explode(F.array_distinct("name.tokens")).alias("key"))
    return _met(asked, _capped(postings, cap, "pos"))


def by_token(s1: DataFrame, targets: DataFrame, cap: int = TOKEN_POSTINGS) -> DataFrame:
    """Shared tokens of four letters or more that aren't common; a token that a record repeats takes a posting each time."""
    return token_pairs(s1, targets, cap).select("s1_id", "target_id").distinct()


def _postal_key() -> Column:
    start = F.substring("name.core_name", 1, 2)
    return F.when(~F.col("address.is_empty") & (F.col("address.postal_code") != "") & (start != ""), F.concat_ws("|", "address.postal_code", F.lower(start)))


def _building_key() -> Column:
    tokens = F.col("address.tokens")
    street = F.when(F.get(tokens, F.lit(0)).rlike(r"^\d+$"), F.get(tokens, F.lit(1))).otherwise(F.get(tokens, F.lit(0)))
    return F.when(~F.col("address.is_empty") & (F.col("address.building_number") != "") & (F.size(tokens) >= 2) & (F.length(street) >= 3), F.concat_ws("|", "address.building_number", street))


def _by_address(s1: DataFrame, targets: DataFrame, key: Column, cap: int) -> DataFrame:
    postings = exact_keys(targets, "source", "ingest_seq", F.col("entity_id").alias("target_id"), key.alias("key")).filter("key is not null")
    asked = exact_keys(s1, F.col("entity_id").alias("s1_id"), key.alias("key")).filter("key is not null")
    return _met(asked, _capped(postings, cap, "target_id"))


def by_postal(s1: DataFrame, targets: DataFrame, cap: int = ADDRESS_POSTINGS) -> DataFrame:
    return _by_address(s1, targets, _postal_key(), cap).select("s1_id", "target_id").distinct()


def by_building(s1: DataFrame, targets: DataFrame, cap: int = ADDRESS_POSTINGS) -> DataFrame:
    return _by_address(s1, targets, _building_key(), cap).select("s1_id", "target_id").distinct()


def address_pairs(s1: DataFrame, targets: DataFrame, cap: int = ADDRESS_POSTINGS) -> DataFrame:
    """Pairs of by_address as they are met, with their exact flag."""
    return _by_address(s1, targets, _postal_key(), cap).unionByName(_by_address(s1, targets, _building_key(), cap))


def by_address(s1: DataFrame, targets: DataFrame, cap: int = ADDRESS_POSTINGS) -> DataFrame:
    return address_pairs(s1, targets, cap).select("s1_id", "target_id").distinct()


def _documents(df: DataFrame) -> DataFrame:
    """(id, text): what grams are taken from; records that share an id make one text."""
    text = F.lower(F.concat_ws(" ", "name.core_name", "address.cleaned"))
    return df.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(text)), " ").alias("text"))


def _grams(docs: DataFrame, *by: str) -> DataFrame:
    """(by, id, gram, tf) of docs (id, text): windows of 3 and 4 of each word between spaces; a word that is shorter counts once, whole."""
    word = F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    padded = docs.select(*by, "id", word.alias("w")).withColumn("w", F.concat(F.lit(" "), F.col("w"), F.lit(" ")))

    def windows(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("w"), i, F.lit(n)))

    grams = F.when(F.length("w") <= 3, F.array("w")).otherwise(F.concat(windows(3), windows(4)))
    return padded.select(*by, "id", F.explode(grams).alias("gram")).groupBy(*by, "id", "gram").agg(F.count(F.lit(1)).alias("tf"))


def _weighted(mine: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, gram, weight, number, idf) of either side, documents (id, text): unit vectors, grams numbered. Document frequencies are those of the targets, which
    count n times each."""
    total = theirs.agg(F.sum("n").alias("n"))
    mine, theirs = staged(_grams(mine), "grams"), staged(_grams(theirs, "n"), "target-grams")
    found = theirs.groupBy("gram").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(total))
    idf = staged(found.select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")).withColumn("number", F.monotonically_increasing_id()), "idf")

    def unit(grams: DataFrame) -> DataFrame:
        raw = grams.join(idf, "gram").withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
        return raw.select("id", "gram", (F.col("weight") / norm).alias("weight"), "number", "idf")

    return unit(mine), unit(theirs)


def tfidf_weights(s1: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, gram, weight) of either side, unit vectors; document frequencies are those of the targets."""
    return tuple(df.select("id", "gram", "weight") for df in _weighted(_documents(s1), _documents(targets).withColumn("n", F.lit(1))))


def _vectors(weighted: DataFrame) -> DataFrame:
    """(id, number, weight): parallel arrays, the rarest grams first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("common"), "number", "weight")))
    return weighted.groupBy("id").agg(ordered.alias("v")).select("id", F.col("v.number").alias("number"), F.col("v.weight").alias("weight"))


def _cell(least: float, top_k: int):
    """Asking vectors and target vectors of one cell -> (s1_id, target_id, similarity), the top_k of each asking one.

    A target vector stands for all targets with the same text, of which it has the first top_k ids. Let h(g) be the norm of a vector from its gram g on, the
    rarest grams first. What two vectors share from g on adds up to h(g) h'(g) at most. Postings of a gram come with the largest h' first, so the
    cut at FAR_TAIL, up to which products are added up, is a prefix of them: partial sums lack no more than that. Pairs are then added up in full in order of
    their partial sums; what cannot reach the last of the best top_k any more is left out.
    """

    def flat(table: pa.Table) -> tuple[np.ndarray, ...]:
        number, weight = table.column("number").combine_chunks(), table.column("weight").combine_chunks()
        ends = number.offsets.to_numpy().astype(np.int64)
        n, w = number.flatten().to_numpy(), weight.flatten().to_numpy()
        sizes = np.diff(ends)
        squares = np.concatenate([[0.0], np.cumsum(w * w)])
        rest = np.sqrt(np.maximum(np.repeat(squares[ends[1:] - ends[0]], sizes) - squares[:-1], 0.0))
        return n, w, rest, ends - ends[0], np.repeat(np.arange(len(sizes)), sizes)

    def match(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows and theirs.num_rows:
            known, of = mine.column("id").to_pylist(), theirs.column("ids").combine_chunks()
            first = of.offsets.to_numpy().astype(np.int64)
            many, first = np.diff(first), first[:-1] - first[0]
            of = np.array(of.flatten().to_pylist(), object)
            by_id = np.argsort(np.argsort(of))
            n, w, h, ends, doc = flat(theirs)
            grams, gram = np.unique(n, return_inverse=True)
            by_gram = np.lexsort((-h, gram))
            posted, down, value = doc[by_gram], -h[by_gram], w[by_gram]
            starts = np.searchsorted(gram[by_gram], np.arange(len(grams) + 1))
            asked_n, asked_w, asked_h, asked_ends, _ = flat(mine)
            at = np.minimum(np.searchsorted(grams, asked_n), len(grams) - 1)
            there = grams[at] == asked_n
            partial, dense = np.zeros(len(many)), np.zeros(len(grams))

            def full(some: np.ndarray) -> np.ndarray:
                sizes = ends[some + 1] - ends[some]
                each = np.repeat(ends[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                return np.round(np.add.reduceat(dense[gram[each]] * w[each], np.cumsum(sizes) - sizes), 9)

            for k in range(len(known)):
                own = np.arange(asked_ends[k], asked_ends[k + 1])
                own = own[there[own]]
                partial[:] = 0
                for i in own:
                    low, high = starts[at[i]], starts[at[i] + 1]
                    far = low + np.searchsorted(down[low:high], -(FAR_TAIL - SLACK) / asked_h[i], "right")
                    partial[posted[low:far]] += asked_w[i] * value[low:far]
                some = np.flatnonzero(partial >= least - FAR_TAIL - SLACK)
                if not len(some):
                    continue
                dense[at[own]] = asked_w[own]
                some = some[np.argsort(-partial[some], kind="stable")]
                exact = full(some[: 2 * top_k])
                if len(some) > len(exact):
                    bar = max(least, np.partition(exact, -top_k)[-top_k])
                    end = np.searchsorted(-partial[some], -(bar - FAR_TAIL - SLACK), "right")
                    some = some[: max(end, len(exact))]
                    if len(some) > len(exact):
                        exact = np.concatenate([exact, full(some[len(exact) :])])
                dense[at[own]] = 0
                good = exact >= least
                some, exact = some[good], exact[good]
                ids = np.repeat(first[some] - (np.cumsum(many[some]) - many[some]), many[some]) + np.arange(many[some].sum())
                exact = np.repeat(exact, many[some])
                best = np.lexsort((by_id[ids], -exact))[:top_k]
                out.append((known[k], of[ids[best]], exact[best]))
        ids = [x for x, found, _ in out for _ in found]
        return pa.table({"s1_id": pa.array(ids, pa.string()), "target_id": pa.array([t for _, found, _ in out for t in found], pa.string()), "similarity": pa.array(np.concatenate([s for *_, s in out]) if out else [], pa.float64())})

    return match


def by_similarity(s1: DataFrame, targets: DataFrame, min_similarity: float = MIN_SIMILARITY, top_k: int = TOP_K) -> DataFrame:
    """(s1_id, target_id, similarity): cosine of at least min_similarity, the top_k of each s1_id.

    Records with the same text have the same vector, so vectors stand for texts. Either side is cut into blocks of bounded size; each pair of blocks is a
    cell, one task that holds an index of its targets and gives top_k rows per asking text at most. Candidate pairs live in arrays of a cell and are never rows.
    """
    mine, theirs = (staged(_documents(df), "documents") for df in (s1, targets))
    members = mine.withColumnRenamed("id", "s1_id")
    asked = staged(mine.groupBy("text").agg(F.min("id").alias("id")), "asking-texts")
    rank = F.row_number().over(Window.partitionBy("text").orderBy("id"))
    first = theirs.withColumn("r", rank).filter(F.col("r") <= top_k).groupBy("text").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    held = staged(theirs.groupBy("text").agg(F.count(F.lit(1)).alias("n")).join(first, "text").withColumn("id", F.col("ids")[0]), "target-texts")
    mine, theirs = (_vectors(df) for df in _weighted(asked, held))
    mine, theirs = staged(mine, "vectors"), staged(theirs.join(held.select("id", "ids"), "id"), "vectors")
    asking, indexed = mine.count(), theirs.count()
    tasks = mine.sparkSession.sparkContext.defaultParallelism
    lines = max(1, -(-asking // ASK_BLOCK), min(tasks, asking // 64))
    blocks = max(1, -(-indexed // TARGET_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = mine.withColumn("line", block(lines)).withColumn("block", every(blocks))
    right = theirs.withColumn("block", block(blocks)).withColumn("line", every(lines))
    # cells are few and heavy: they are dealt one by one, not put together by their bytes
    cells = lambda df: df.repartition(lines * blocks, "line", "block").groupBy("line", "block")
    found = cells(left).cogroup(cells(right)).applyInArrow(lambda a, b: _cell(min_similarity, top_k)(a, b), "s1_id string, target_id string, similarity double")
    if blocks > 1:
        best = Window.partitionBy("s1_id").orderBy(F.desc("similarity"), "target_id")
        found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= top_k).drop("r")
    # what a text found is found by all of its records
    return found.withColumnRenamed("s1_id", "id").join(asked, "id").join(members, "text").select("s1_id", "target_id", "similarity")


def baseline_exact(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Equal country, core name and address; empty ones join with empty ones."""
    key = ["country_norm", "core", "addr"]
    side = lambda df, name: df.select("country_norm", F.col("name.core_name").alias("core"), F.col("address.cleaned").alias("addr"), F.col("entity_id").alias(name))
    return side(s1, "s1_id").join(side(targets, "target_id"), key).select("s1_id", "target_id")
