import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.operators import addresspairs, blocking, candidates, evaluation, features, links, training
from linkwright.operators.links import Keyed, Rows
from linkwright.operators.normalize import entities_normalized
from linkwright.plans.staging import staged
from linkwright.queries import QUERIES
from linkwright.sources import entities as E
from tests.test_linkage import brute_similarity

NAMES = ["North River Trading", "North River Trading Ltd", "River North Trading", "Northriver Trading", "Blue Stone", "Blue Stone Works", "X"]


@pytest.fixture
def crowd(spark, monkeypatch):
    """Records of few names, so that most pairs are exact ones, and chunks of two targets."""
    monkeypatch.setattr(links, "CHUNK", 2)
    rows = [(i, 1 + i % 3, f"S{1 + i % 3}-{i}", NAMES[(i * i) % len(NAMES)], f"{1 + i % 4} Main St, Town 1000{i % 2}", "US" if i % 7 else "FR") for i in range(90)]
    df = spark.createDataFrame(rows, "ingest_seq long, source int, entity_id string, business_name string, business_address string, country string")
    return blocking.sides(staged(entities_normalized(df), "records"))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_exact_pairs_come_once_and_are_not_shuffled(crowd):
    s1, targets = crowd
    found = blocking.exact_union(s1, targets)
    each = itertools.chain(*(rows_of(f(s1, targets)) for f in (blocking.exact_core, blocking.exact_sorted, blocking.exact_alphanumeric)))
    assert rows_of(found) == sorted(set(each)) and len(rows_of(found)) > 200
    # the last step is the one that makes pairs: nothing is aggregated or exchanged above it
    for df in (found, blocking.exact_core(s1, targets)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("Generate explode", 1)[0] and "Generate explode" in plan
    twice = s1.unionByName(s1)
    assert rows_of(blocking.exact_union(twice, targets)) == rows_of(found)
    assert rows_of(blocking.exact_core(twice, targets)) == rows_of(blocking.exact_core(s1, targets))


def test_held_pairs_go_to_the_array_of_their_target_alone(crowd):
    s1, targets = crowd
    every = set(rows_of(blocking.exact_union(s1, targets)))
    some = sorted(every)[::3]
    foreign = [(a, b) for a in ("S1-0", "S1-3") for b in ("S2-1", "S3-2", "none") if (a, b) not in every]
    held = staged(s1.sparkSession.createDataFrame([*some, *some[:5], *foreign, ("none", "S2-1"), ("S1-0", None)], "s1_id string, target_id string"), "held")
    keyed = blocking.core_links(s1, targets)
    for left, whole in ((blocking.exact_union(s1, targets, held), every), (keyed.without(held), set(rows_of(keyed.pairs())))):
        assert rows_of(left) == sorted(whole - set(some))
        # no record's held pairs are joined to all that it asks
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        assert foreign and not [line for line in plan.splitlines() if "Join" in line and "s1_id" in line]


def test_best_candidates_are_those_of_the_union(crowd):
    s1, targets = crowd
    limit = 3
    union = staged(candidates.union_with_provenance(s1, targets, True), "union")
    exact = set(rows_of(blocking.exact_union(s1, targets)))
    assert {r[:2] for r in rows_of(union.filter("gen_exact"))} == exact
    assert rows_of(candidates.best_candidates(s1, targets, limit, True)) == rows_of(candidates.top_candidates(union, limit))
    assert union.count() == union.select("s1_id", "target_id").distinct().count()


def test_candidates_are_marked_as_exact_where_they_are_made(crowd):
    s1, targets = crowd
    rows = candidates._capped(s1, targets, False, 0.25, 20)
    exact = set(rows_of(blocking.exact_union(s1, targets)))
    got = rows_of(rows.selectExpr("s1_id", "target_id", "bits & 1 as exact").distinct())
    assert {r[:2] for r in got if r[2]} == exact & {r[:2] for r in got} and len({r[:2] for r in got}) == len(got)
    # a join for tokens and for either key of addresses, and none of pairs with records
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 3
    twice = s1.withColumn("name", F.col("name").withField("core_name", F.lit("other")).withField("sorted_tokens", F.lit("other")).withField("alphanumeric", F.lit("other"))).unionByName(s1)
    marked = {r[:2] for r in rows_of(candidates._capped(twice, targets, False, 0.25, 20).filter("bits & 1 = 1").select("s1_id", "target_id").distinct())}
    assert marked == exact & {r[:2] for r in got}


def test_distances_of_the_fixed_scorer_are_computed_once(spark):
    resolved = QUERIES["resolve_fixed_scorer"](spark, "/root/testdata/sf0.001")
    assert "levenshtein" not in resolved._jdf.queryExecution().optimizedPlan().toString()


def test_relations_by_keys_and_by_rows_agree(crowd, spark):
    s1, targets = crowd
    side = lambda df, name: df.select(F.col("entity_id").alias(name), "country", F.col("address.building_number").alias("no"))
    by_keys = Keyed(side(s1, "s1_id"), side(targets, "target_id"), ["country", "no"])
    by_rows = Rows(staged(by_keys.pairs(), "rows"))
    want = {(a.s1_id, b.target_id) for a in by_keys.left.collect() for b in by_keys.right.collect() if (a.country, a.no) == (b.country, b.no)}
    assert rows_of(by_rows.rows) == sorted(want)
    found = staged(candidates.best_candidates(s1, targets, 10), "found")
    asked = s1.select(F.col("entity_id").alias("s1_id"))
    predicted = blocking.core_links(s1, targets)
    assert isinstance(predicted, Keyed)
    for f in (
        lambda t: t.counts(), lambda t: t.total(), lambda t: t.met(found), lambda t: t.mark(found, "hit"), lambda t: t.without(found),
        lambda t: candidates.recall(found, t, asked, targets), lambda t: candidates.recall_by_strategy(found, t), lambda t: training.training_pairs(found, t, asked, targets),
        lambda t: evaluation.entity_counts(found, t, asked), lambda t: evaluation.threshold_sweep(found.select("s1_id", "target_id", F.lit(0.5).alias("prob")), t, asked),
    ):
        assert rows_of(f(by_keys)) == rows_of(f(by_rows))
    for f in (evaluation.entity_counts, evaluation.error_samples, evaluation.multi_match_errors):
        assert rows_of(f(predicted, by_keys, asked)) == rows_of(f(predicted.pairs(), by_rows.rows, asked))


def test_features_of_training_pairs_are_counted(crowd, monkeypatch):
    s1, targets = crowd
    side = lambda df, name: df.select(F.col("entity_id").alias(name), "country", F.col("address.building_number").alias("no"))
    truth = Keyed(side(s1, "s1_id"), side(targets, "target_id"), ["country", "no"])
    found, asked = staged(candidates.best_candidates(s1, targets, 3), "found"), s1.select(F.col("entity_id").alias("s1_id")).filter("ingest_seq % 4 > 0")
    pairs = features.pair_features(training.training_pairs(found, truth, s1.select(F.col("entity_id").alias("s1_id")), targets).join(asked, "s1_id", "left_semi"), s1, targets)
    want = Counter(tuple(r) for r in pairs.select("label", *features.ALL).collect())
    own = training.labelled_features(found, truth, asked, s1, targets)
    assert Counter(tuple(r) for r in own.select("label", *features.ALL).collect()) == want and {r.weight for r in own.collect()} == {1.0}
    by_rows = training.labelled_features(found, Rows(staged(truth.pairs(), "rows")), asked, s1, targets)
    assert Counter(tuple(r) for r in by_rows.select("label", *features.ALL).collect()) == want
    monkeypatch.setattr(training, "PIECES", 8)
    few = training.labelled_features(found, truth, asked, s1, targets).collect()
    weights = Counter()
    for r in few:
        weights[tuple(r[c] for c in ("label", *features.ALL))] += r.weight
    assert {k: round(v, 6) for k, v in weights.items()} == want and len(few) < sum(want.values()) / 2


def test_words_of_records_come_from_the_head_of_a_text(spark):
    texts = ["", None, "--", "one", "  a-b_c d1 e  f,g h i j k l", "ΑΣ ΒΣ ΓΣ ΔΣ ΕΣ ΖΣ ΗΣ ΘΣ'Α ΙΣ", "İa b c d e f g h i j", "x " * 5000, "." * 50000 + "q"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = r"slice(split(trim(regexp_replace(lower(text), r'[^\p{L}\p{N}]+', ' ')), ' '), 1, 8) as ws"
    assert [r.ws[:8] if r.ws else r.ws for r in df.selectExpr(E.WORDS).collect()] == [r.ws for r in df.selectExpr(whole).collect()]
    assert df.selectExpr(E.WORDS.replace(" as ws", "") + " as w").selectExpr("max(size(w)) as n").first().n <= 10


def test_similarity_join_has_a_vector_for_each_text(spark, monkeypatch):
    schema = "entity_id string, name struct<core_name: string>, address struct<cleaned: string>"
    s1, targets = (spark.createDataFrame([(f"{side}-{i}", (NAMES[i * i % 7].lower(),), (f"{1 + i % 3} main st",)) for i in range(n)], schema).coalesce(1) for side, n in (("S1", 12), ("S2", 40)))
    vectors, stage = [], blocking.staged

    def counted(df, name):
        out = stage(df, name)
        if name == "vectors":
            vectors.append(out.count())
        return out

    monkeypatch.setattr(blocking, "staged", counted)
    monkeypatch.setattr(blocking, "TARGET_BLOCK", 6)
    records = [df.select("entity_id", F.lower(F.concat_ws(" ", "name.core_name", "address.cleaned")).alias("text")).collect() for df in (s1, targets)]
    got = {(r.s1_id, r.target_id): r.similarity for r in blocking.by_similarity(s1, targets, 0.25, 7).collect()}
    want = brute_similarity(s1, targets, 0.25, 7)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert vectors == [len({r.text for r in side}) for side in records]
    assert [len(side) for side in records] != vectors


def test_distances_of_short_and_long_texts():
    rng = np.random.default_rng(3)
    texts = ["", "a", "ab", "b" * 64, "b" * 65, "ab" * 40, "Ж中a" * 9] + ["".join(rng.choice(list("abЖ 1"), int(rng.integers(0, 90)))) for _ in range(40)]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts)), indexing="ij"))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    want = [plain(texts[i], texts[j]) for i, j in zip(left, right)]
    text, size = addresspairs.letters(texts)
    assert addresspairs.distances(text, size, left, right).tolist() == want
    assert addresspairs._by_rows(text[left], size[left], text[right], size[right]).tolist() == want


def test_address_features_of_whole_keys_are_counted_in_arrays(spark, monkeypatch):
    schema = "key string, address struct<cleaned: string, sorted_tokens: string, alphanumeric: string, tokens: array<string>, numeric_tokens: array<string>, postal_code: string, building_number: string, is_empty: boolean>, names array<struct<no: long, n: long>>"

    def row(key, said, names):
        words = said.split()
        digits = [w for w in words if w.isdigit()]
        address = (said, " ".join(sorted(set(words))), said.replace(" ", ""), words, digits, next((w for w in digits if len(w) == 5), ""), digits[0] if digits else "", said == "")
        return key, address, names

    said = ["", "1 main st x 10001", "2 main st 10001", "main main st", "st main main", "1 main st " + "long " * 30, "é 7"]
    left = spark.createDataFrame([row(k, s, [(i, 2), (9, 1)][: 1 + i % 2]) for k in ("a", "b", None) for i, s in enumerate(said)], schema)
    right = spark.createDataFrame([row(k, s, [(20 + i % 3, 3)]) for k in ("a", "c", None) for i, s in enumerate(said[::-1])], schema)
    for name, value in (("CHUNK", 3), ("BATCH", 5)):
        monkeypatch.setattr(addresspairs, name, value)
    one = lambda df, p: df.select("key", F.struct("address").alias(p), F.explode("names").alias(f"{p}_name"))
    pairs = features.address_features(one(left, "l").join(one(right, "r"), "key"))
    want = pairs.groupBy(*features.ADDRESS, F.col("l_name.no").alias("l_no"), F.col("r_name.no").alias("r_no")).agg(F.sum(F.expr("l_name.n * r_name.n")).alias("weight"))
    got = addresspairs.counted(left, right, ["key"])
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in want.select(*got.columns).collect()) and got.count() > 20


def test_each_candidate_is_compared_once_to_train_and_score(crowd, monkeypatch):
    s1, targets = crowd
    side = lambda df, name: df.select(F.col("entity_id").alias(name), "country", F.col("address.building_number").alias("no"))
    truth = Keyed(side(s1, "s1_id"), side(targets, "target_id"), ["country", "no"])
    found, asked = staged(candidates.best_candidates(s1, targets, 3), "found"), s1.select(F.col("entity_id").alias("s1_id")).filter("ingest_seq % 4 > 0")
    rows, compare = [], features.address_features

    def counting(df):
        rows.append(df.count())
        return compare(df)

    monkeypatch.setattr(features, "address_features", counting)
    every, labelled = training.compared(found, truth, asked, s1, targets)
    weights = {r.label: r.n for r in labelled.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    spare = training._negatives(found.join(asked, "s1_id", "left_semi"), truth, asked, targets, 3.0).filter("gen_count = 0").count()
    assert rows == [found.count() + spare] and weights[1] == truth.only(asked).total().first().n > rows[0]
    monkeypatch.undo()
    whole = features.pair_features(found, s1, targets).select("s1_id", "target_id", *features.ALL)
    assert Counter(tuple(r) for r in every.collect()) == Counter(tuple(r) for r in whole.collect())
