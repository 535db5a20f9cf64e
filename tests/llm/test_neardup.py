import random

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from linkwright.llm import neardup


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def some_texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    long = [word() for _ in range(400)]
    texts = [None, "", " \t\n", "One", "ONE", "Éa b", "éa b", " nbsp word", "a b c", "a  b\nc"]
    for i in range(40):
        changed = list(long)
        changed[rng.randrange(400)] = word()
        texts += [" ".join(changed), " ".join(word() for _ in range(30))]
    return texts + texts[-6:] + [" ".join(long * 60)]


def test_fingerprints_and_components_match_brute_force(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i * 3, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp int, component_id string").repartition(7)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in neardup.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert got == {i * 3: (fps[i], c * 3) for i, c in enumerate(brute_components(fps))}


def test_crowded_buckets_go_the_long_way_and_lose_nothing(spark):
    rng = random.Random(5)
    fps = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64) | 1 << 63):
        for _ in range(150):
            value = centre
            for _ in range(rng.randint(0, 7)):
                value ^= 1 << rng.randrange(64)
            fps.add(value)
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    want = brute_components(fps)
    for limit in (2048, 8, 3):
        found = {r.a: r.b for r in neardup.components(neardup.near_links(df, 3, limit)).collect()}
        roots = [found.get(signed(v), signed(v)) for v in fps]
        groups = {}
        for r, w in zip(roots, want):
            assert groups.setdefault(w, r) == r
        assert len(set(groups.values())) == len(groups)


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (-5, 101)], "a long, b long")
    got = {r.a: r.b for r in neardup.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: -5, 101: -5}


def test_keep_one_and_edge_cases(spark):
    schema = "doc_id long, text string, kept_rows string, __keep string"
    docs = spark.createDataFrame([(5, "a b c d", "en", "q"), (3, "A b c d", "en", None), (3, "A b c d", "en", None), (None, "z z z", None, "w"), (9, None, "fr", "w"), (10, "", "fr", "w")], schema)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 3, "A b c d"), (False, 9, None), (True, 0, "z z z")]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert neardup.near_duplicates(docs).filter(F.col("doc_id") == 3).count() == 2


def brute_similar(texts):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * all_:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited_texts():
    """Copies with 1 to 9 words replaced, some of them below similarity 4/5, around one boilerplate that all texts share."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    shared = [word() for _ in range(14)]
    texts = [None, "", "One", "ONE two", "one  TWO", "a b c d e", "a b c d e a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(80, 260))] + shared
        for edits in range(10):
            changed = list(base)
            for _ in range(edits):
                changed[rng.randrange(len(base))] = word()
            texts.append(" ".join(changed))
    texts += [" ".join(shared + [word() for _ in range(k % 4)]) for k in range(25)]
    return texts


def test_keep_similar_finds_edited_copies_as_brute_force_does(spark, monkeypatch):
    texts = edited_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(5)
    want = brute_similar(texts)
    assert len(set(want)) < len(set(brute_components([brute_fingerprint(t) for t in texts]))) - 20
    monkeypatch.setattr(neardup, "CHUNK", 7)
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    monkeypatch.setattr(neardup, "OFTEN", 2)
    assert {r.doc_id: r.component_id for r in neardup.similar(docs).collect()} == dict(enumerate(want))


def test_keep_similar_on_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d", "q"), (3, "A b c d", None), (3, "A b c d", None), (None, "z z z", "w"), (9, None, "w"), (10, "", "w")], "doc_id long, text string, mix_copy string")
    kept = neardup.keep_similar(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == [(False, 3, "A b c d"), (False, 9, None), (True, 0, "z z z")]
    assert neardup.keep_similar(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_edited_copies(spark, tmp_path):
    texts = [t for t in edited_texts() if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()} == set(brute_similar(texts))


def test_the_pipelines_stage_links_by_simhash_and_verifies(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "last"]), "", "other words stand here alone today"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {r.doc_id: r.fp for r in neardup.fingerprints(docs).collect()}
    assert bin((fps[0] ^ fps[1]) & (2**64 - 1)).count("1") <= neardup.RADIUS
    # without the steps by shingles, SimHash alone joins the edited copy with its text
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "_all_pairs", lambda placed: placed.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    assert {r.doc_id: r.component_id for r in neardup.similar(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    # fingerprints that are alike by chance link nothing: whole sets verify
    monkeypatch.setattr(neardup, "fingerprints", lambda docs, **_: docs.select("doc_id", F.lit(0).cast("long").alias("fp")))
    assert {r.doc_id: r.component_id for r in neardup.similar(docs).collect()}[3] == 3
