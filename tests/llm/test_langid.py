import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from linkwright.llm import langid as L


def brute_letters(text):
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def test_letters_only():
    texts = ["", "12 !", "Hello,  World!x", " a", "É1É", "日本 語", "a\n", "--x--y--"]
    assert L.letters_only(texts) == [brute_letters(t) for t in texts]


def test_letters_only_across_the_borders_of_parts():
    size = 1 << 20
    for head in ("a" * size, "a" * (size - 1) + " ", "a" * (size - 1) + "1", " " * size, "a" * (size - 2) + " 1"):
        text = head + " b, 2c"
        assert L.letters_only(["x", text, "y"]) == ["x", brute_letters(text), "y"]


def corpus(n):
    rng = random.Random(2)
    syllables = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßñ") for _ in range(rng.randint(2, 4))) for _ in range(40)] for k in range(70)}
    return [(i, " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(60)), lang) for i in range(n) for lang, s in [sorted(syllables.items())[i % 70]]]


def test_filters_of_many_languages(spark):
    rows = corpus(560)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    filters = L.Filters.fit(docs.filter("doc_id < 420"))
    assert len(filters.names) == 70 and len(filters.planes) == 2
    got = L.identify(docs.filter("doc_id >= 420").drop("lang").withColumn("l_pred", F.lit(1)), filters).collect()
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([r.l_pred == truth[r.doc_id] for r in got]) > 0.97
    # no false negatives: a trigram that was put into a filter is found there
    counts = Counter()
    for i, t, lang in rows[:420]:
        if lang == "l66":
            s = [L.PAD, L.PAD, *map(ord, brute_letters(t))]
            counts.update(zip(s, s[1:], s[2:]))
    frequent = np.array([(a << 42) | (b << 21) | c for (a, b, c), _ in counts.most_common(20)])
    at = filters.names.index("l66")
    assert all((int(w) >> (at - 64)) & 1 for w in filters.languages_of(frequent)[1])


def test_hashes_are_the_same_on_both_sides(spark):
    keys = [0, 5, 2**62 + 3, 123456789012]
    row = [[r[k] for k in range(3)] for r in spark.createDataFrame([(k,) for k in keys], "key long").select(*[L._hash_column(F.col("key"), k) for k in range(3)]).collect()]
    assert np.array(row).T.tolist() == [h.tolist() for h in L._hashes(np.array(keys))]


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !", None), (4, "the cat and the dog", "en"), (5, "der hund und die katze", "de"), (5, "der hund und die katze", "de"), (None, "the dog", None)], "doc_id long, text string, lang string")
    filters = L.Filters.fit(docs)
    got = sorted((r.doc_id or 0, r.l_pred, r.l_score > 0) for r in L.identify(docs, filters).collect())
    assert got == [(0, "en", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (5, "de", True), (5, "de", True)]
    assert L.identify(docs.limit(0), filters).count() == 0
    nothing = L.Filters.fit(docs.limit(0))
    assert {r.l_pred for r in L.identify(docs, nothing).collect()} == {"und"}
