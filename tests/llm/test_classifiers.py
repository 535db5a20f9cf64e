import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from linkwright.llm import bytequality as B
from linkwright.llm import labelled
from linkwright.llm import toxicity as X

BAD = ["vileword", "schlimmwort", "grosmot"]


def corpus(n=700):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstué") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(15, 150))]
        toxic, good = int(rng.random() < 0.4), int(rng.random() < 0.6)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD).capitalize() + ","
        text = " ".join(words) if good else " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words)
        rows.append((i, text, rng.choice(["en", "de"]), good, toxic))
    return rows


def frames(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows] + [(5, None, None), (999_999, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_sample_is_bounded_and_without_the_held_out_fold(spark):
    rows, docs, labels = frames(spark)
    sample = labelled.draw(docs, labels, "toxic", per_class=50)
    assert (sample.y == 1).sum() <= 50 and (sample.y == 0).sum() == 50
    held = {r.text for r in docs.filter(labelled.fold("doc_id") == 0).collect()}
    assert not held & set(sample.texts)
    assert labelled.draw(docs, labels, "toxic", per_class=50).texts == sample.texts


def test_toxicity_on_the_held_out_fold(spark):
    rows, docs, labels = frames(spark)
    model, limits = X.fit(docs, labels)
    assert set(limits) <= {"en", "de"} and limits
    got = X.score(docs.withColumn("t_score", F.lit("clash")), model).filter(labelled.fold("doc_id") == 0).collect()
    truth = {r[0]: r[4] for r in rows}
    assert np.mean([(r.t_score >= 0.5) == truth[r.doc_id] for r in got]) > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "...")], "doc_id long, text string")
    scores = [r.t_score for r in X.score(odd, model).collect()]
    assert scores[0] == scores[1] == scores[2] and 0 <= scores[0] <= 1
    assert X.score(odd.limit(0), model).count() == 0


def test_a_score_does_not_depend_on_neighbours_or_parts():
    rng = np.random.default_rng(1)
    texts = [r[1] for r in corpus(60)] + ["", "a", "x y", "longer " * 40_000]
    for net in (X.Classifier.fresh(), B.Network.fresh()):
        alone = np.array([net.scores([t])[0] for t in texts])
        order = rng.permutation(len(texts))
        assert np.allclose(net.scores([texts[i] for i in order]), alone[order], atol=1e-5)


def test_convolution_matches_brute_force():
    model, words = X.Classifier.fresh(), "one two three four".split()
    a, b, begin, size = X._laid_out(*X.word_buckets([" ".join(words)]))
    got = model._activations(a, b)[:4]
    x = [model.p["e1"][i] + model.p["e2"][j] for i, j in zip(a, b)] + [np.zeros(X.DIMENSIONS)] * 4
    w = model.p["w"].reshape(X.DIMENSIONS, X._TAPS, X.FILTERS)
    for p in range(4):
        tap = 0
        for k, width in enumerate(X.WIDTHS):
            want = sum(x[p + j] @ w[:, tap + j] for j in range(width))
            assert np.allclose(got[p, k * X.FILTERS : (k + 1) * X.FILTERS], want, atol=1e-5)
            tap += width
    net, text = B.Network.fresh(), "Zürich ist schön".encode() * 30
    data, blocks, sizes = B._layout([text])
    act = net._activations(data)
    for p in (0, 7, 200):
        assert np.allclose(act[p], sum(net.p["e"][data[2 * p + k]] @ net.p["w"][k] for k in range(B.WIDTH)), atol=1e-4)


def test_maxima_are_pooled_over_parts_of_any_size(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["", "one", *(" ".join(rng.choice(["aa", "bb", "c", "dé", "x1"], n)) for n in (2, 5, 31, 200)), "end"]
    model = X.Classifier.fresh()
    laid = X._laid_out(*X.word_buckets(texts))
    act = model._activations(*laid[:2])
    want = np.stack([act[b : b + n].max(axis=0) for b, n in zip(*laid[2:])])
    for size in (1, 2, 3, 7, 64, 1000):
        monkeypatch.setattr(X, "PART_WORDS", size)
        assert np.allclose(model._pooled(*laid), want, atol=1e-5)


def brute_quality(net, text):
    """The whole network in loops: a chunk's maxima over the filters that begin in its blocks, then mean and least logit."""
    raw = text.encode()
    data = [B._PAD] * B.WIDTH + list(raw)
    blocks = -(-len(data) // B.BLOCK)
    data += [B._PAD] * (blocks * B.BLOCK + B.WIDTH - len(data))
    act = [sum(net.p["e"][data[p + k]] @ net.p["w"][k] for k in range(B.WIDTH)) for p in range(0, blocks * B.BLOCK, 2)]
    half, logits = B.BLOCK // 2, []
    last = max(blocks - B.CHUNK_BLOCKS, 0)
    for first in sorted({min(k * B.HOP, last) for k in range(blocks)}):
        top = np.max(act[first * half : (first + B.CHUNK_BLOCKS) * half], axis=0) + net.p["b"]
        inside = sum(min(max(len(raw) - b * B.BLOCK, 0), B.BLOCK) for b in range(first, min(first + B.CHUNK_BLOCKS, blocks)))
        x = np.append(np.maximum(top, 0) if raw else top * 0, np.log1p(inside) / np.log(B.CHUNK))
        logits.append(np.maximum(x @ net.p["h"] + net.p["hb"], 0) @ net.p["o"] + net.p["c"][0])
    z = net.p["mix"][0] * np.mean(logits) + net.p["mix"][1] * min(logits) + net.shift
    return 1 / (1 + np.exp(-z))


def test_whole_scores_match_brute_force():
    rng = np.random.default_rng(2)
    texts = ["", "a", "é" * 70, *(" ".join(rng.choice(["wort", "ça", "#", "and so"], n)) for n in (20, 60, 101, 300, 700))]
    net = B.Network.fresh()
    net.p["b"] = rng.normal(0, 0.3, B.FILTERS).astype(np.float32)
    net.shift = 0.4
    assert np.allclose(net.scores(texts), [brute_quality(net, t) for t in texts], atol=1e-4)
    model = X.Classifier.fresh()
    model.p["b"], model.p["c"], model.shift = rng.normal(0, 0.3, model.p["b"].shape).astype(np.float32), np.array([0.2], np.float32), -0.3
    want = []
    for text in texts:
        one, two, _ = X.word_buckets([text])
        x = [model.p["e1"][i] + model.p["e2"][j] for i, j in zip(one, two)] or [np.zeros(X.DIMENSIONS)]
        x += [np.zeros(X.DIMENSIONS)] * 2
        w, tap, pooled = model.p["w"].reshape(X.DIMENSIONS, X._TAPS, X.FILTERS), 0, []
        for width in X.WIDTHS:
            pooled.append(np.max([sum(x[p + j] @ w[:, tap + j] for j in range(width)) for p in range(len(x) - 2)], axis=0))
            tap += width
        want.append(1 / (1 + np.exp(-(np.maximum(np.concatenate(pooled) + model.p["b"], 0) @ model.p["o"] + 0.2 - 0.3))))
    assert np.allclose(model.scores(texts), want, atol=1e-4)


def brute_threshold(scores, truth):
    """The cut between neighbouring scores that has the best F1."""
    cuts = sorted(set(scores), reverse=True)
    f1 = [2 * sum(t for s, t in zip(scores, truth) if s >= c) / (sum(s >= c for s in scores) + sum(truth)) for c in cuts]
    best = f1.index(max(f1))
    below = [s for s in scores if s < cuts[best]]
    return (cuts[best] + max(below)) / 2 if below else cuts[best]


def test_thresholds_of_languages_match_brute_force():
    class Fixed:
        def scores(self, texts):
            return np.array([float(t) for t in texts])

    rng = random.Random(3)
    rows = [(lang, round(rng.random(), 2), rng.random() < 0.5) for lang in ("de", "en") for _ in range(90)] + [("fr", 0.5, True)]
    sample = labelled.Sample([str(s) for _, s, _ in rows], [lang for lang, _, _ in rows], np.array([float(t) for *_, t in rows]), 0.0)
    got = X.calibrate(Fixed(), sample)
    assert set(got) == {"de", "en"}
    for lang, found in got.items():
        own = [(s, t) for k, s, t in rows if k == lang]
        assert abs(found - brute_threshold([s for s, _ in own], [int(t) for _, t in own])) < 1e-12


def test_conflicting_labels_and_texts_are_settled_the_same_way(spark):
    docs = spark.createDataFrame([(1, "b text", "en"), (1, "a text", "de"), (2, "other", "en"), (None, "nobody", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    for n in (1, 3, 5):
        sample = labelled.draw(docs.repartition(n), labels.repartition(n), "toxic")
        assert dict(zip(sample.texts, sample.y)) == {k: v for i, k, v in ((1, "a text", 0.0), (2, "other", 1.0)) if zlib.crc32(str(i).encode()) % 5}


def test_queries_follow_their_contract(spark, tmp_path):
    rows, docs, labels = frames(spark)
    docs.selectExpr("*", "'s' source", "1L n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for query, cut in ((X.query, 0.5), (B.query, 0.3)):
        got = query(spark, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in got)


def test_chunks_cover_every_block_and_overlap():
    blocks = np.array([1, 2, 4, 5, 6, 9, 30])
    members, n = B._chunks(blocks)
    first = np.cumsum(blocks) - blocks
    for t, (at, count) in enumerate(zip(np.cumsum(n) - n, n)):
        mine = members[at : at + count] - first[t]
        assert set(mine.ravel()) == set(range(blocks[t]))
        assert all(set(x) & set(y) for x, y in zip(mine, mine[1:]))


def test_byte_quality_on_the_held_out_fold(spark):
    rows, docs, labels = frames(spark)
    net = B.fit(docs, labels)
    got = B.score(docs.withColumn("b_score", F.lit("clash")), net).filter(labelled.fold("doc_id") == 0).collect()
    truth = {r[0]: r[3] for r in rows}
    assert np.mean([(r.b_score >= 0.5) == truth[r.doc_id] for r in got]) > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é")], "doc_id long, text string")
    scores = [r.b_score for r in B.score(odd, net).collect()]
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores)
    assert B.score(odd.limit(0), net).count() == 0


def test_without_labels_nothing_is_known(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.score(docs, X.fit(docs, labels)[0]).first().t_score == 0.5
    assert B.score(docs, B.fit(docs, labels)).first().b_score == 0.5


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    _, docs, labels = frames(spark)
    monkeypatch.setattr(labelled, "PER_CLASS", 10)
    rows = labelled.every(docs, labels, "toxic")
    wanted = labels.filter("toxic is not null and doc_id < 700").filter(labelled.fold("doc_id") != 0)
    assert rows.count() == wanted.count() > 500
    seen = sum(got.sum() for name, got in X._each_task(rows, X._counted, "counts") if name == "rows")
    assert seen == rows.count()
    # a word that only one text has, far behind its 50,000th code point, is learned too
    rare = spark.createDataFrame([(2, "plain " * 12_000 + "onlyhere", "en")], "doc_id long, text string, lang string")
    found = labelled.every(rare, spark.createDataFrame([(2, 1)], "doc_id long, toxic int"), "toxic")
    counts = dict(X._each_task(found, X._counted, "counts"))
    bucket = X.word_buckets(["onlyhere"])[0][0]
    assert counts["e1"].reshape(2, -1)[1, bucket] == 1


def test_executors_add_up_what_tasks_give(spark, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 4)
    rows = spark.createDataFrame([(f"text {i}", i % 2) for i in range(40)], "text string, y int").repartition(3)

    def given(work):
        y = np.concatenate([labels for _, labels in work])
        return {"few": np.array([len(y), y.sum()], np.float32), "many": np.r_[np.zeros(9), y.sum(), np.zeros(5)]}

    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    got = list(X._each_task(rows, given, "sums"))
    assert [k for k, _ in got] == ["few", "many"]
    assert got[0][1].tolist() == [40, 20] and got[0][1].dtype == np.float32
    assert got[1][1].tolist() == [0] * 9 + [20] + [0] * 5
    # one job for each array of each task once took the driver's memory
    assert len(set(tracker.getJobIdsForGroup()) - before) < 6


def test_maxima_by_parts_are_those_of_whole_texts(monkeypatch):
    one, two, sizes = X.word_buckets([r[1] for r in corpus(20)] + ["", "a"])
    laid, net = X._laid_out(one, two, sizes), X.Classifier.fresh()
    top, at = net._best(*laid)
    monkeypatch.setattr(X, "PART_WORDS", 37)
    again, where = net._best(*laid)
    assert np.allclose(top, again, atol=1e-6) and np.allclose(top, net._pooled(*laid), atol=1e-6) and (at == where).mean() > 0.99
