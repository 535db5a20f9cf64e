import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from linkwright.llm import quality as Q
from linkwright.llm.batches import PAD, Trigrams, text_parts, xxhash_longs


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)]


def some_texts():
    rng = random.Random(4)
    texts = ["", " ", "\n\n", "a", "#*$%&|<> é x", "x y\nx y\n x y\nx y", "one two " * 9, "ééé日本 " * 4]
    for _ in range(40):
        words = [rng.choice(["a", "bb", "é", "ccc#", "|"]) for _ in range(rng.randint(1, 60))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words))
    block = " ".join(str(i) for i in range(30))
    return texts + [block + " x " + block, (block + "\n") * 3, " ".join(str(rng.random()) for _ in range(3000))]


def test_statistics_match_brute_force():
    texts = some_texts()
    assert Q.base_statistics(texts).T.tolist() == [brute_statistics(t) for t in texts]


def test_trigrams_in_pieces():
    texts = ["abcabc", "", "é" * 11, "日本語" * 5]
    whole = Counter((i, *g) for i, t in enumerate(texts) for g in zip([PAD, PAD, *map(ord, t)], [PAD, *map(ord, t)], map(ord, t)))
    for size in (2, 3, 7, 100):
        got = Counter()
        for part in text_parts(texts, size):
            t = Trigrams(part)
            for p, i in enumerate(t.index):
                for k in t.at[t.starts[p] : t.starts[p] + t.lengths[p]]:
                    got[(int(i), int(t.a[k]), int(t.b[k]), int(t.c[k]))] += 1
            assert t.counts.sum() == len(t.at) and (np.bincount(t.at) == t.counts).all()
        assert got == whole


def test_hash_is_the_one_of_spark(spark):
    values = [0, 1, -1, 2**62, -(2**63), 123456789]
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(v,) for v in values], "v long").selectExpr("xxhash64(v)").collect()]
    assert xxhash_longs(np.array(values), 42).tolist() == got


def brute_kneser_ney(texts):
    """p(c | a, b) over a dictionary, in plain recursion."""
    tri = Counter(g for t in texts for g in zip([PAD, PAD, *map(ord, t)], [PAD, *map(ord, t)], map(ord, t)))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def level(counts, context):
        n = [sum(v == k for v in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0
        d = [0] + [min(k - 0.1, max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] and n[1] else 0.5 * k for k in (1, 2, 3)]
        total, cut = defaultdict(int), defaultdict(float)
        for g, v in counts.items():
            total[context(g)] += v
            cut[context(g)] += d[min(v, 3)]
        return (lambda g: max(0, counts.get(g, 0) - d[min(counts.get(g, 0), 3)]) / total[context(g)]), (lambda g: cut[context(g)] / total[context(g)]), total

    s1, g1, _ = level(uni, lambda g: 0)
    s2, g2, t2 = level(bi, lambda g: g[0])
    s3, g3, t3 = level(tri, lambda g: g[:2])
    p1 = lambda c: s1(c) + g1(c) / (len(uni) + 1)
    p2 = lambda b, c: s2((b, c)) + g2((b, c)) * p1(c) if b in t2 else p1(c)
    return lambda a, b, c: s3((a, b, c)) + g3((a, b, c)) * p2(b, c) if (a, b) in t3 else p2(b, c)


def test_model_matches_brute_force_and_sums_to_one(spark):
    texts = [t for t in some_texts() if t]
    docs = spark.createDataFrame([(i, t, "xx", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, key int").repartition(3)
    model, brute = Q.Model.of(Q.kneser_ney(Q.count_trigrams(docs, "lang", "text"))), brute_kneser_ney(texts)
    rng = random.Random(0)
    chars = sorted({ord(c) for t in texts for c in t})
    grams = [tuple(rng.choice([*chars, PAD, 0x4E01]) for _ in range(2)) + (rng.choice([*chars, 0x4E01]),) for _ in range(400)] + [tuple(map(ord, "one")), tuple(map(ord, " tw"))]
    a, b, c = (np.array(x, dtype=np.int64) for x in zip(*grams))
    assert np.allclose(model.log_probabilities("xx", a, b, c), [math.log(brute(*g)) for g in grams], atol=1e-4)
    for a, b in ((PAD, PAD), (ord("o"), ord("n")), (ord("q"), ord(" "))):
        n = len(chars) + 1
        p = np.exp(model.log_probabilities("xx", np.full(n, a), np.full(n, b), np.array([*chars, 0x4E01])))
        assert abs(p.sum() - 1) < 1e-3
    want = -sum(math.log(brute(*g)) for g in zip([PAD, PAD, *map(ord, texts[-1])], [PAD, *map(ord, texts[-1])], map(ord, texts[-1])))
    assert abs(model.surprise("xx", [texts[-1]])[0] / want - 1) < 1e-4


def test_judging_keeps_what_is_usual_and_defines_odd_cases(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    usual = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(80)]
    odd = ["".join(chr(rng.randint(33, 126)) + " " * (rng.random() < 0.2) for _ in range(900)) for _ in range(3)]
    rows = [(i, t, None if i % 2 else "xx", "clash") for i, t in enumerate([*usual, *odd, None, "", "two words", usual[0], "same line here again\n" * 30])]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, q_kept string")
    got = Q.judge(docs).collect()
    assert len(got) == len(rows) + 1
    kept = {r.doc_id: r.q_kept for r in got}
    assert sum(kept[i] for i in range(80)) >= 78
    assert not any(kept[i] for i in (80, 81, 82, 83, 84, 85, 87)) and kept[86] == kept[0]
    assert {r.doc_id: [r.q_words, r.q_word_chars, r.q_symbols, r.q_dup_lines, r.q_repeat_words] for r in got} == {i: brute_statistics(t) for i, t, _, _ in rows}
    assert Q.judge(docs.limit(0)).count() == 0


def brute_bands(rows):
    """{language: (low, high)} from (language, text, surprise): quartiles of distinct texts, each weighing its characters up to 200."""
    out = {}
    for lang in {r[0] for r in rows}:
        bins = Counter()
        for text, s in {(t, s) for k, t, s in rows if k == lang and t}:
            bins[math.floor(s / Q.BIN)] += min(len(text), Q.BAND_CHARS)
        total, upto, cuts = sum(bins.values()), 0, {}
        for b in sorted(bins):
            upto += bins[b]
            for q in (0.25, 0.75):
                if upto >= q * total:
                    cuts.setdefault(q, (b + 0.5) * Q.BIN)
        if cuts:
            spread = max(cuts[0.75] - cuts[0.25], Q.MIN_SPREAD) * Q.FENCE
            out[lang] = (cuts[0.25] - spread, cuts[0.75] + spread)
    return out


def test_bands_and_verdicts_match_brute_force_by_arrays_and_by_joins(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulmnrsté") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 25, 80]))), ["xx", "yy", None][i % 3]) for i in range(60)]
    rows += [(100 + k, rows[1][1], "xx") for k in range(70)] + [(200, None, "zz"), (201, "qj#" * 300, "xx"), (202, "", "xx"), (203, "only short", "ww")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    models = {lang: brute_kneser_ney([t for _, t, k in rows if t and (k or "") == lang]) for lang in ("xx", "yy", "", "ww")}
    grams = lambda t: zip([PAD, PAD, *map(ord, t)], [PAD, *map(ord, t)], map(ord, t))
    mean = {(lang, t): -sum(math.log(models[lang](*g)) for g in grams(t)) / len(t) for lang, t in {(k or "", t) for _, t, k in rows if t}}
    limits = brute_bands([(k or "", t, mean[k or "", t]) for _, t, k in rows if t])
    for entries in (Q.BROADCAST_ENTRIES, 0):
        got = {r.doc_id: r for r in Q.judge(docs, entries=entries).collect()}
        assert got.keys() == {r[0] for r in rows}
        for i, t, k in rows:
            n, _, _, _, repeated = brute_statistics(t)
            failed, lang, r = n < 20 or 100 * repeated > 30 * n, k or "", got[i]
            low, high = limits.get(lang, (-math.inf, math.inf))
            assert (r.q_low is None) == (lang not in limits) and r.q_base_failed == failed
            if lang in limits:
                assert abs(r.q_low - low) < 3 * Q.BIN and abs(r.q_high - high) < 3 * Q.BIN
            if t:
                assert abs(r.q_surprise - mean[lang, t]) < 1e-4
                slack = Q.SHORT / math.sqrt(len(t))
                if min(abs(mean[lang, t] - low + slack), abs(mean[lang, t] - high - slack)) > 0.01:
                    assert r.q_kept == (not failed and low - slack <= mean[lang, t] <= high + slack)
        assert not got[201].q_kept


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 1000).astype(np.uint8)
    starts = np.arange(0, 990, 7)
    ends = np.minimum(starts + rng.integers(0, 8, len(starts)), 1000)
    want = Q._range_hashes(data, starts, ends)
    alone = [Q._range_hashes(data[s:e], np.array([0]), np.array([e - s]))[0] for s, e in zip(starts, ends)]
    assert want.tolist() == alone
    for block in (1, 3, 64, 1000):
        monkeypatch.setattr(Q, "BLOCK", block)
        monkeypatch.setattr(Q, "_POWERS", Q._Powers())
        assert Q._range_hashes(data, starts, ends).tolist() == alone
