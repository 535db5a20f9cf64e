import random
from collections import Counter

import pytest

import corpus_pipeline
from linkwright.llm import mixing, quality, sentpiece
from tests.llm.test_chat_and_mixing import brute_copies
from tests.llm.test_langid import brute_letters
from tests.llm.test_neardup import brute_similar
from tests.llm.test_quality import brute_statistics


def corpus():
    rng = random.Random(12)
    tongues = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(250)] for k, letters in (("en", "abdeghilnorstw"), ("fr", "aceéèilmnoprsu"))}
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "fr"])
        rows.append((i, " ".join(rng.choice(tongues[lang]) for _ in range(rng.randint(60, 140))), None if i % 17 == 5 else lang, f"src{i % 3}"))
    rows += [(100 + k, rows[k][1], rows[k][2] or "en", "src0") for k in range(0, 40, 2)]
    for k in range(1, 40, 2):
        words = rows[k][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((300 + k, " ".join(words), rows[k][2] or "en", "src1"))
    rows += [(200, None, "en", "src1"), (201, "", "fr", None), (202, "too short", "en", "src1"), (203, "again and again here we are now " * 30, "en", "src2"), (204, "12 34 56 78 " * 40, "en", "src2")]
    return rows


def brute_language(rows):
    """Languages by plain sets of trigrams."""
    from zlib import crc32

    counts: dict[str, Counter] = {}
    grams = lambda t: (lambda s: list(zip([None, None, *s], [None, *s], s)))(brute_letters(t))
    for i, text, lang, _ in rows:
        if lang and crc32(str(i).encode()) % 3 != 1:
            counts.setdefault(lang, Counter()).update(grams(text))
    share = {k: {g: n / c.total() for g, n in c.items()} for k, c in counts.items()}
    sets = {k: {g for g, p in s.items() if p >= 2e-6 and p >= 0.1 * max(o.get(g, 0) for o in share.values())} for k, s in share.items()}
    out = {}
    for i, text, _, _ in rows:
        own = grams(text)
        cover = {k: sum(g in s for g in own) / max(1, len(own)) for k, s in sets.items()}
        best = max(sorted(cover), key=cover.get) if brute_letters(text).strip() and cover else "und"
        out[i] = (best, cover.get(best, 0))
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, text, _, _ in rows:
        r, (words, _, _, _, repeated) = judged[i], brute_statistics(text)
        assert r.q_base_failed == (words < 20 or 100 * repeated > 30 * words)
    kept = [r for r in rows if judged[r[0]].q_kept]
    assert {r[0] for r in rows[:90]} <= {r[0] for r in kept} and not {200, 201, 202, 203} & {r[0] for r in kept}
    language = brute_language(kept)
    kept = [(i, t, lang or language[i][0], s) for i, t, lang, s in kept if language[i][0] != "und" and language[i][1] >= corpus_pipeline.LEAST_COVER]
    kept.sort()
    root = brute_similar([t for _, t, _, _ in kept])
    assert sum(root[k] != k for k in range(len(root))) >= 35
    kept = [r for k, r in enumerate(kept) if root[k] == k]
    copies = brute_copies([(i, t, s) for i, t, _, s in kept])
    sp = sentpiece.Vocabulary(sentpiece.read_model()).sp
    want = Counter()
    for i, text, lang, source in kept:
        want[(i, lang, source, tuple(sp.encode(text)))] += copies[i]
    got = Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_on_an_empty_table(spark, tmp_path, extra):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", q_kept int, rid int, chunk int, q_low string, own_column_4 string" if extra else "")
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_name_five_operators():
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.quality_rules, corpus_pipeline.language_id, corpus_pipeline.near_duplicates, corpus_pipeline.source_mixture, corpus_pipeline.sentencepiece]
    assert corpus_pipeline.ORACLE_SQL is None and mixing.MAX_REPEAT == 3


def test_language_stage_learns_from_every_row(spark, tmp_path):
    from zlib import crc32

    held = [i for i in range(60) if crc32(str(i).encode()) % 3 == 1][:6]
    rows = [(i, "жёлтый лист дерево парк река " * 8, "ru") for i in held] + [(i, "green river trading north road " * 8, "en") for i in range(100, 110)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang) for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()} == {(i, lang) for i, _, lang in rows}


def test_stages_return_the_columns_that_came_in(spark, tmp_path):
    rows = [(i, t, lang, s, "note", i, "fp") for i, t, lang, s in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, q_low string, l_pred long, own_column_5 string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        assert {(r.doc_id, r.q_low, r.l_pred, r.own_column_5) for r in out.collect()} <= {(r[0], "note", r[0], "fp") for r in rows}, name
