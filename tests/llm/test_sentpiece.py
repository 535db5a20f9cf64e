import random

import numpy as np
import pytest

from linkwright.llm import sentpiece as S


@pytest.fixture(scope="module")
def model():
    return S.read_model()


def some_texts():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghinorstué") for _ in range(rng.randint(1, 9)))
    texts = ["", "a", " ", " lead and  double\n\ttrail ", "日本語のテキスト", "🙂 \x00 é", "ﬁ Ａ", "x" * 700, " " * 400, "thinking" * 90, "a b " * 200]
    texts += [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(15)]
    texts += ["".join(rng.choice("abcdeéthin日 \n🙂") for _ in range(rng.randint(1, 500))) for _ in range(10)]
    return texts


def test_ids_are_those_of_the_library_and_decode(spark, model):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)] + [(900, None, None)], "doc_id long, text string, matrix string").repartition(4)
    sp = S.Vocabulary(model).sp
    for chunk, group in ((S.CHUNK, S.GROUP), (100, 3), (67, 1)):
        tokens = S.encode(docs, model, carry=("doc_id", "matrix"), chunk=chunk, group=group)
        got: dict[int, list] = {}
        for r in sorted(tokens.collect(), key=lambda r: (r.doc_id, r.chunk)):
            assert r.lossless and r.n_tokens == len(r.ids)
            got.setdefault(r.doc_id, []).extend(r.ids)
        assert got == {**{i: sp.encode(t) for i, t in enumerate(texts)}, 900: []}
        back: dict[int, str] = {}
        for r in sorted(S.decode(tokens, model).collect(), key=lambda r: (r.doc_id, r.chunk)):
            back[r.doc_id] = back.get(r.doc_id, "") + r.text
        assert back == {**dict(enumerate(texts)), 900: ""}
    assert S.encode(docs.limit(0), model).count() == 0


def test_mark_itself_is_reported(spark, model):
    (row,) = S.encode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), model).collect()
    assert not row.lossless
    with pytest.raises(ValueError):
        S.encode(spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, ids int"), model, carry=("ids",))


def test_products_combine_in_any_order():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((m, n)) < 0.5, 0, S.NONE).astype(np.float32) for m, n in ((3, 4), (4, 2), (2, 5)))
    assert np.array_equal(S.multiply(S.multiply(a, b), c), S.multiply(a, S.multiply(b, c)))


def test_one_path_is_left_at_each_boundary(model):
    v = S.Vocabulary(model)
    for text in some_texts():
        marked, chunks = S.MARK + text.replace(" ", S.MARK), []
        for cut in range(0, len(marked), 64):
            end, low = min(cut + 64, len(marked)), max(0, cut - S.MARGIN)
            chunks.append(S.Chunk(v, marked[low : end + S.MARGIN], cut - low, end - low, cut == 0, end == len(marked)))
        ms = [c.matrix() for c in chunks]
        ahead, behind = [np.zeros((1, 1), np.float32)], [np.zeros((1, 1), np.float32)]
        for m in ms:
            ahead.append(S.multiply(ahead[-1], m))
        for m in reversed(ms):
            behind.append(S.multiply(m, behind[-1]))
        assert all(((f[0] + b[:, 0]) == 0).sum() == 1 for f, b in zip(ahead, behind[::-1]))
