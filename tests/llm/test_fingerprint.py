import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from linkwright.llm import fingerprint as P


def brute_fingerprint(text, hashes):
    """128 bits by plain votes; hashes: what xxhash64 gives for the arguments."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    pairs = [(words[i], words[i + 1] if i + 1 < len(words) else None) for i in range(max(len(words) - 1, min(len(words), 1)))]
    votes, total = [0] * 128, 0
    for a, b in pairs:
        weight = min(len(a), P.WEIGHT_CAP)
        total += weight
        for k, h in enumerate((hashes[a, b], hashes[1, b, a])):
            for j in range(64):
                votes[64 * k + j] += weight * (h >> j & 1)
    return sum(1 << j for j, v in enumerate(votes) if 2 * v > total)


def spark_hashes(spark, texts):
    pairs = set()
    for text in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
        pairs |= {(words[i], words[i + 1] if i + 1 < len(words) else None) for i in range(len(words))}
    rows = spark.createDataFrame(sorted(pairs, key=str) or [("", "")], "a string, b string").selectExpr("a", "b", "xxhash64(a, b) h", "xxhash64(1, b, a) g").collect()
    return {(r.a, r.b): r.h & (2**64 - 1) for r in rows} | {(1, r.b, r.a): r.g & (2**64 - 1) for r in rows}


def alike(x, y):
    return max(0.0, math.cos(bin(x ^ y).count("1") * math.pi / 128))


@pytest.mark.parametrize("far", [False, True])
def test_every_column_matches_brute_force(spark, far):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 17))) for _ in range(12)]
    texts = [None, "", "é" * 7, "one", "a b", *(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(30)), "same text", "same text", "same text"]
    pool = range(-(2**62) - 9, 2**62 + 9, 2**57) if far else range(-300, 5000)
    ids = [None, *sorted(rng.sample(pool, len(texts) - 4)), 6000, 6000, 6000]
    docs = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, n_chars string").repartition(5)
    order = {r.t: (r.h, r.g) for r in spark.createDataFrame([(t or "",) for t in texts], "t string").selectExpr("t", "xxhash64(t) h", "xxhash64(1, t) g").collect()}
    rows = sorted(((i is not None, i or 0, order[t or ""], t or "", i) for i, t in zip(ids, texts)))
    edited = []
    for k, (*_, t, _) in enumerate(rows):
        n, after = len(t) // 2, rows[(k + 1) % len(rows)][3]
        edited.append(t[: len(t) - n] + after[:n])
    hashes = spark_hashes(spark, [*(r[3] for r in rows), *edited])
    own, other = ([brute_fingerprint(t, hashes) for t in some] for some in ([r[3] for r in rows], edited))
    want = []
    for k, (*_, t, i) in enumerate(rows):
        within = sum(bin(own[k] ^ f).count("1") <= P.RADIUS for f in own) if i is not None and i % 50 == 0 else None
        want.append((i, len(t), hashlib.sha256(edited[k].encode()).hexdigest(), own[k], other[k], round(alike(own[k], other[k]), 9), round(alike(own[k], own[(k + 1) % len(rows)]), 9), within))
    joined = lambda a, b: (b & (2**64 - 1)) << 64 | a & (2**64 - 1)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, joined(r.fp0, r.fp1), joined(r.edited0, r.edited1), round(r.near_edited, 9), round(r.near_next, 9), r.n_within) for r in P.compare_with_edits(docs, asking=50).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    if not far:
        assert any(w[-1] for w in want)
        assert {(r.doc_id, joined(r.fp0, r.fp1)) for r in P.document_fingerprints(docs).collect()} == {(w[0], w[3]) for w in want}


def test_no_rows_one_row_and_null_id(spark):
    docs = spark.createDataFrame([(None, "only one of them")], "doc_id long, text string")
    assert P.compare_with_edits(docs.limit(0)).count() == 0
    (row,) = P.compare_with_edits(docs).collect()
    assert row.doc_id is None and row.near_next == 1
    assert row.edited_sha256 == hashlib.sha256(b"only oneonly one").hexdigest()


@pytest.mark.parametrize(("radius", "blocks"), [(0, 8), (2, 4), (6, 8), (3, 4), (1, 2)])
def test_tables_find_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(128)
        for _ in range(12):
            v = centre
            for _ in range(rng.randint(0, 8)):
                v ^= 1 << rng.randrange(128)
            values.add(v)
    signed = lambda v: v - 2**64 if v >> 63 else v
    split = lambda v: (signed(v & (2**64 - 1)), signed(v >> 64))
    df = spark.createDataFrame([split(v) for v in values for _ in range(2)], "fp0 long, fp1 long")
    queries = [v for k, v in enumerate(sorted(values)) if k % 5 == 0]
    found = P.within_radius(spark.createDataFrame([split(v) for v in queries], "fp0 long, fp1 long"), df, radius, blocks).collect()
    got = {((r.q0, r.q1), (r.fp0, r.fp1), r.bits) for r in found}
    assert len(got) == len(found)
    assert got == {(split(q), split(v), bin(q ^ v).count("1")) for q in queries for v in values if bin(q ^ v).count("1") <= radius}


def test_likeness_tells_edits_from_strangers(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(40)], "doc_id long, text string")
    got = P.compare_with_edits(docs)
    row = got.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert 0.35 < row[0] < 0.65 and row[1] < 0.2
