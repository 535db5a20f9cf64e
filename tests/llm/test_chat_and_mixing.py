import hashlib
import math
import random
import re

import duckdb

from linkwright.llm import chat, mixing


def brute_copies(rows):
    """Copies of each (doc_id, text, source), by resharing the excess again and again."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    per: dict = {}
    for i, _, s in rows:
        per[s] = per.get(s, 0) + size[i]
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), float(sum(per.values()))
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 3 * per[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * per[s]
        rest -= sum(target[s] for s in over)
        open_ -= over
    out = {}
    for i, _, s in rows:
        rate = target[s] / per[s] if per[s] else 0.0
        draw = int(hashlib.md5(f"42|{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        out[i] = math.floor(rate + 1e-12) + (draw < rate - math.floor(rate + 1e-12))
    return out


def documents():
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["b", "a", "É", None, "tiny"] if i % 9 == 0 else ["a", "b", "c"])) for i in range(300)]
    return [*rows, (400, None, "nothing"), (401, " \n", "nothing"), (402, "x y z", "tiny")]


def test_mixture_matches_resharing(spark):
    rows = documents()
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, mix_size int").repartition(3)
    plan = mixing.plan_mixture(docs)
    got = {r.doc_id: r for r in plan.collect()}
    assert {i: r.mix_copies for i, r in got.items()} == brute_copies(rows)
    assert all(r.mix_taken == r.mix_size * r.mix_copies and r.mix_copies <= 3 for r in got.values())
    assert got[402].mix_size == 2 and got[400].mix_target == 0
    copies = {}
    for r in mixing.mix_sources(docs.drop("mix_size")).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: r.mix_copies for i, r in got.items() if r.mix_copies}
    assert mixing.plan_mixture(docs.limit(0)).count() == 0


def test_words_of_a_source_come_near_its_target(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 as int)) as text", "concat('s', id % 4) as source")
    for r in mixing.plan_mixture(docs).groupBy("source").agg({"mix_taken": "sum", "mix_target": "max"}).collect():
        assert abs(r["sum(mix_taken)"] / r["max(mix_target)"] - 1) < 0.08


def test_the_mixture_keeps_columns_that_look_like_its_own(spark):
    rows = [(i, "one two", f"s{i % 2}", "mine", i, "key") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copy string, mix_size long, own_column_0 string")
    mixed = mixing.mix_sources(docs)
    assert mixed.dtypes == docs.dtypes
    assert {(r.doc_id, r.mix_copy, r.mix_size, r.own_column_0) for r in mixed.collect()} <= {(i, "mine", i, "key") for i in range(40)} and mixed.count() > 0


def turns():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["ann", "bob", "cy d", "system", "", None]), rng.choice([None, "", "hi <|im_end|> there", "é\nb", "ok"])) for c in (1, 2, None) for t in range(150)]
    return [*rows, *rows[:5], (1, None, "ann", "first"), (3, 0, "system", "alone"), (1, 7, "bob", "tie"), (1, 7, "ann", "tie")]


def brute_rendering(rows):
    """{(conversation, participant): [(text of a chunk, spans)]}"""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, s or "unknown", b or "") for c, t, s, b in rows if c == conv))
        groups: dict = {}
        for known, t, s, b in own:
            groups.setdefault(t // 64 if known else None, []).append((s, b))
        for who in {s for _, _, s, _ in own} - {"system"}:
            chunks = []
            for k in sorted(groups, key=lambda k: (k is not None, k or 0)):
                for at in range(0, len(groups[k]), 64):
                    text, spans = "", []
                    for s, b in groups[k][at : at + 64]:
                        kind = "assistant" if s == who else "system" if s == "system" else "user name=" + re.sub(r"\s", "_", s)
                        text += f"<|im_start|>{kind}\n"
                        said = b.replace("<|", "< |") + "<|im_end|>"
                        if s == who:
                            spans.append((len(text), len(text) + len(said)))
                        text += said + "\n"
                    chunks.append((text, spans))
            out[conv, who] = chunks
    return out


def test_perspectives_match_brute_force_and_sql(spark, tmp_path):
    rows = turns()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string").repartition(4)
    got: dict = {}
    for r in sorted(chat.rotate_perspectives(df).collect(), key=lambda r: (r.chunk is not None, r.chunk or 0, r.part)):
        got.setdefault((r.conv_id, r.perspective), []).append((r.rendered, [(s.begin, s.end) for s in r.spans]))
    assert got == brute_rendering(rows)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
    df.drop("chunk").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(chat.ORACLE)
    names = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in chat.query(spark, str(tmp_path)).select(*names).collect()) == want


def test_a_crowd_of_ties_is_cut_into_parts(spark):
    df = spark.range(1000).selectExpr("1L as conv_id", "5L as turn", "concat('p', id % 2) as role", "cast(id as string) as text")
    rows = chat.rotate_perspectives(df).collect()
    assert len(rows) == 2 * 16 and max(r.n_turns for r in rows) == 64 and sum(r.n_turns for r in rows) == 2000
