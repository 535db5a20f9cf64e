import pytest
from pyspark.sql import functions as F

from linkwright.llm.shards import CommitConflict, Manifest, Run, Store, plan, tier
from linkwright.plans.staging import new_path


def test_plan_merges_similar_sizes_alone():
    runs = [Run(f"s{i}", 1, 900, i) for i in range(9)] + [Run(f"m{i}", 1, 5000, 20 + i) for i in range(3)] + [Run("done", 1, 60_000, 40)]
    bundles = plan(runs, target=4000, smallest=1000, ratio=4, fan_in=4)
    assert [[r.path for r in b] for b in bundles] == [["s0", "s1", "s2", "s3", "s4"], ["s5", "s6", "s7", "s8"]]
    assert plan(runs, target=100_000, smallest=1000, ratio=4, fan_in=10) == []
    assert [tier(n, 1000, 4) for n in (0, 999, 1000, 3999, 4000, 16_000)] == [0, 0, 1, 1, 2, 3]


def rows(df):
    return sorted(map(repr, df.collect()))


def test_appends_compaction_and_time_travel(spark):
    store = Store(spark, new_path(spark, "store"))
    assert store.read().count() == 0 and store.versions() == []
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "t" * i, "x") for i in range(200)] + [(3, "ttt", "x")], "doc_id long, text string, file string")
    for k in range(5):
        store.append(docs.filter(F.col("doc_id") % 5 == k).coalesce(1))
    store.append(docs.limit(0))
    assert store.manifest().version == 6 and len(store.manifest().runs) == 5
    before = rows(store.read())
    assert before == rows(docs)
    last = store.compact(target=1 << 20, smallest=1 << 14, fan_in=4)
    assert last.version == 7 and len(last.runs) == 1 and last.runs[0].generation == 1
    assert rows(store.read()) == before == rows(store.read(6))
    assert store.vacuum(keep=2) == 0 or rows(store.read(6)) == before
    store.vacuum()
    assert rows(store.read()) == before
    assert store.compact(target=1 << 20, smallest=1 << 14, fan_in=4).version == 7


def test_each_bundle_becomes_a_file(spark):
    store = Store(spark, new_path(spark, "store"))
    docs = spark.range(0, 4000, 1, 16).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    store.append(docs)
    size = store.manifest().runs[0].bytes
    last = store.compact(target=5 * size, smallest=1 << 10, ratio=4, fan_in=4)
    assert 3 <= len(last.runs) <= 4 and rows(store.read()) == rows(docs)
    assert sum(r.rows for r in last.runs) == 4000


def test_arrivals_in_one_pass_and_new_columns(spark):
    store = Store(spark, new_path(spark, "store"))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("when"))
    assert store.append_arrivals(docs, "when").version == 3
    store.append(spark.createDataFrame([(99, "new")], "doc_id long, note string"))
    assert sorted((r.doc_id, r.note) for r in store.read().collect()) == sorted([(i, None) for i in range(40)] + [(99, "new")])
    assert rows(store.compact(target=1 << 30, fan_in=2) and store.read()) == rows(store.read(4))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("a",)], "doc_id string"))


def test_a_version_is_committed_once(spark):
    store = Store(spark, new_path(spark, "store"))
    store.commit(Manifest(1, "", []))
    with pytest.raises(CommitConflict):
        store.commit(Manifest(1, "", []))
    assert store.versions() == [1]
    names = [f.getPath().getName() for f in store.fs.listStatus(store._path("manifest"))]
    assert [n for n in names if not n.endswith(".crc")] == ["v000000000001.json"]


def test_manifests_hold_changes_and_all_runs_now_and_then(spark):
    import json

    store = Store(spark, new_path(spark, "store"))
    runs, old = [], None
    for v in range(1, 40):
        runs = [r for r in runs if v % 5 or r.born % 2] + [Run(f"p{v}", v, v, v)]
        old = store.commit(Manifest(v, str(v), runs), old)
        assert store.manifest().runs == runs and store.manifest().schema == str(v)
    whole = [v for v in range(1, 40) if "runs" in json.loads(store._text(v))]
    assert whole == [1, 16, 32]
    assert [r.born for r in store.manifest(7).runs] == [1, 3, 5, 6, 7]


def test_the_query_places_every_document_once(spark, tmp_path):
    from linkwright.llm import shards

    docs = spark.createDataFrame([(i, None if i % 9 == 0 else "text " * (i % 40), i, "own") for i in range(300)] + [(7, "again", 1, None)], "doc_id long, text string, n_chars long, arrival string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = shards.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == sorted((r.doc_id, r.n_chars) for r in docs.collect())
    shards_of = {r.shard: r for r in got}
    for k, r in shards_of.items():
        assert r.shard_rows == sum(x.shard == k for x in got) and r.version == got[0].version
    assert sorted(shards_of) == list(range(len(shards_of))) and any(r.generation for r in got)
