"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Runs (shards) of similar size, that is of one tier (powers of
RATIO), are merged once there are FAN_IN of them, in order of birth, into files of about the target size; a file of half the
target or more is done. Rounds follow until no tier has FAN_IN runs. What a reader sees is named by a manifest with a
version: each append and each wave of merges writes its files first and then commits the next manifest by a rename that
fails if that version exists, so a reader sees the one state or the other, a writer that lost the race tries again from
what it finds, and a job that dies leaves files that no manifest names (vacuum deletes them, and those that only old
versions name). That rename must be atomic in the store (HDFS, local files; not plain S3). A wave of merges is one job with a task per
bundle of runs, without a shuffle.

A manifest's file holds what the version adds and takes away, every FULL-th one all runs, so a commit writes in proportion to its
change. The driver holds the manifest: one short entry per file.

Defined results: rows are kept as they are (nulls, repeats, empty texts); an empty arrival adds no shard but a version; columns that
an arrival lacks are null in it, new ones are added to the schema, a column of another type is an error; names that begin with
"__" are the store's own.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm.batches import fresh
from linkwright.plans.staging import file_system, new_path, read_text

TARGET_BYTES = 128 << 20
SMALLEST = 1 << 20
RATIO = 4
FAN_IN = 4
#: Bundles that are merged in one job and committed together.
WAVE = 64
#: Versions from one manifest with all runs to the next.
FULL = 16
ARRIVALS = 8


class CommitConflict(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    path: str
    rows: int
    bytes: int
    born: int
    generation: int = 0


@dataclass
class Manifest:
    version: int = 0
    schema: str = ""
    runs: list[Run] = field(default_factory=list)


def tier(size: int, smallest: int = SMALLEST, ratio: int = RATIO) -> int:
    return 0 if size < smallest else 1 + int(math.log(size / smallest, ratio))


def plan(runs: Sequence[Run], target: int = TARGET_BYTES, smallest: int = SMALLEST, ratio: int = RATIO, fan_in: int = FAN_IN) -> list[list[Run]]:
    """Bundles of two or more runs of one tier, in order of birth, each closed once it reaches the target."""
    tiers: dict[int, list[Run]] = {}
    for r in sorted(runs, key=lambda r: (r.born, r.path)):
        if 2 * r.bytes < target:
            tiers.setdefault(tier(r.bytes, smallest, ratio), []).append(r)
    out = []
    for _, own in sorted(tiers.items()):
        if len(own) < fan_in:
            continue
        bundle, size = [], 0
        for r in own:
            bundle.append(r)
            size += r.bytes
            if size >= target:
                out.append(bundle)
                bundle, size = [], 0
        out.append(bundle)
    return [b for b in out if len(b) > 1]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self._root = file_system(spark, self.root)
        # a union of single partitions must keep them apart; a session of its own leaves the caller's settings alone
        self._merging = spark.newSession()
        self._merging.conf.set("spark.sql.unionOutputPartitioning", "false")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        where = self._path("manifest")
        if not self.fs.exists(where):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(where)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """That version, or the last one; version 0 is empty."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else 0
        if version == 0:
            return Manifest()
        changes = []
        while True:
            raw = json.loads(self._text(version))
            changes.append(raw)
            if "runs" in raw:
                break
            version -= 1
        runs = {r["path"]: Run(**r) for r in changes[-1]["runs"]}
        for raw in reversed(changes[:-1]):
            for path in raw["gone"]:
                del runs[path]
            runs |= {r["path"]: Run(**r) for r in raw["added"]}
        return Manifest(changes[0]["version"], changes[0]["schema"], sorted(runs.values(), key=lambda r: (r.born, r.path)))

    def _text(self, version: int) -> str:
        return read_text(self.spark, f"{self.root}/manifest/v{version:012d}.json")

    def commit(self, new: Manifest, old: Manifest | None = None) -> Manifest:
        """Write beside, then rename: the rename is the commit, and fails if the version exists. old: the version before, which changes are told from."""
        body = {"version": new.version, "schema": new.schema}
        if old is None or old.version == 0 or new.version % FULL == 0:
            body["runs"] = [asdict(r) for r in new.runs]
        else:
            before, after = {r.path for r in old.runs}, {r.path for r in new.runs}
            body |= {"gone": sorted(before - after), "added": [asdict(r) for r in new.runs if r.path not in before]}
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        self.fs.mkdirs(self._path("manifest"))
        draft, final = self._path("manifest", f".{uuid.uuid4().hex}"), self._path("manifest", f"v{new.version:012d}.json")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(f"version {new.version} exists") from None
            raise
        return new

    def _schema(self, m: Manifest) -> T.StructType:
        return T.StructType.fromJson(json.loads(m.schema)) if m.schema else T.StructType([])

    def _merged(self, m: Manifest, df: DataFrame) -> str:
        old = self._schema(m)
        known = {f.name: f.dataType for f in old.fields}
        for f in df.schema.fields:
            if f.name in known and known[f.name] != f.dataType:
                raise ValueError(f"{f.name} is {known[f.name].simpleString()} in the store and {f.dataType.simpleString()} in the arrival")
        new = [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name not in known]
        return json.dumps(T.StructType([*old.fields, *new]).jsonValue())

    def _written(self, folder: str, schema: T.StructType) -> list[tuple[str, int, int]]:
        """(path, rows, bytes) of the files that have rows, from their footers, in order of path."""
        files = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).groupBy("path", "size").count()
        return sorted((r.path, r["count"], r.size) for r in files.collect())

    def _grow(self, df: DataFrame, added: Sequence[tuple[str, int, int]], tries: int = 20) -> Manifest:
        for _ in range(tries):
            now = self.manifest()
            born = max((r.born for r in now.runs), default=-1) + 1
            try:
                return self.commit(Manifest(now.version + 1, self._merged(now, df), [*now.runs, *[Run(p, n, b, born + k) for k, (p, n, b) in enumerate(added)]]), now)
            except CommitConflict:
                continue
        raise CommitConflict(f"no commit in {tries} tries")

    def append(self, df: DataFrame) -> Manifest:
        """One arrival: the partitions of df become shards as they are."""
        self._merged(self.manifest(), df)
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        return self._grow(df, self._written(folder, df.schema))

    def append_arrivals(self, df: DataFrame, arrival: str) -> Manifest:
        """Several arrivals in one pass, told apart by a column (not stored) and committed in its order, one version each."""
        self._merged(self.manifest(), df.drop(arrival))
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        body = df.drop(arrival)
        df.withColumnRenamed(arrival, "__arrival").write.option("compression", "zstd").partitionBy("__arrival").parquet(folder)
        groups: dict[str, list] = {}
        if self.fs.exists(self._path("data", folder.rsplit("/", 1)[1])):
            for row in self._written(folder, body.schema):
                groups.setdefault(row[0].rsplit("/", 2)[1], []).append(row)
        out = self.manifest()
        for name in sorted(groups, key=lambda n: (len(n), n)):
            out = self._grow(body, groups[name])
        return out

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m.runs:
            return self.spark.createDataFrame([], self._schema(m))
        return self.spark.read.schema(self._schema(m)).parquet(*[r.path for r in m.runs])

    def compact(self, target: int = TARGET_BYTES, smallest: int = SMALLEST, ratio: int = RATIO, fan_in: int = FAN_IN) -> Manifest:
        """Merge until no tier has fan_in runs. A wave that lost its race to another writer is planned anew; its files go with vacuum."""
        while True:
            now = self.manifest()
            bundles = plan(now.runs, target, smallest, ratio, fan_in)[:WAVE]
            if not bundles:
                return now
            schema = self._schema(now)
            folder = f"{self.root}/data/m-{uuid.uuid4().hex}"

            # a partition is a bundle, and a file of the result a partition, in their order
            parts = [self._merging.read.schema(schema).parquet(*[r.path for r in b]).coalesce(1) for b in bundles]
            reduce(DataFrame.unionAll, parts).write.option("compression", "zstd").parquet(folder)
            written = self._written(folder, schema)
            if [n for _, n, _ in written] != [sum(r.rows for r in b) for b in bundles]:
                raise RuntimeError(f"{folder} hasn't the rows of its bundles")
            added = [Run(path, rows, size, b[0].born, 1 + max(r.generation for r in b)) for (path, rows, size), b in zip(written, bundles)]
            gone = {r.path for b in bundles for r in b}
            while True:
                now = self.manifest()
                if not gone <= {r.path for r in now.runs}:
                    break
                try:
                    self.commit(Manifest(now.version + 1, now.schema, sorted([*[r for r in now.runs if r.path not in gone], *added], key=lambda r: (r.born, r.path))), now)
                    break
                except CommitConflict:
                    continue

    def vacuum(self, keep: int = 1) -> int:
        """Delete all files that none of the last keep versions names; not while another writer is at work. Returns how many."""
        named = {r.path.split("/data/", 1)[1] for v in self.versions()[-keep:] for r in self.manifest(v).runs}
        found = self.fs.listFiles(self._path("data"), True) if self.fs.exists(self._path("data")) else None
        gone = 0
        while found is not None and found.hasNext():
            path = found.next().getPath()
            name = path.toString().split("/data/", 1)[1]
            if name.endswith(".parquet") and name not in named:
                gone += bool(self.fs.delete(path, False))
        return gone


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in ARRIVALS arrivals, compacted: where the last manifest keeps each of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = Store(spark, new_path(spark, "shards"))
    arrival = fresh("arrival", docs.columns)
    store.append_arrivals(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))), arrival)
    last = store.compact()
    store.vacuum()
    table = spark.createDataFrame([(r.path.rsplit("/", 1)[1], i, r.generation, r.rows) for i, r in enumerate(last.runs)], "file string, shard int, generation int, shard_rows long")
    rows = store.read().select("doc_id", "n_chars", F.col("_metadata.file_name").alias("file"))
    small = F.broadcast(table) if len(last.runs) <= 100_000 else table
    return rows.join(small, "file").select("doc_id", "n_chars", "shard", "generation", "shard_rows", F.lit(last.version).alias("version"))
