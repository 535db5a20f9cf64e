"""Toxicity by a convolutional text classifier in numpy.

A word (letters and digits in lower case) has the sum of two hashed embeddings. Filters of widths 1, 2 and 3 run over
the whole text, their rectified maxima go into a logistic unit. The first dimension of the embeddings begins as
the smoothed log odds of its bucket in the training rows; Adam (Adagrad for embeddings) then trains all of
it. Training rows are all labelled ones without the held-out fold, whole texts. Thresholds are calibrated by language on a
fifth of them that isn't trained on: they decide "flagged", while predicted is score >= 0.5; language is no input of the score.

Defined results: a null text is as empty; an empty one, or one without words, gets the score of no evidence; a language that
calibration has not seen has threshold 0.5; without labels every score is 0.5; repeated rows each get their
row; an empty table gives no rows; further columns are carried along (existing t_* columns are replaced). Filters run over
parts of PART_WORDS words, so beside a long text itself memory is some 60 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm.batches import slices, with_columns
from linkwright.llm.labelled import HELD_OUT, Adam, Sample, every, fold, sigmoid
from linkwright.llm.quality import _range_hashes
from linkwright.plans.staging import discard, staged

BUCKET_BITS = 17
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Code points of texts that are taken together, and words whose activations are held at once.
PART_CHARS, PART_WORDS = 1 << 20, 1 << 16
#: Numbers of an array that executors add up at once.
PIECE = 1 << 17
_NONE = 1 << BUCKET_BITS
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TAPS = sum(WIDTHS)


def word_buckets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two buckets for each word of all texts, and how many words each text has."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], _LETTER[data], [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    h = _range_hashes(data, starts, ends)
    low = np.uint64(_NONE - 1)
    sizes = np.diff(np.searchsorted(starts, offsets))
    return (h & low).astype(np.int32), ((h >> np.uint64(BUCKET_BITS)) & low).astype(np.int32), sizes


def _laid_out(one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with as many empty ones after each text that no filter runs into the next; begin and length (1 at least) of each text."""
    gap = max(WIDTHS) - 1
    room = np.maximum(sizes, 1) + gap
    begin = np.cumsum(room) - room
    at = np.arange(len(one)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    a = np.full(int(room.sum()), _NONE, np.int32)
    b = a.copy()
    a[at], b[at] = one, two
    return a, b, begin, np.maximum(sizes, 1)


class Classifier:
    def __init__(self, params: dict[str, np.ndarray], shift: float = 0.0):
        self.p, self.shift = params, shift

    @classmethod
    def fresh(cls, seed: int = 7) -> Classifier:
        rng = np.random.default_rng(seed)
        table = lambda: np.concatenate([rng.normal(0, 0.05, (_NONE, DIMENSIONS)), np.zeros((1, DIMENSIONS))]).astype(np.float32)
        return cls({"e1": table(), "e2": table(), "w": rng.normal(0, 0.3, (DIMENSIONS, _TAPS * FILTERS)).astype(np.float32), "b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "o": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)})

    def _activations(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(positions, filters): every filter at every word, before the maximum."""
        x = self.p["e1"][a] + self.p["e2"][b]
        y = x @ self.p["w"]
        gap = max(WIDTHS) - 1
        y = np.concatenate([y, np.zeros((gap, y.shape[1]), np.float32)])
        n, out, tap = len(a), [], 0
        for width in WIDTHS:
            total = y[:n, tap * FILTERS : (tap + 1) * FILTERS].copy()
            for k in range(1, width):
                total += y[k : n + k, (tap + k) * FILTERS : (tap + k + 1) * FILTERS]
            out.append(total)
            tap += width
        return np.concatenate(out, axis=1) + self.p["b"]

    def _pooled(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(texts, filters): the maxima over each text, part by part."""
        top = np.full((len(begin), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        gap = max(WIDTHS) - 1
        for at in range(0, len(a), PART_WORDS):
            end = min(at + PART_WORDS, len(a))
            act = self._activations(a[at : end + gap], b[at : end + gap])
            some = np.flatnonzero((begin < end) & (begin + size > at))
            bounds = np.stack([np.maximum(begin[some], at), np.minimum(begin[some] + size[some], end)], axis=1).ravel() - at
            if len(some):
                part = np.maximum.reduceat(np.concatenate([act, act[-1:]]), bounds, axis=0)[::2]
                top[some] = np.maximum(top[some], part)
        return top

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        out = np.empty(len(texts))
        begin = held = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or (i > begin and held + len(texts[i]) > PART_CHARS):
                if i > begin:
                    h = np.maximum(self._pooled(*_laid_out(*word_buckets(texts[begin:i]))), 0)
                    out[begin:i] = sigmoid(h @ self.p["o"] + self.p["c"] + self.shift)
                begin, held = i, 0
            if i < len(texts):
                held += len(texts[i])
        return out

    def _best(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, filters) twice: the maxima over each text and the first words they are at, part by part."""
        top = np.full((len(begin), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        where = np.zeros(top.shape, np.int64)
        gap = max(WIDTHS) - 1
        for at in range(0, len(a), PART_WORDS):
            end = min(at + PART_WORDS, len(a))
            act = self._activations(a[at : end + gap], b[at : end + gap])[: end - at]
            for k in np.flatnonzero((begin < end) & (begin + size > at)):
                low = max(begin[k], at) - at
                own = act[low : min(begin[k] + size[k], end) - at]
                first = own.argmax(axis=0)
                value = np.take_along_axis(own, first[None, :], axis=0)[0]
                better = value > top[k]
                top[k][better], where[k][better] = value[better], (at + low + first)[better]
        return top, where

    def begin_with_log_odds(self, seen: dict[str, np.ndarray], ones: float, zeros: float) -> None:
        """seen: for each table, rows with label 0 and 1 that have a word in each bucket; ones, zeros: rows of either label."""
        for name in ("e1", "e2"):
            of_zero, of_one = seen[name]
            odds = np.log((of_one + 1) / (ones + 2)) - np.log((of_zero + 1) / (zeros + 2))
            self.p[name][:_NONE, 0] = np.where(of_one + of_zero > 0, odds / 4, 0)
        w = self.p["w"].reshape(DIMENSIONS, _TAPS, FILTERS)
        w[0] = np.abs(w[0])
        w[0, 0, 0], self.p["b"][0], self.p["o"][0], self.p["c"][0] = 2.0, -1.5, 2.0, -1.0

    def epoch(self, slices_of: Iterator[tuple[list[str], np.ndarray]], squares: dict[str, np.ndarray], seed: int) -> int:
        """One pass over slices of (texts, labels), in batches shuffled within each slice; how many rows. Gradients go through the positions of the maxima alone."""
        rng, rows = np.random.default_rng(seed), 0
        dense = Adam({k: self.p[k] for k in ("w", "b", "o", "c")}, RATE)
        filters = len(WIDTHS) * FILTERS
        offset = np.concatenate([[t] * FILTERS for t in np.cumsum([0, *WIDTHS[:-1]])])
        column = np.tile(np.arange(FILTERS), len(WIDTHS))
        for texts, y in slices_of:
            one, two, sizes = word_buckets(texts)
            ends = np.cumsum(sizes)
            rows += len(texts)
            for docs in np.array_split(rng.permutation(len(sizes)), max(1, len(sizes) // BATCH)):
                pick = np.concatenate([np.arange(ends[d] - sizes[d], ends[d]) for d in docs])
                a, b, begin, size = _laid_out(one[pick], two[pick], sizes[docs])
                top, at = self._best(a, b, begin, size)
                h = np.maximum(top, 0)
                g = ((sigmoid(h @ self.p["o"] + self.p["c"]) - y[docs]) / len(docs)).astype(np.float32)
                grads = {k: np.zeros_like(self.p[k]) for k in ("w", "b")}
                grads["o"], grads["c"] = h.T @ g + 1e-4 * self.p["o"], np.array([g.sum()], np.float32)
                back = g[:, None] * self.p["o"][None, :] * (top > 0)
                grads["b"] = back.sum(axis=0)
                w = self.p["w"].reshape(DIMENSIONS, _TAPS, FILTERS)
                gw = grads["w"].reshape(DIMENSIONS, _TAPS, FILTERS)
                moved: list[tuple[np.ndarray, np.ndarray]] = []
                for f in range(filters):
                    width = WIDTHS[f // FILTERS]
                    for k in range(width):
                        where = np.minimum(at[:, f] + k, len(a) - 1)
                        x = self.p["e1"][a[where]] + self.p["e2"][b[where]]
                        gw[:, offset[f] + k, column[f]] += x.T @ back[:, f]
                        moved.append((where, back[:, f, None] * w[None, :, offset[f] + k, column[f]]))
                where, step = np.concatenate([m[0] for m in moved]), np.concatenate([m[1] for m in moved])
                for name, ids in (("e1", a), ("e2", b)):
                    touched, at_row = np.unique(ids[where], return_inverse=True)
                    total = np.zeros((len(touched), DIMENSIONS), np.float32)
                    np.add.at(total, at_row, step)
                    total[touched == _NONE] = 0
                    squares[name][touched] += (total**2).mean(axis=1, keepdims=True)
                    self.p[name][touched] -= 0.02 * total / np.sqrt(squares[name][touched])
                dense.step(grads)
        return rows


def _slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(texts, labels) of batches of (text, y)."""
    for batch in slices(batches, 0):
        yield batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)


def _each_task(rows: DataFrame, f: Callable, name: str) -> Iterator[tuple[str, np.ndarray]]:
    """(name, flat array): the sum over all tasks of what f gives for the slices of each. Executors add up, piece by piece and in the order of tasks, so
    the driver takes the sums alone, and all of them at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, v in f(_slices_of(batches)).items():
            flat = np.ascontiguousarray(v, np.float32 if v.dtype == np.float32 else np.float64).ravel()
            for at in range(0, len(flat), PIECE):
                piece = flat[at : at + PIECE]
                # the last piece tells the length, others without anything in them are left out
                if piece.any() or at + PIECE >= len(flat):
                    yield pa.RecordBatch.from_pydict({"name": [k], "at": [at], "task": [task], "data": [piece.tobytes()], "single": [flat.dtype == np.float32]})

    def add(key: tuple, pieces: pa.Table) -> pa.Table:
        kind = np.float32 if pieces.column("single")[0].as_py() else np.float64
        pieces = pieces.sort_by("task")
        total = np.frombuffer(pieces.column("data")[0].as_py(), kind).copy()
        for k in range(1, pieces.num_rows):
            total += np.frombuffer(pieces.column("data")[k].as_py(), kind)
        return pa.table({"name": [key[0].as_py()], "at": [key[1].as_py()], "data": [total.tobytes()], "single": [kind is np.float32]})

    # as many tasks as there are cores, however many files: each gives all weights
    few = rows.select("text", "y").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    pieces = few.mapInArrow(run, "name string, at long, task long, data binary, single boolean")
    table = staged(pieces.groupBy("name", "at").applyInArrow(add, "name string, at long, data binary, single boolean"), name)
    found, out = table.collect(), {}
    discard(table)
    # the last piece of each array comes first and tells its length
    for r in sorted(found, key=lambda r: (r.name, -r.at)):
        piece = np.frombuffer(r.data, np.float32 if r.single else np.float64)
        out.setdefault(r.name, np.zeros(r.at + len(piece), piece.dtype))[r.at : r.at + len(piece)] = piece
    yield from out.items()


def _counted(work: Iterator[tuple[list[str], np.ndarray]]) -> dict[str, np.ndarray]:
    out = {k: np.zeros((2, _NONE)) for k in ("e1", "e2")} | {"rows": np.zeros(2)}
    for texts, y in work:
        one, two, sizes = word_buckets(texts)
        of = np.repeat(np.arange(len(sizes)), sizes)
        out["rows"] += [(y == 0).sum(), (y == 1).sum()]
        for name, ids in (("e1", one), ("e2", two)):
            doc, bucket = np.divmod(np.unique(of * (_NONE + 1) + ids.astype(np.int64)), _NONE + 1)
            for v in (0, 1):
                out[name][v] += np.bincount(bucket[y[doc] == v], minlength=_NONE)
    return out if out["rows"].any() else {}


def _averaged(model: Classifier, squares: dict[str, np.ndarray], rows: DataFrame, seed: int) -> tuple[Classifier, dict[str, np.ndarray]]:
    """Weights after one more epoch in every task: dense ones averaged by rows, embeddings over the tasks that moved them."""
    shared = rows.sparkSession.sparkContext.broadcast((model.p, squares))

    def run(work: Iterator[tuple[list[str], np.ndarray]]) -> dict[str, np.ndarray]:
        p, s = ({k: v.copy() for k, v in x.items()} for x in shared.value)
        own = Classifier(p)
        n = own.epoch(work, s, seed)
        if not n:
            return {}
        step = {k: (v - shared.value[0][k]) * (1 if k in s else n) for k, v in own.p.items()}
        grown = {k: s[k] - shared.value[1][k] for k in s}
        return step | {f"squares-{k}": v for k, v in grown.items()} | {f"moved-{k}": (v > 0).astype(np.float32) for k, v in grown.items()} | {"rows": np.array([float(n)])}

    total = dict(_each_task(rows, run, "weights"))
    shared.destroy()
    p = {k: v + (total[k].reshape(v.shape) / (np.maximum(total[f"moved-{k}"], 1)[:, None] if k in squares else total["rows"][0])).astype(np.float32) for k, v in model.p.items()}
    return Classifier(p), {k: v + total[f"squares-{k}"].reshape(-1, 1).astype(np.float32) for k, v in squares.items()}


def train(rows: DataFrame, epochs: int = EPOCHS, seed: int = 3) -> Classifier:
    """The classifier of all rows (text, y) of a staged table."""
    model, seen = Classifier.fresh(), dict(_each_task(rows, _counted, "bucket-counts"))
    zeros, ones = seen["rows"] if seen else (0, 0)
    if not zeros or not ones:
        model.p["o"][:], model.p["c"][:] = 0, 0
        return model
    model.begin_with_log_odds({k: seen[k].reshape(2, _NONE) for k in ("e1", "e2")}, ones, zeros)
    squares = {k: np.full((_NONE + 1, 1), 1e-2, np.float32) for k in ("e1", "e2")}
    for k in range(epochs):
        model, squares = _averaged(model, squares, rows, seed + k)
    return model


def thresholds(scores: np.ndarray, langs: np.ndarray, labels: np.ndarray, least: int = 20) -> dict[str, float]:
    """For each language with so many rows of either label, the threshold of the best F1, midway between the scores it parts."""
    out = {}
    for lang in sorted(set(langs)):
        s, y = scores[langs == lang], labels[langs == lang]
        if min(y.sum(), (1 - y).sum()) < least:
            continue
        order = np.argsort(-s, kind="stable")
        s, y = s[order], y[order]
        right = np.cumsum(y)
        f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
        f1[:-1][s[:-1] == s[1:]] = -1
        best = int(f1.argmax())
        out[lang] = float((s[best] + s[min(best + 1, len(s) - 1)]) / 2)
    return out


def calibrate(model: Classifier, sample: Sample) -> dict[str, float]:
    """thresholds of rows that are at hand."""
    return thresholds(model.scores(sample.texts), np.array(sample.langs), sample.y)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Classifier, dict[str, float]]:
    """Classifier and thresholds by language of all labelled rows outside of the held-out fold; a fifth of them is for calibration alone."""
    rows = every(docs, labels, "toxic").withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 4)
    model = train(rows.filter("not apart"))
    if not model.p["o"].any():
        return model, {}
    held = score(rows.filter("apart"), model).select("lang", "y", "t_score").toArrow()
    column = lambda k: held.column(k).to_numpy()
    return model, thresholds(column("t_score"), column("lang").astype(object), column("y").astype(np.float64))


def score(docs: DataFrame, model: Classifier, *, text_col: str = "text") -> DataFrame:
    """docs with t_score."""
    docs = docs.drop("t_score")
    shared = docs.sparkSession.sparkContext.broadcast((model.p, model.shift))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*shared.value)
        for batch in slices(batches, text_at):
            yield with_columns(batch, ["t_score"], [pa.array(own.scores([t or "" for t in batch.column(text_at).to_pylist()]))])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("t_score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model, limits = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.coalesce("lang", F.lit(""))), F.lit(0.5)) if limits else F.lit(0.5)
    scored = score(docs, model).drop("text").withColumn("threshold", limit)
    return scored.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), F.col("t_score").alias("score"), (F.col("t_score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("t_score") >= F.col("threshold")).alias("flagged"))
