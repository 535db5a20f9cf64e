"""Quality by a byte-level convolutional network in numpy.

Filters of WIDTH bytes over embedded bytes run at every second byte of the whole UTF-8 text. Their rectified maxima are
taken over chunks of CHUNK bytes, each half over the one before, the last one ending with the text; a hidden layer gives a
logit per chunk (from the maxima and the length of the chunk), and the document's logit combines the mean and the least of
these. Trained by Adam on a bounded sample (PER_CLASS rows of either label, whole texts of MAX_CHARS code points at most);
documents are scored whole.
For scoring, embeddings and filters become tables by pairs of bytes, so a position costs WIDTH / 2 look-ups.

Defined results: a null text is as empty; an empty one has one chunk without maxima; without labels every score is
0.5; repeated rows each get their row; an empty table gives no rows; further columns are carried along (an existing
b_score is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm.batches import slices, with_columns
from linkwright.llm.labelled import HELD_OUT, Adam, Sample, draw, fold, sigmoid

WIDTH = 6
DIMENSIONS = 8
FILTERS = 24
HIDDEN = 16
#: Bytes whose maxima are taken first, and blocks to a chunk; a chunk begins every two blocks.
BLOCK, CHUNK_BLOCKS, HOP = 128, 4, 2
CHUNK = BLOCK * CHUNK_BLOCKS
PER_CLASS, MAX_CHARS = 2000, 20_000
EPOCHS, BATCH, RATE = 6, 32, 0.004
PART_BYTES = 1 << 19
THRESHOLD = 0.3
_PAD = 256


def _layout(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with WIDTH of padding before each text, so that no filter runs from one into the next, and filled up to whole blocks; blocks of each text, and its length."""
    sizes = np.array([len(t) for t in texts])
    blocks = -(-(sizes + WIDTH) // BLOCK)
    data = np.full(int(blocks.sum()) * BLOCK + WIDTH, _PAD, np.uint16)
    begin = (np.cumsum(blocks) - blocks) * BLOCK + WIDTH
    flat = np.frombuffer(b"".join(texts), np.uint8)
    data[np.arange(len(flat)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)] = flat
    return data, blocks, sizes


def _chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, CHUNK_BLOCKS) numbers of the blocks of each chunk, and how many chunks each text has."""
    n = np.maximum(-(-(blocks - CHUNK_BLOCKS) // HOP), 0) + 1
    text = np.repeat(np.arange(len(blocks)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = np.maximum(blocks - CHUNK_BLOCKS, 0)
    first = np.minimum(place * HOP, last[text])
    inside = np.minimum(first[:, None] + np.arange(CHUNK_BLOCKS), (blocks - 1)[text][:, None])
    return (np.cumsum(blocks) - blocks)[text][:, None] + inside, n


class Network:
    def __init__(self, params: dict[str, np.ndarray], shift: float = 0.0):
        self.p, self.shift, self.tables = params, shift, None

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
        e = f(257, DIMENSIONS, scale=0.5)
        e[_PAD] = 0
        return cls({"e": e, "w": f(WIDTH, DIMENSIONS, FILTERS), "b": np.zeros(FILTERS, np.float32), "h": f(FILTERS + 1, HIDDEN), "hb": np.zeros(HIDDEN, np.float32), "o": f(HIDDEN), "c": np.zeros(1, np.float32), "mix": np.array([0.7, 0.3], np.float32)})

    def _pair_tables(self) -> list[np.ndarray]:
        if self.tables is None:
            taps = [self.p["e"] @ self.p["w"][k] for k in range(WIDTH)]
            self.tables = [(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]
        return self.tables

    def _activations(self, data: np.ndarray) -> np.ndarray:
        """(positions, FILTERS) at every second byte."""
        pairs = data[0::2].astype(np.int64) * 257 + data[1::2]
        n = (len(data) - WIDTH) // 2
        first, *rest = self._pair_tables()
        out = first[pairs[:n]]
        for k, table in enumerate(rest, 1):
            out += table[pairs[k : n + k]]
        return out

    def _head(self, top: np.ndarray, bytes_in: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([top, np.log1p(bytes_in)[:, None] / np.log(CHUNK)], axis=1).astype(np.float32)
        z = np.maximum(x @ self.p["h"] + self.p["hb"], 0)
        return x, z, z @ self.p["o"] + self.p["c"][0]

    def _bytes_of(self, members: np.ndarray, blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bytes of text in each chunk."""
        text = np.repeat(np.arange(len(blocks)), blocks)
        place = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        each = np.clip(sizes[text] - place * BLOCK, 0, BLOCK)
        fresh = np.concatenate([np.ones((len(members), 1), bool), members[:, 1:] != members[:, :-1]], axis=1)
        return (each[members] * fresh).sum(axis=1)

    def _logits(self, chunk: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum(n) - n
        mean, least = np.add.reduceat(chunk, starts) / n, np.minimum.reduceat(chunk, starts)
        return self.p["mix"][0] * mean + self.p["mix"][1] * least, least

    def _score_part(self, texts: Sequence[bytes]) -> np.ndarray:
        data, blocks, sizes = _layout(texts)
        top = np.empty((int(blocks.sum()), FILTERS), np.float32)
        step = PART_BYTES // BLOCK
        for at in range(0, len(top), step):
            piece = data[at * BLOCK : min(at + step, len(top)) * BLOCK + WIDTH]
            act = self._activations(piece)
            top[at : at + step] = act.reshape(-1, BLOCK // 2, FILTERS).max(axis=1)
        members, n = _chunks(blocks)
        pooled = np.maximum(top[members].max(axis=1) + self.p["b"], 0)
        pooled[np.repeat(sizes == 0, n)] = 0
        _, _, chunk = self._head(pooled, self._bytes_of(members, blocks, sizes))
        return sigmoid(self._logits(chunk, n)[0] + self.shift)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        raw, out, begin, held = [t.encode("utf-8", "surrogatepass") for t in texts], np.empty(len(texts)), 0, 0
        for i in range(len(raw) + 1):
            if i == len(raw) or (i > begin and held + len(raw[i]) > PART_BYTES):
                if i > begin:
                    out[begin:i] = self._score_part(raw[begin:i])
                begin, held = i, 0
            if i < len(raw):
                held += len(raw[i])
        return out

    def train(self, sample: Sample, epochs: int = EPOCHS, seed: int = 2) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in sample.texts]
        rng, adam = np.random.default_rng(seed), Adam(self.p, RATE)
        half = BLOCK // 2
        for epoch in range(epochs):
            adam.rate = RATE * (1 - epoch / epochs)
            for docs in np.array_split(rng.permutation(len(raw)), max(1, len(raw) // BATCH)):
                data, blocks, sizes = _layout([raw[d] for d in docs])
                self.tables = None
                act = self._activations(data).reshape(-1, half, FILTERS)
                where = act.argmax(axis=1)
                top = np.take_along_axis(act, where[:, None, :], axis=1)[:, 0]
                members, n = _chunks(blocks)
                of = top[members].argmax(axis=1)
                block = np.take_along_axis(members, of, axis=1)
                best = np.take_along_axis(top[members], of[:, None, :], axis=1)[:, 0] + self.p["b"]
                pooled = np.maximum(best, 0)
                x, z, chunk = self._head(pooled, self._bytes_of(members, blocks, sizes))
                logit, least = self._logits(chunk, n)
                g = (sigmoid(logit) - sample.y[docs]) / len(docs)
                text = np.repeat(np.arange(len(docs)), n)
                is_least = (chunk == least[text]).astype(np.float64)
                is_least /= np.add.reduceat(is_least, np.cumsum(n) - n)[text]
                mean = np.add.reduceat(chunk, np.cumsum(n) - n) / n
                gc = (g[text] * (self.p["mix"][0] / n[text] + self.p["mix"][1] * is_least)).astype(np.float32)
                gz = gc[:, None] * self.p["o"] * (z > 0)
                gx = (gz @ self.p["h"].T)[:, :FILTERS] * (best > 0)
                grads = {"o": z.T @ gc, "c": np.array([gc.sum()], np.float32), "h": x.T @ gz + 1e-4 * self.p["h"], "hb": gz.sum(axis=0), "b": gx.sum(axis=0), "mix": np.array([(g * mean).sum(), (g * least).sum()], np.float32)}
                column = np.broadcast_to(np.arange(FILTERS), block.shape)
                at = (block * BLOCK + 2 * where[block, column]).ravel()
                col, back = column.ravel(), gx.ravel()
                some = back != 0
                at, col, back = at[some], col[some], back[some]
                ge, gw = np.zeros_like(self.p["e"]), np.zeros_like(self.p["w"])
                for k in range(WIDTH):
                    byte = data[at + k]
                    by = np.zeros((257, FILTERS), np.float32)
                    np.add.at(by, (byte, col), back)
                    gw[k] = self.p["e"].T @ by
                    ge += by @ self.p["w"][k].T
                ge[_PAD] = 0
                adam.step(grads | {"e": ge, "w": gw + 1e-5 * self.p["w"]})
        self.tables, self.shift = None, sample.shift


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Network:
    sample = draw(docs, labels, "quality", per_class=per_class, max_chars=max_chars)
    net = Network.fresh()
    if len(set(sample.y)) < 2:
        net.p["o"][:] = 0
        return net
    net.train(sample)
    return net


def score(docs: DataFrame, net: Network, *, text_col: str = "text") -> DataFrame:
    """docs with b_score."""
    docs = docs.drop("b_score")
    shared = docs.sparkSession.sparkContext.broadcast((net.p, net.shift))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*shared.value)
        for batch in slices(batches, text_at):
            yield with_columns(batch, ["b_score"], [pa.array(own.scores([t or "" for t in batch.column(text_at).to_pylist()]))])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("b_score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, net).select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), F.col("b_score").alias("score"), (F.col("b_score") >= THRESHOLD).cast("int").alias("predicted"))
