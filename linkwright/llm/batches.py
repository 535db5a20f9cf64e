"""Texts of Arrow batches as numpy arrays, in parts of bounded size, and the hashes that Spark computes too."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points that are worked on at once; a longer text comes in several pieces.
PART = 1 << 20
#: Bytes of text of a batch that are turned into Python's strings at once.
SLICE = 1 << 22
PAD = 0x110000
CONTEXT = 2
_U = np.uint64
# fixed values of XXH64
P1, P2, P3, P4, P5 = (_U(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(v: np.ndarray, n: int) -> np.ndarray:
    return (v << _U(n)) | (v >> _U(64 - n))


def xxhash_longs(values: np.ndarray, seed: int) -> np.ndarray:
    """What xxhash64 gives for longs, as uint64."""
    with np.errstate(over="ignore"):
        h = _U(seed) + P5 + _U(8)
        h = h ^ (_rotate(values.astype(np.int64).view(np.uint64) * P2, 31) * P1)
        h = _rotate(h, 27) * P1 + P4
        h = (h ^ (h >> _U(33))) * P2
        h = (h ^ (h >> _U(29))) * P3
        return h ^ (h >> _U(32))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(33))) * P2
        h = (h ^ (h >> _U(29))) * P3
        return h ^ (h >> _U(32))


def text_parts(texts: Sequence[str], size: int = PART) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (index, piece, length of the context that the piece begins with), at most size code points each, context aside."""
    out, held, size = [], 0, max(size, CONTEXT)
    for i, t in enumerate(texts):
        for at in range(0, len(t), size):
            n = min(size, len(t) - at)
            if out and held + n > size:
                yield out
                out, held = [], 0
            out.append((i, t[max(0, at - CONTEXT) : at + n], CONTEXT if at else 0))
            held += n
    if out:
        yield out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Trigrams:
    """The trigrams of the pieces of a part: those that occur, and for each position which it is. A text begins with two PADs."""

    def __init__(self, part: list[tuple[int, str, int]], recode: Callable[[np.ndarray], np.ndarray] | None = None):
        self.index = np.array([i for i, _, _ in part])
        sizes = np.array([len(p) for _, p, _ in part])
        context = np.array([c for _, _, c in part])
        padded = sizes + CONTEXT - context
        ends = np.cumsum(padded)
        codes = np.full(int(ends[-1]), PAD, dtype=np.uint32)
        body = np.ones(len(codes), dtype=bool)
        heads = ((ends - padded)[:, None] + np.arange(CONTEXT)).ravel()
        fresh = np.repeat(context == 0, CONTEXT)
        body[heads[fresh]] = False
        codes[body] = code_points("".join(p for _, p, _ in part))
        if recode is not None:
            codes = recode(codes)
        seen = np.flatnonzero(np.bincount(codes))
        table = np.zeros(int(seen[-1]) + 1, dtype=np.int64)
        table[seen] = np.arange(len(seen))
        small, k = table[codes], len(seen)
        dense = (small[:-2] * k + small[1:-1]) * k + small[2:]
        counted = np.ones(len(codes), dtype=bool)
        counted[heads] = False
        at = dense[counted[2:]]
        if k**3 <= 1 << 22:
            counts = np.bincount(at, minlength=1)
            found = np.flatnonzero(counts)
            self.counts = counts[found]
            place = np.zeros(len(counts), dtype=np.int32)
            place[found] = np.arange(len(found), dtype=np.int32)
            self.at = place[at]
        else:
            found, self.at, self.counts = np.unique(at, return_inverse=True, return_counts=True)
        a, rest = np.divmod(found, k * k)
        b, c = np.divmod(rest, k)
        self.a, self.b, self.c = (seen[x].astype(np.int64) for x in (a, b, c))
        self.keys = (self.a << 42) | (self.b << 21) | self.c
        self.lengths = padded - CONTEXT
        self.starts = np.cumsum(self.lengths) - self.lengths

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each piece, the sum of a value per trigram over its positions."""
        return self.position_sums(values[self.at])

    def position_sums(self, per: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per, dtype=np.float64 if per.dtype.kind == "f" else np.int64)])
        return total[self.starts + self.lengths] - total[self.starts]


class Counts:
    """Counts of trigrams by label, merged now and then, so that they stay as small as their distinct keys."""

    def __init__(self, merge_at: int = 1 << 20):
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size, self.merge_at = 0, merge_at

    def add(self, label: str, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.setdefault(label, []).append((keys, counts))
        self.size += len(keys)
        if self.size > self.merge_at:
            self.merge()
            self.merge_at = max(self.merge_at, 2 * self.size)

    def merge(self) -> None:
        self.size = 0
        for label, parts in self.held.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            self.held[label] = [(keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64))]
            self.size += len(keys)

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for label, ((keys, counts),) in self.held.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "key", "n"])


def slices(batches: Iterable[pa.RecordBatch], text_at: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of text (one row at least), so that few texts at a time become Python's."""
    for batch in batches:
        column = batch.column(text_at)
        total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if batch.num_rows else np.empty(0, np.int64)
        begin, done = 0, 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(total, done + size, "right")))
            yield batch.slice(begin, end - begin)
            begin, done = end, int(total[end - 1])


def by_label(labels: Sequence[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, label in enumerate(labels):
        out.setdefault(label, []).append(i)
    return out


def fresh(name: str, taken: Sequence[str]) -> str:
    """name, with underscores after it until it is none of those taken in any case."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def apart(docs: DataFrame, needed: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those needed under names that no operator uses, and what gives docs' columns their names again, in order, without others."""
    names = [c if c in needed else f"own_column_{k}" for k, c in enumerate(docs.columns)]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    return renamed, lambda df: df.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


def with_columns(batch: pa.RecordBatch, names: Sequence[str], arrays: Sequence[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])
