"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The ids are those that the sentencepiece library gives for a BPE model with byte fallback. A segmentation is the
model's own if and only if each piece is the encoding of its own string and each pair of neighbours is the
encoding of the string of the pair. So segmentation is a best path: nodes are occurrences of pieces, valid
neighbours are joined by edges of weight 0, all others weigh minus infinity, and one path alone is left.

A document of up to CHUNK code points is one chunk: the library encodes it. A longer one is split into chunks that see
MARGIN code points on either side. The states at a boundary are the nodes that end at it or cross it; a chunk
yields the max-plus matrix from the states at its begin to those at its end. Matrices combine associatively, in groups of
GROUP chunks and then groups of these, to the best weights from the document's begin and to its end at each boundary;
the state where both are 0 is on the path. With the states at its two ends each chunk is backtraced on its own. No piece
crosses from another character into a space mark, so paths meet at each begin of a word: only what lies before the
first and after the last one of a chunk takes part in its matrix, and whole words between are encoded by the library.

Decoding puts the bytes of the pieces together, chunk by chunk; the space that encoding puts before a document is
dropped. A text round-trips unless it holds the space mark U+2581 itself, which the model takes as a space.

Defined results: null and empty texts have one row without ids; repeated rows each get their rows; a word of any length and
characters outside of the vocabulary (bytes) are encoded as the library does; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.llm.batches import slices
from linkwright.plans.staging import staged

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = 16_384
GROUP = 512
MARGIN = 64
PART = 1 << 19
CHUNK_COLUMNS = ("chunk", "begin", "end", "last", "text", "entry", "exit")
NONE = np.float32(-np.inf)


class Vocabulary:
    """Pieces, their scores and bytes, the library's processor, and the validity of pieces and pairs, kept as found."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        self.piece = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: self.sp.get_score(i) for i in plain}
        self.bytes = [int(p[3:5], 16).to_bytes(1, "big") if self.sp.is_byte(i) else p.replace(MARK, " ").encode() if p in self.id else b"" for i, p in enumerate(self.piece)]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self.longest = max(map(len, self.id))
        if self.longest > MARGIN:
            raise ValueError(f"pieces are longer than {MARGIN}")
        # paths meet at the begin of a word only if no piece holds the mark after another character
        self.words_apart = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.lengths = np.array([len(b) for b in self.bytes])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.own: dict[str, bool] = {}
        self.pair: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: of the neighbours whose union is a piece, the union of the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def is_own(self, piece: str) -> bool:
        if piece not in self.own:
            self.own[piece] = len(piece) == 1 or (piece in self.id and self.merge(piece) == [piece])
        return self.own[piece]

    def are_neighbours(self, a: str, b: str) -> bool:
        if (a, b) not in self.pair:
            self.pair[a, b] = self.merge(a + b) == [a, b]
        return self.pair[a, b]

    def ids_of(self, piece: str) -> list[int]:
        return [self.id[piece]] if piece in self.id else [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]

    def encode_words(self, marked: str) -> list[int]:
        """Ids of marked text that begins with a mark, by the library, which puts that mark there itself."""
        if len(marked) <= self.longest and not marked.strip(MARK):
            return [i for p in self.merge(marked) for i in self.ids_of(p)]
        return self.sp.encode(marked[1:].replace(MARK, " "))

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.blob[at].tobytes()


class Chunk:
    """Marked text from MARGIN before the chunk (if there is as much) to MARGIN after it; begin and end of the chunk within."""

    def __init__(self, vocabulary: Vocabulary, text: str, begin: int, end: int, first: bool, last: bool):
        self.v, self.text, self.begin, self.end, self.first, self.last = vocabulary, text, begin, end, first, last
        self.entries = [(begin, begin)] if first else self._across(begin)
        self.exits = [(end, end)] if last else self._across(end)
        # a meeting point at the end of a chunk that isn't the last is the next one's
        starts = [i for i in range(begin, end + last) if self._meets(i)]
        self.meet_first, self.meet_last = (starts[0], starts[-1]) if starts else (None, None)

    def _meets(self, i: int) -> bool:
        if (i == self.begin and self.first) or (i == self.end and self.last):
            return True
        return self.v.words_apart and 0 < i < len(self.text) and self.text[i] == MARK and self.text[i - 1] != MARK

    def _nodes_from(self, i: int) -> Iterator[tuple[int, int]]:
        for j in range(i + 1, min(i + self.v.longest, len(self.text)) + 1):
            if self.v.is_own(self.text[i:j]):
                yield i, j

    def _across(self, at: int) -> list[tuple[int, int]]:
        """The states of a boundary, in the same order for the chunks on either side, as (begin, end) within this text."""
        return [(i, j) for i in range(max(0, at - self.v.longest), at) for _, j in self._nodes_from(i) if j >= at]

    def _paths(self, sources: list[tuple[int, int]], stop: int, crossing: bool) -> tuple[dict, dict]:
        """Nodes reachable from the sources, up to stop: with the set of sources (bits) that reach them, and their predecessors.

        A source (i, i) stands for a meeting point. Nodes end at stop at the latest, or, if crossing, begin before it.
        """
        reach: dict[tuple[int, int], int] = {}
        before: dict[tuple[int, int], list[tuple[int, int]]] = {}
        by_end: dict[int, list[tuple[int, int]]] = {}
        for bit, s in enumerate(sources):
            reach[s] = reach.get(s, 0) | 1 << bit
            if s not in by_end.setdefault(s[1], []):
                by_end[s[1]].append(s)
        for i in range(min(s[1] for s in sources) if sources else stop, stop):
            if i not in by_end:
                continue
            for node in self._nodes_from(i):
                if node[1] > stop and not crossing:
                    continue
                if node in reach:
                    continue
                piece = self.text[node[0] : node[1]]
                found = [p for p in by_end[i] if p[0] == p[1] or self.v.are_neighbours(self.text[p[0] : p[1]], piece)]
                if found:
                    reach[node], before[node] = 0, found
                    for p in found:
                        reach[node] |= reach[p]
                    by_end.setdefault(node[1], []).append(node)
            del by_end[i]
        return reach, before

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.entries), len(self.exits)), NONE, np.float32)
        if self.meet_first is None:
            reach, _ = self._paths(self.entries, self.end, crossing=True)
            for c, node in enumerate(self.exits):
                for r in range(len(self.entries)):
                    if reach.get(node, 0) >> r & 1:
                        out[r, c] = 0
            return out
        reach, _ = self._paths(self.entries, self.meet_first, crossing=False)
        alive = 0
        for node, bits in reach.items():
            if node[1] == self.meet_first:
                alive |= bits
        start = (self.meet_last, self.meet_last)
        ends, _ = self._paths([start], self.end, crossing=True)
        rows = [r for r in range(len(self.entries)) if alive >> r & 1]
        cols = [c for c, node in enumerate(self.exits) if (node in ends and (node != start or self.last))]
        out[np.ix_(rows, cols)] = 0
        return out

    def _trace(self, source: tuple[int, int], target: tuple[int, int] | int, stop: int, crossing: bool) -> list[str]:
        """The pieces after the source up to the target: a node, included, or a meeting point that some node ends at."""
        reach, before = self._paths([source], stop, crossing)
        # one node alone ends a best path at a meeting point
        node = next(n for n in reach if n[1] == target) if isinstance(target, int) else target
        out = []
        while node != source:
            out.append(self.text[node[0] : node[1]])
            node = before[node][0]
        return out[::-1]

    def ids(self, entry: int, exit_: int) -> list[int]:
        """Ids of the pieces that begin within the chunk."""
        source, target = self.entries[entry], self.exits[exit_]
        flat = lambda pieces: [i for p in pieces for i in self.v.ids_of(p)]
        if self.meet_first is None:
            return flat(self._trace(source, target, self.end, True))
        out = flat(self._trace(source, self.meet_first, self.meet_first, False)) if source[1] < self.meet_first else []
        if self.meet_last > self.meet_first:
            out += self.v.encode_words(self.text[self.meet_first : self.meet_last])
        if not self.last:
            out += flat(self._trace((self.meet_last, self.meet_last), target, self.end, True))
        return out


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.shape[1] else np.full((a.shape[0], b.shape[1]), NONE, np.float32)


def _pack(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int32).tobytes() + np.ascontiguousarray(m, np.float32).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b[8:], np.float32).reshape(np.frombuffer(b[:8], np.int32))


def _splitter(size: int):
    """(rid, text) -> (rid, chunk, begin, end, last, text): marked text with margins."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        for batch in slices(batches, 1):
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marked = MARK + text.replace(" ", MARK)
                cuts = list(range(0, len(marked), size))
                for at in range(0, len(cuts), 64):
                    rows = []
                    for k, cut in enumerate(cuts[at : at + 64], at):
                        end, low = min(cut + size, len(marked)), max(0, cut - MARGIN)
                        rows.append((rid, k, cut - low, end - low, end == len(marked), marked[low : end + MARGIN]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["rid", "chunk", "begin", "end", "last", "text"])

    return split


def _chunks_of(batch: pa.RecordBatch, v: Vocabulary) -> Iterator[Chunk]:
    for row in batch.select(["chunk", "begin", "end", "last", "text"]).to_pylist():
        yield Chunk(v, row["text"], row["begin"], row["end"], row["chunk"] == 0, row["last"])


_STATES = pa.schema([("rid", pa.int64()), ("chunk", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32()), ("ahead", pa.binary()), ("behind", pa.binary())])
_PRODUCT = pa.schema([("rid", pa.int64()), ("chunk", pa.int32()), ("matrix", pa.binary())])


def _product(rows: list[dict]) -> list[dict]:
    """A group's rows in order of chunk -> one row with the product of their matrices."""
    total = None
    for m in (_unpack(r["matrix"]) for r in rows):
        total = m if total is None else multiply(total, m)
    return [{"rid": rows[0]["rid"], "chunk": rows[0]["group"], "matrix": _pack(total)}]


def _states(rows: list[dict]) -> list[dict]:
    """Within a group: with the best weights from the document's begin (ahead) and to its end (behind) at the group's ends, those of each chunk."""
    matrices = [_unpack(r["matrix"]) for r in rows]
    ahead, behind = rows[0]["ahead"], rows[0]["behind"]
    fs = [_unpack(ahead) if ahead is not None else np.zeros((1, 1), np.float32)]
    bs = [_unpack(behind) if behind is not None else np.zeros((1, 1), np.float32)]
    for m in matrices:
        fs.append(multiply(fs[-1], m))
    for m in reversed(matrices):
        bs.append(multiply(m, bs[-1]))
    bs = bs[::-1]
    on = [int((x[0] + y[:, 0]).argmax()) for x, y in zip(fs, bs)]
    return [{"rid": r["rid"], "chunk": r["chunk"], "entry": on[i], "exit": on[i + 1], "ahead": _pack(fs[i]), "behind": _pack(bs[i + 1])} for i, r in enumerate(rows)]


def _by_group(f, schema: pa.Schema):
    """Runs f on the rows of each (rid, group), which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if held and (row["rid"], row["group"]) != (held[0]["rid"], held[0]["group"]):
                    out += f(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist(f(held), schema)

    return run


def scan(matrices: DataFrame, group: int = GROUP) -> DataFrame:
    """(rid, chunk, matrix) -> (rid, chunk, entry, exit): the states of the one best path.

    A task gets groups of that many chunks of a document, then one row for each of the document's groups: at most
    512 and 256 for the longest string there can be (2**31 bytes).
    """
    none = F.lit(None).cast("binary")
    grouped = matrices.withColumn("group", F.expr(f"chunk div {group}").cast("int"))
    # groups are small rows that cost time. They are dealt by a hash of their own to as many tasks as shuffles have: Spark would
    # drop a partitioning by (rid, group) for the join's before it, and then put its few bytes together in one task
    tasks = int(matrices.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, f, schema: pa.Schema, types: str) -> DataFrame:
        own = df.withColumn("deal", F.xxhash64("rid", "group")).repartition(tasks, "deal").sortWithinPartitions("rid", "group", "chunk")
        return own.drop("deal").mapInArrow(_by_group(f, schema), types)

    states = "rid long, chunk int, entry int, exit int, ahead binary, behind binary"
    several = grouped.filter("group > 0").select("rid").distinct()
    products = dealt(grouped.join(several, "rid", "left_semi"), _product, _PRODUCT, "rid long, chunk int, matrix binary")
    whole = products.select("rid", F.lit(0).alias("group"), "chunk", "matrix", none.alias("ahead"), none.alias("behind"))
    outer = dealt(whole, _states, _STATES, states).select("rid", F.col("chunk").alias("group"), "ahead", "behind")
    # a document of one group needs no weights from outside of it
    inner = grouped.join(outer, ["rid", "group"], "left").select("rid", "group", "chunk", "matrix", "ahead", "behind")
    return staged(dealt(inner, _states, _STATES, states).select("rid", "chunk", "entry", "exit"), "states")


def _round_trips(v: Vocabulary, ids: Sequence[np.ndarray], want: Sequence[bytes]) -> list[bool]:
    return [v.decode(i) == w for i, w in zip(ids, want)]


def _encoded(names: Sequence[str], kept: Sequence[pa.Array], chunk: Sequence[int], ids: Sequence[np.ndarray], lossless: Sequence[bool]) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids) if len(ids) else np.empty(0, np.int32)
    arrays = [*kept, pa.array(chunk, pa.int32()), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(offsets, flat.astype(np.int32)), pa.array(lossless, pa.bool_())]
    return pa.RecordBatch.from_arrays(arrays, [*names, "chunk", "n_tokens", "ids", "lossless"])


def encode(docs: DataFrame, model: bytes, *, text_col: str = "text", carry: Sequence[str] = ("doc_id",), chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """carry, chunk, n_tokens, ids, lossless (the chunk decodes to its text): a row per chunk of each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    carry = list(carry)
    if clash := {*CHUNK_COLUMNS, "rid", "__rid", "__text", "n_tokens", "ids", "lossless"} & {*carry}:
        raise ValueError(f"rename before encoding: {sorted(clash)}")
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("chunk", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    base = docs.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    giant = F.length("__text") >= chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for batch in slices(batches, len(carry)):
            texts = batch.column(len(carry)).to_pylist()
            step = max(1, PART // max(1, sum(map(len, texts)) // max(1, len(texts))))
            for at in range(0, len(texts), step):
                some = texts[at : at + step]
                ids = [np.array(i, np.int32) for i in v.sp.encode(some, num_threads=1)]
                good = _round_trips(v, ids, [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in some])
                yield _encoded(carry, [c.slice(at, step) for c in batch.columns[: len(carry)]], [0] * len(some), ids, good)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for batch in slices(batches, 5):
            found = [_pack(c.matrix()) for c in _chunks_of(batch, v)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "matrix"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for batch in slices(batches, len(carry) + CHUNK_COLUMNS.index("text")):
            states = zip(batch.column("entry").to_pylist(), batch.column("exit").to_pylist())
            ids, want = [], []
            for c, (entry, exit_) in zip(_chunks_of(batch, v), states):
                ids.append(np.array(c.ids(entry, exit_), np.int32))
                # pieces belong to the chunk that they begin in
                text = c.text[c.entries[entry][1] : c.exits[exit_][1]]
                want.append(text.replace(MARK, " ").encode("utf-8", "surrogatepass"))
            yield _encoded(carry, [batch.column(c) for c in carry], batch.column("chunk").to_pylist(), ids, _round_trips(v, ids, want))

    small = base.filter(~giant).mapInArrow(whole, schema)
    long = staged(base.filter(giant).withColumn("__rid", F.monotonically_increasing_id()), "giant-texts")
    if long.limit(1).count() == 0:
        return small
    split = long.select("__rid", "__text").mapInArrow(_splitter(chunk), "rid long, chunk int, begin int, end int, last boolean, text string")
    chunks = staged(split.repartition("rid", "chunk").mapInArrow(weigh, "rid long, chunk int, begin int, end int, last boolean, text string, matrix binary"), "giant-chunks")
    states = scan(chunks.select("rid", "chunk", "matrix"), group)
    traced = chunks.drop("matrix").join(states, ["rid", "chunk"]).join(long.drop("__text"), F.col("rid") == F.col("__rid")).select(*[f"`{c}`" for c in carry], *CHUNK_COLUMNS)
    return small.unionByName(traced.mapInArrow(trace, schema))


def decode(tokens: DataFrame, model: bytes, *, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry, chunk, text: the text of each chunk; in order of chunk they are the document."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)
    carry = list(carry)
    schema = T.StructType([*[tokens.schema[c] for c in carry], T.StructField("chunk", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(shared.value)
        for batch in batches:
            out = []
            for chunk, ids in zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist()):
                text = v.decode(np.array(ids, np.int64)).decode("utf-8", "replace")
                out.append(text[1:] if chunk == 0 else text)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], batch.column("chunk"), pa.array(out, pa.string())], [*carry, "chunk", "text"])

    return tokens.select(*carry, "chunk", "ids").mapInArrow(run, schema)


def read_model(path: str = MODEL) -> bytes:
    """The driver reads the model; its bytes (half a megabyte) go to the executors."""
    with open(path, "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), read_model())
