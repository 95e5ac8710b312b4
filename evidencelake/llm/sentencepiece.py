"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

Ordinary documents are encoded whole, in Arrow batches, by the public library. A giant document would hold one task for
long; it is split into chunks that are encoded on their own and joined without error:

* A chunk's boundary state is the piece that covers (or ends at) the boundary. For every state at its left edge a chunk
  finds the states that it can leave in at its right edge: a transfer matrix over (max, +), with 0 for a legal path and
  -infinity for none. In a BPE model a segmentation is the encoder's own exactly if each pair of neighbours is what the
  encoder makes of the pair's text, so weights are those legality tests, and from each state there is one last piece for
  each position.
* The matrices are combined associatively: neighbours in pairs, then pairs of pairs, a table per level of the tree, so that a
  document's matrices never meet in one task. The root's path is handed down again, level by level, which fixes the state at
  every boundary.
* Each chunk is then backtraced on its own between its two states, and the ids are joined in order.

The vocabulary file is a parameter. Texts are never trimmed; a text's ids decode to the text.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evidencelake.llm.common import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT_CHARS = 100_000
CHUNK_CHARS = 16_384
#: A boundary state: (where the piece begins, where it ends), counted from the boundary.
State = tuple[int, int]


class Pieces:
    """A BPE vocabulary: the library's processor, and what the chunked path needs of it."""

    def __init__(self, path: str) -> None:
        self.sp = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)
        sp = self.sp
        n = sp.get_piece_size()
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))}
        self.ids = {p: sp.piece_to_id(p) for p in self.score}
        self.longest = max(map(len, self.score))
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._legal: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The encoder's own merges of a short normalised text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def legal(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self._legal.get(key)
        if found is None:
            if len(self._legal) > 500_000:
                self._legal.clear()
            found = self._legal[key] = self.merged(a + b) == [a, b]
        return found

    def is_piece(self, p: str) -> bool:
        return len(p) == 1 or p in self.score

    def to_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        return out


@cache
def load(path: str) -> Pieces:
    return Pieces(path)


def runs(v: Pieces, text: str, left: int, right: int, at_start: bool) -> dict[State, dict[int, int]]:
    """For each state at `left`: position -> where the last piece begins, for the positions that it reaches up to `right` and one piece on.

    text is the chunk with a piece's length of context on both sides; at_start: the document begins at left.
    """
    if at_start:
        entries: list[State] = [(0, 0)]
    else:
        entries = [(a - left, b - left) for a in range(max(0, left - v.longest), left) for b in range(left, min(len(text), a + v.longest) + 1) if v.is_piece(text[a:b])]
    done: dict[State, dict[int, int]] = {}
    first: dict[int, int] | None = None
    stop = min(len(text), right + v.longest)
    for entry in entries:
        begin = left + entry[1]
        last = {begin: left + entry[0]}
        same = 0
        for p in range(begin + 1, stop + 1):
            for q in range(p - 1, max(begin, p - v.longest) - 1, -1):
                o = last.get(q)
                if o is not None:
                    piece = text[q:p]
                    if v.is_piece(piece) and (o == q or v.legal(text[o:q], piece)):
                        last[p] = q
                        break
            if first is not None:
                same = same + 1 if last.get(p) == first.get(p) else 0
                if same > 2 * v.longest:  # from here on both runs are one
                    last |= {k: x for k, x in first.items() if k > p}
                    break
        done[entry] = last
        first = first if first is not None else last
    return done


def transfer(v: Pieces, text: str, left: int, right: int, at_start: bool, at_end: bool) -> dict[State, list[State]]:
    """The finite entries of a chunk's max-plus matrix: left state -> right states. All of them weigh 0."""
    out = {}
    for entry, last in runs(v, text, left, right, at_start).items():
        ends = [right] if at_end else range(right, min(len(text), right + v.longest) + 1)
        exits = [(last[b] - right, b - right) for b in ends if b in last and last[b] < right and last[b] >= left + entry[1]]
        if left + entry[1] >= right and entry[0] != entry[1]:  # one piece spans the whole chunk
            exits.append((left + entry[0] - right, left + entry[1] - right))
        if exits:
            out[entry] = exits
    return out


def combine(a: dict[State, list[State]], b: dict[State, list[State]]) -> dict[State, list[State]]:
    """Max-plus product of two chunks' matrices; associative."""
    out = {}
    for entry, mids in a.items():
        exits = sorted({x for m in mids for x in b.get(m, ())})
        if exits:
            out[entry] = exits
    return out


def states(matrices: list[dict[State, list[State]]]) -> list[State]:
    """The left state of each chunk, and the last chunk's right one, on the one path through all matrices."""
    live: list[set[State]] = [set() for _ in matrices] + [{x for exits in matrices[-1].values() for x in exits}]
    for i in range(len(matrices) - 1, -1, -1):
        live[i] = {e for e, exits in matrices[i].items() if any(x in live[i + 1] for x in exits)}
    path = [(0, 0)]
    for i, m in enumerate(matrices):
        path.append(min(x for x in m[path[-1]] if x in live[i + 1]))
    return path


def backtrace(v: Pieces, text: str, left: int, right: int, at_start: bool, entry: State, leave: State) -> list[str]:
    """Pieces that begin in the chunk, between its two states."""
    last = runs(v, text, left, right, at_start)[entry]
    p, out = right + leave[1], []
    while p > left + entry[1]:
        out.append(text[last[p] : p])
        p = last[p]
    return out[::-1]


def chunks(v: Pieces, normalised: str, size: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """(number, text with context, left, right, at_start, at_end) of each chunk."""
    n = len(normalised)
    for i, begin in enumerate(range(0, n, size)):
        end = min(n, begin + size)
        a = max(0, begin - v.longest)
        yield i, normalised[a : min(n, end + v.longest)], begin - a, end - a, begin == 0, end == n


def encode_chunked(v: Pieces, text: str, size: int) -> list[int]:
    """The chunked path in one process: the plain statement of what the Spark job does."""
    parts = list(chunks(v, v.sp.normalize(text), size))
    if not parts:
        return []
    path = states([transfer(v, *p[1:]) for p in parts])
    return v.to_ids([x for p, a, b in zip(parts, path, path[1:], strict=False) for x in backtrace(v, *p[1:5], a, b)])


_CHUNK = "key binary, chunk int, body string, lft int, rgt int, at_start boolean, at_end boolean"


def _encode_whole(model: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = v.sp.encode(texts, num_threads=1)
                back = v.sp.decode(ids, num_threads=1)
                flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.empty(0, np.int32)
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([a == b for a, b in zip(texts, back, strict=True)])], ["doc_id", "ids", "round_trip"]
                )

    return rows


def _split(model: str, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = list(chunks(v, v.sp.normalize(text), size))
                if not got:
                    continue
                yield pa.record_batch([pa.array([key] * len(got), pa.binary()), *(pa.array(x) for x in zip(*got, strict=True))], ["key", "chunk", "body", "lft", "rgt", "at_start", "at_end"]).cast(_arrow_chunk())

    return rows


def _arrow_chunk() -> pa.Schema:
    return pa.schema([("key", pa.binary()), ("chunk", pa.int32()), ("body", pa.string()), ("lft", pa.int32()), ("rgt", pa.int32()), ("at_start", pa.bool_()), ("at_end", pa.bool_())])


def _pack(pairs: list[tuple[State, State]]) -> np.ndarray:
    return np.array([[*a, *b] for a, b in pairs], np.int32).reshape(-1)


def _matrices(model: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            for r in batch.to_pylist():
                m = transfer(v, r["body"], r["lft"], r["rgt"], r["at_start"], r["at_end"])
                yield pa.record_batch([pa.array([r["key"]], pa.binary()), pa.array([r["chunk"]], pa.int32()), pa.array([_pack([(a, b) for a, bs in m.items() for b in bs])], pa.list_(pa.int32()))], ["key", "node", "cells"])

    return rows


def _matrix(cells: list[int]) -> dict[State, list[State]]:
    m: dict[State, list[State]] = {}
    for a, b, c, d in np.array(cells, np.int64).reshape(-1, 4).tolist():
        m.setdefault((a, b), []).append((c, d))
    return m


def _pair(table: pa.Table) -> pa.Table:
    """The product of two neighbours' matrices; a last one without a neighbour stays as it is."""
    table = table.sort_by("node")
    m = [_matrix(c) for c in table.column("cells").to_pylist()]
    both = combine(*m) if len(m) == 2 else m[0]
    cells = pa.array([_pack([(a, b) for a, bs in both.items() for b in bs])], pa.list_(pa.int32()))
    return pa.table({"key": table.column("key")[:1], "node": pa.array([table.column("node")[0].as_py() // 2], pa.int32()), "cells": cells})


def _hand_down(table: pa.Table) -> pa.Table:
    """States around each of two neighbours from those around their pair."""
    table = table.sort_by("node")
    a, b, c, d = table.column("around")[0].as_py()
    entry, leave = (a, b), (c, d)
    m = [_matrix(x) for x in table.column("cells").to_pylist()]
    if len(m) == 2:
        middle = min(x for x in m[0][entry] if leave in m[1].get(x, ()))
        between = [[*entry, *middle], [*middle, *leave]]
    else:
        between = [[*entry, *leave]]
    return pa.table({"key": table.column("key"), "node": table.column("node"), "between": pa.array(between, pa.list_(pa.int32()))})


def _whole_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root's one path: from the document's beginning to its end. A document without a legal one has no row."""
    for batch in batches:
        leave = [min(_matrix(c).get((0, 0), ()), default=None) for c in batch.column("cells").to_pylist()]
        some = batch.filter(pa.array([x is not None for x in leave], pa.bool_()))
        ends = [[0, 0, *x] for x in leave if x is not None]
        yield pa.record_batch([some.column("key"), some.column("node"), pa.array(ends, pa.list_(pa.int32()))], ["key", "node", "between"])


_NODE, _BETWEEN = "key binary, node int, cells array<int>", "key binary, node int, between array<int>"


def _tree(cells: DataFrame) -> list[DataFrame]:
    """The chunks' matrices, then those of pairs, of pairs of pairs, up to one a document: a table per level."""
    levels = [cells]
    last = cells.agg(F.max("node")).first()[0] or 0
    while last:
        paired = levels[-1].groupBy("key", F.shiftright("node", 1)).applyInArrow(_pair, _NODE)
        levels.append(materialize(paired, f"level-{len(levels)}"))
        last >>= 1
    return levels


def _down(levels: list[DataFrame]) -> DataFrame:
    """(key, node, between): the states around each chunk of the documents that have a legal path."""
    between = levels[-1].mapInArrow(_whole_path, _BETWEEN)
    for level in reversed(levels[:-1]):
        above = between.select("key", F.col("node").alias("pair"), F.col("between").alias("around"))
        both = level.withColumn("pair", F.shiftright("node", 1)).join(above, ["key", "pair"])
        between = both.groupBy("key", "pair").applyInArrow(_hand_down, _BETWEEN)
    return between


def boundary_states(cells: DataFrame) -> DataFrame:
    """(key, node, between): the states around each chunk, from the chunks' matrices (key, node, cells), node counting from 0.

    A document for which the vocabulary has no legal path has no rows.
    """
    return _down(_tree(cells))


def _trace(model: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            for r in batch.to_pylist():
                a, b, c, d = r["between"]
                pieces = backtrace(v, r["body"], r["lft"], r["rgt"], r["at_start"], (a, b), (c, d))
                yield pa.record_batch([pa.array([r["key"]], pa.binary()), pa.array([r["chunk"]], pa.int32()), pa.array([v.to_ids(pieces)], pa.list_(pa.int32()))], ["key", "chunk", "part"])

    return rows


def _decode(model: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            texts = [v.sp.decode(x) if x is not None else None for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with a column `decoded`: the text of its ids; null for null, an empty text for none."""
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(_decode(model), schema)


def encode_giants(texts: DataFrame, model: str = MODEL, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(key, ids) for each row of texts (key binary, text), whose keys are unique. Where a model has no legal path (a text that it
    normalises to nothing, pieces that its merges don't reach) the ids are the library's own."""
    parts = texts.select("key", "text").mapInArrow(_split(model, chunk_chars), _CHUNK)
    parts = materialize(parts.repartition(F.col("key"), F.col("chunk")), "chunks")
    cells = materialize(parts.mapInArrow(_matrices(model), _NODE), "level-0")
    levels = _tree(cells)
    traced = parts.join(_down(levels).withColumnRenamed("node", "chunk"), ["key", "chunk"]).mapInArrow(_trace(model), "key binary, chunk int, part array<int>")
    ids = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("ids"))
    lost = texts.select("key").join(levels[-1].mapInArrow(_whole_path, _BETWEEN).select("key"), "key", "left_anti")
    if lost.isEmpty():
        return ids
    own = texts.select("key", "text").join(lost, "key", "left_semi").withColumnRenamed("key", "doc_id")
    return ids.unionByName(own.mapInArrow(_encode_whole(model), "doc_id binary, ids array<int>, round_trip boolean").select(F.col("doc_id").alias("key"), "ids"))


def encode(docs: DataFrame, model: str = MODEL, giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_ids, ids, round_trip for every row of docs (doc_id, text).

    Null and empty texts have no ids. Texts over giant_chars code points go the chunked way, equal ones once. Repeated rows
    come out as often as they came in. round_trip: the ids decode to the text (false where a text itself holds U+2581, which
    the format writes for a space). An empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_giant = F.coalesce(F.length("text") > giant_chars, F.lit(False))
    whole = source.where(~is_giant).mapInArrow(_encode_whole(model), "doc_id long, ids array<int>, round_trip boolean")
    giants = materialize(source.where(is_giant).withColumn("key", F.unhex(F.sha2("text", 256))), "giants")
    texts = giants.dropDuplicates(["key"])
    ids = encode_giants(texts, model, chunk_chars)
    back = ids.mapInArrow(_decode(model), "key binary, ids array<int>, decoded string")
    checked = back.select("key", "ids", F.unhex(F.sha2("decoded", 256)).alias("back"))
    long = giants.select("doc_id", "key").join(checked, "key").select("doc_id", "ids", (F.col("key") == F.col("back")).alias("round_trip"))
    return whole.unionByName(long).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
