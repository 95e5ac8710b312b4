"""Benchmark decontamination by a prefix-filtered set join: documents against the windows of benchmark items.

A window is `size` consecutive words of an item, an item of fewer words is one window. The set of a window are its shingles of
SHINGLE words. Shingles are ordered by rarity in the documents; as a window has to be contained whole, its rarest shingle is all of
its necessary prefix, and a window one of whose shingles no document has is gone. Two passes over the documents: one counts the
shingles of the items, the next gathers the places of prefix shingles. Each place and window that share a shingle are a candidate,
bounded by length (the document has that many words) and position (the window fits before and after the place), and verified word
by word. So what is shuffled are the documents' places with a rare shingle of an item, never the documents.

What each task has of the items is a bit map of at most 2^MAP_BITS bits: it lets other shingles pass, which the joins drop, and never
hides one. Copies of a passage are verified once, as the words around a place are grouped before they meet the windows.

Nulls: a null text has no words; items without words are none; rows without item_id mark words and are not among the items. Repeated
rows are judged each for itself, repeated items are one. Texts are read whole. Empty tables give no rows, or clean documents.
Columns besides doc_id, text and item_id play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm import hashing
from evidencelake.llm.common import materialize

#: Words of a shingle; of the words of a contained item, the shingles are ordered by rarity.
SHINGLE = 3
MAP_BITS = 27
#: Words are runs of digits, lower-cased letters and characters beyond ASCII.
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = SEPARATOR[128:] = False
_PLACE = hashing.odd(SHINGLE, 1101)


def item_words(text: Column) -> Column:
    """The words of an item or a context, as an expression."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _shingles(s: hashing.Slice, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and text of each run of `length` words that lies in one text."""
    n = len(s.word) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    owner = np.repeat(np.arange(len(s.bounds) - 1), np.diff(s.bounds))
    at = np.flatnonzero(owner[:n] == owner[length - 1 :])
    h = np.full(len(at), length, np.uint64)
    for k in range(length):
        h += s.word[at + k] * _PLACE[k]
    return hashing.mix(h), at, owner[at]


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64((1 << bits) - 1), (h >> np.uint64(64 - bits))


class Map:
    """Which hashes may be among those that were put in: two bits each, in a map of a fixed largest size."""

    def __init__(self, hashes: DataFrame) -> None:
        """hashes: (shingle). Words of the map are made by Spark and gathered here: 2^MAP_BITS bits at most, however many there are."""
        n = hashes.count()
        self.bits = bits = min(MAP_BITS, max(16, (max(n, 1) * 32).bit_length()))
        mask = (1 << bits) - 1
        slots = hashes.select(F.explode(F.array(F.col("shingle").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("shingle", 64 - bits))).alias("slot"))
        words = slots.groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 AS int))")).alias("word"))
        got = words.toArrow()
        self.words = np.zeros(1 << (bits - 5), np.uint32)
        self.words[got.column("at").to_numpy()] = got.column("word").to_numpy().astype(np.uint32)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for slot in _slots(h, self.bits):
            found &= (self.words[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return found


def windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(window, n) of the distinct windows, n their words; and (item_id, window) of the items that have them."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("w")).where("size(w) > 0")
    own = F.expr(f"transform(sequence(0, greatest(size(w) - {size}, 0)), i -> array_join(slice(w, i + 1, {size}), ' '))")
    had = materialize(w.select("item_id", F.explode(own).alias("window")).distinct(), "leaks-windows")
    return had.select("window").distinct().withColumn("n", F.size(F.split("window", " "))), had.where("item_id is not null")


def _of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, n, offset, length, shingle) of every shingle of each window; of a window of fewer words the whole is one."""
    powers = hashing.Powers()
    for batch in batches:
        texts, first = batch.column("window"), 0
        for s in hashing.slices(texts, powers, SEPARATOR):
            count = len(s.bounds) - 1
            lengths = np.minimum(np.diff(s.bounds), SHINGLE)
            for length in np.unique(lengths):
                h, at, owner = _shingles(s, int(length))
                mine = lengths[owner] == length
                h, at, owner = h[mine], at[mine], owner[mine]
                yield pa.RecordBatch.from_pydict({"window": texts.take(pa.array(owner + first)), "n": pa.array(np.diff(s.bounds)[owner], pa.int32()), "offset": pa.array(at - s.bounds[owner], pa.int32()), "length": pa.array(np.full(len(h), length), pa.int32()), "shingle": pa.array(h.view(np.int64))})
            first += count


def _counting(seen: Map, lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each shingle of the items that a batch has stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = hashing.Powers()
        for batch in batches:
            for s in hashing.slices(batch.column("text"), powers, SEPARATOR):
                for length in lengths:
                    h = _shingles(s, length)[0]
                    found, n = np.unique(h[seen.may_have(h)], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"shingle": pa.array(found.view(np.int64)), "n": pa.array(n, pa.int64())})

    return run


_PLACES = "row long, doc_id long, n_words long, places array<struct<place:int, shingle:bigint, first:int, context:string>>"


def _gathering(seen: Map, lengths: list[int], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's number of words and its places of prefix shingles, with the words around each that a window may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, row = hashing.Powers(), TaskContext.get().partitionId() << 36
        kind = pa.struct([("place", pa.int32()), ("shingle", pa.int64()), ("first", pa.int32()), ("context", pa.string())])
        for batch in batches:
            done = 0
            for s in hashing.slices(batch.column("text"), powers, SEPARATOR):
                count = len(s.bounds) - 1
                parts = []
                for length in lengths:
                    h, at, owner = _shingles(s, length)
                    mine = seen.may_have(h)
                    parts.append((owner[mine], at[mine], h[mine], np.full(int(mine.sum()), length)))
                owner, at, h, length = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int),) * 4
                order = np.argsort(owner, kind="stable")
                owner, at, h, length = owner[order], at[order], h[order], length[order]
                low = np.maximum(s.bounds[owner], at + length - size)
                high = np.minimum(s.bounds[owner + 1], at + size)
                text = [" ".join(_lowered(s.data[a:b]) for a, b in zip(s.starts[i:j], s.ends[i:j], strict=True)) for i, j in zip(low, high, strict=True)]
                places = pa.StructArray.from_arrays([pa.array(at - s.bounds[owner], pa.int32()), pa.array(h.astype(np.uint64).view(np.int64)), pa.array(low - s.bounds[owner], pa.int32()), pa.array(text, pa.string())], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(count + 1)), pa.int32()), places)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + count)), batch.column("doc_id").slice(done, count), pa.array(np.diff(s.bounds), pa.int64()), lists], names=["row", "doc_id", "n_words", "places"])
                row, done = row + count, done + count

    return run


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lowered(word: np.ndarray) -> str:
    return _LOWER[word].tobytes().decode()


def overlaps(docs: DataFrame, items: DataFrame, size: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, n_words) of every document, (row, first, n, window) of every window that stands in it, (item_id, window) of the items."""
    distinct, had = windows(items, size)
    shingles = materialize(distinct.mapInArrow(_of_windows, "window string, n int, offset int, length int, shingle long"), "leaks-shingles")
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect())  # at most SHINGLE numbers
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = d.select("text").mapInArrow(_counting(Map(shingles.select("shingle").distinct()), lengths), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("found"))
    rarity = materialize(shingles.join(counted, "shingle"), "leaks-rarity")  # an absent shingle has no row
    need = F.expr(f"greatest(n - {SHINGLE} + 1, 1)")
    # Rarest first, ties by the hash, so that windows which share a rarest shingle agree on it; a window lacking one of its shingles is gone.
    prefix = rarity.groupBy("window", "n").agg(F.count("*").alias("have"), F.min(F.struct("found", "shingle", "offset", "length")).alias("p")).where(F.col("have") == need)
    prefix = materialize(prefix.select("window", "n", "p.shingle", "p.offset", "p.length"), "leaks-prefixes")
    gathered = materialize(d.mapInArrow(_gathering(Map(prefix.select("shingle").distinct()), lengths, size), _PLACES), "leaks-places")
    places = gathered.where("size(places) > 0").select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    around = places.select("shingle", (F.col("place") - F.col("first")).alias("at"), "context").distinct()
    near = around.join(prefix, "shingle").withColumn("words", F.split("context", " "))
    start = F.col("at") - F.col("offset")
    near = near.where((start >= 0) & (start + F.col("n") <= F.size("words")))  # position and length
    verified = near.where(F.array_join(F.slice("words", start + 1, F.col("n")), " ") == F.col("window")).select("shingle", "at", "context", "offset", "n", "window").distinct()
    verified = materialize(verified, "leaks-verified")
    found = places.withColumn("at", F.col("place") - F.col("first")).join(verified, ["shingle", "at", "context"])
    found = found.where(F.col("n_words") >= F.col("n")).select("row", (F.col("place") - F.col("offset")).alias("first"), "n", "window")
    return gathered.select("row", "doc_id", "n_words"), materialize(found, "leaks-found"), had


def judge(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), spans (first and last word of each run of hit words, from 0), contaminated."""
    every, found, had = overlaps(docs, items, size)
    ordered = Window.partitionBy("row").orderBy("first", "end")
    spans = found.select("row", "first", (F.col("first") + F.col("n")).alias("end")).distinct()
    spans = spans.withColumn("new", F.coalesce(F.col("first") > F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(ordered)).groupBy("row", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    merged = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("first")).alias("hit"), F.array_sort(F.collect_list(F.struct("first", (F.col("end") - 1).alias("last")))).alias("spans"))
    named = found.select("row", "window").distinct().join(had, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    none = F.array().cast("array<string>")
    j = every.join(merged, "row", "left").join(named, "row", "left")
    hit, ids = F.coalesce("hit", F.lit(0).cast("long")), F.coalesce("item_ids", none)
    return j.select("doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"), (hit > 0).alias("contaminated"))
