"""MinHash near-duplicate detection with min-max hashing.

Plan, for the whole table:

1. One pass over the texts (Arrow batches, NumPy): per document the number of distinct 5-word shingles, a digest of the
   set and a signature. Under each permutation both the minimum and the maximum are kept, so 96 hash evaluations give
   192 signature values; both collide with probability J. They are banded 32 x 6: a pair at the limit of 0.85 is missed
   with probability 3e-7.
2. Rows of one digest have one set: they become one class with a number of its own, so that a doc_id that comes with two
   texts is in two classes. A class knows the smallest doc_id of its rows.
3. Classes that share a band bucket with another class are candidates; only their sets are built again, from one text each,
   and kept as a table. For each, the shingles that no other candidate has are counted; they bound every similarity exactly:
   at most min(|x| - own(x), |y| - own(y)) shingles are common, and at most the sum of such minima over 16 classes of
   shingles, whose counts travel with the candidate in two longs.
4. Each bucket compares its members with one pivot (that with the smallest share of own shingles: of a group of edited
   copies, the original), where the bound allows a link. Links are confirmed on the full sets and joined to components.
5. What is not in its pivot's component by then meets the bucket's other components, again under the bound, and then under a
   bound from parities of 2,048 classes of shingles, which tells nearly all texts that share much and aren't near-duplicates
   apart without their sets. Pairs within one component are never made: they cannot change the result. No pair of different
   components is left out.
6. Components by label propagation with pointer jumping; every round is a table in the shared folder.

A group's members are never gathered in one task: joins on a bucket or a pivot with many members are split into parts. The rows
made grow with members and buckets, not with pairs; only members of a bucket that the bounds leave open after step 4 meet the
others. Of texts that share much and yet aren't near-duplicates that is quadratic in rows of two numbers and parities, but full sets
are compared for hardly any of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import drop_materialized, materialize
from evidencelake.llm.hashing import Powers, mix, odd, slices

PERMUTATIONS, BANDS, ROWS = 96, 32, 6
SHINGLE_WORDS = 5
#: Classes of shingles whose parities bound the difference of two sets.
PARITY_BITS = 2048

_PLACE = odd(SHINGLE_WORDS, 2)
_MULTIPLY, _ADD = odd(PERMUTATIONS, 3), odd(PERMUTATIONS, 4)
_BAND = odd(ROWS, 5)
_OTHER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, powers: Powers | None = None) -> Iterator[np.ndarray]:
    """Per text its distinct shingles as sorted 64-bit hashes; null and blank texts give an empty array."""
    k = SHINGLE_WORDS
    for s in slices(texts, powers or Powers()):
        rows = np.zeros(max(len(s.word) - k + 1, 0), np.uint64)
        for i in range(k):
            rows += s.word[i : i + len(rows)] * _PLACE[i]
        rows = mix(rows)
        for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(rows[a : b - k + 1])
            elif b > a:
                yield mix((s.word[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield rows[:0]


def bands(shingles: np.ndarray) -> np.ndarray:
    """Band hashes of the min-max signature of a set that isn't empty."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 2048):
        hashed = shingles[i : i + 2048, None] * _MULTIPLY + _ADD
        np.minimum(low, hashed.min(0), out=low)
        np.maximum(high, hashed.max(0), out=high)
    return mix((mix(np.concatenate((low, high)).reshape(BANDS, ROWS)) * _BAND).sum(1, dtype=np.uint64))


def _digests(s: np.ndarray) -> tuple[int, int]:
    """Two sums over a set's hashes that, with its size, tell sets apart."""
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ _OTHER).sum(dtype=np.uint64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            n, one, two, sig = [], [], [], []
            for s in shingle_sets(part.column("text"), powers):
                a, b = _digests(s)
                n.append(len(s))
                one.append(a)
                two.append(b)
                sig.append(bands(s).view(np.int64) if len(s) else None)
            yield pa.record_batch(
                [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the rows (id, set_a, set_b, text) whose text has the digests asked for."""
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            asked = zip(*(part.column(c).to_pylist() for c in ("id", "set_a", "set_b")), strict=True)
            found = [(i, s.view(np.int64)) for (i, *digests), s in zip(asked, shingle_sets(part.column("text"), powers), strict=True) if tuple(digests) == _digests(s)]
            packed = [_packed(s) for _, s in found]
            yield pa.record_batch(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64())), *(pa.array([p[i] for p in packed], pa.int64()) for i in (0, 1)), pa.array([_parity(s) for _, s in found], pa.list_(pa.int64()))],
                ["id", "shingles", "low", "high", "parity"],
            )


def _parity(shingles: np.ndarray) -> np.ndarray:
    """For each of PARITY_BITS classes of shingles whether the set has an odd number of them, packed in longs.

    Sets differ in at least as many shingles as their parities differ in bits.
    """
    odd_counts = np.bincount((shingles.view(np.uint64) >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd_counts.astype(bool), bitorder="little").view(np.int64)


def _packed(shingles: np.ndarray) -> tuple[int | None, int | None]:
    """Counts of the 16 classes of a set, a byte each, in two longs; none for a set with more than 127 in a class."""
    counts = np.bincount(shingles & 15, minlength=16)
    if counts.max(initial=0) > 127:
        return None, None
    return tuple(counts.astype(np.uint8).view(np.int64).tolist())


def _can_link(a: dict[str, Column], b: dict[str, Column], percent: int) -> Column:
    """Whether sizes, shingles that nobody else has, and the classes' counts leave room for a link; never false for linked sets."""
    common = F.least(a["n"] - a["own"], b["n"] - b["own"])
    room = 100 * common >= percent * (a["n"] + b["n"] - common)
    shared = F.lit(0)
    for half in ("low", "high"):
        for shift in range(0, 64, 8):
            shared = shared + F.least(*(F.shiftright(x[half], shift).bitwiseAND(F.lit(255)) for x in (a, b)))
    return room & F.coalesce(100 * shared >= percent * (a["n"] + b["n"] - shared), F.lit(True))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of each end of an edge (a, b): the smallest id reachable. Label propagation with pointer jumping."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "u"), "u").groupBy(F.col("v").alias("id")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jumped = moved.alias("m").join(labels.select(F.col("id").alias("to"), F.col("component").alias("further")), F.col("m.component") == F.col("to"), "left")
        nxt = materialize(jumped.select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        drop_materialized(labels)
        labels = nxt.select("id", "component")
        if nxt.where("old <> component").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    drop_materialized(both)
    return labels


#: Members of a bucket, and pairs of a pivot, that one part of a split join takes.
PART_ROWS = 5000


def _part(of: Column, *by: str) -> Column:
    return F.pmod(F.xxhash64(*by), of).cast("int")


def _every(of: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), of - 1))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets reach the similarity. b's set travels once per pair; a's once per part of its pairs."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("of"))
    split = pairs.join(degree, "a").withColumn("part", _part(F.col("of"), "b")).drop("of")
    left = sets.join(degree, sets.id == degree.a).select("a", F.col("shingles").alias("sa"), _every(F.col("of")).alias("part"))
    b = split.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = b.join(left, ["a", "part"])
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose sets' parities leave room for a link: a few hundred bytes a set decide, not the sets. Linked sets always stay."""
    slim = sets.select("id", F.size("shingles").alias("n"), "parity")
    both = pairs
    for side in ("a", "b"):
        both = both.join(slim.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("parity").alias(f"p{side}")), side)
    apart = F.lit(0)
    for i in range(PARITY_BITS // 64):
        apart = apart + F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i]))
    total = F.col("na") + F.col("nb")
    return both.where(100 * (total - apart) >= percent * (total + apart)).select("a", "b")


KEY = ["n_shingles", "set_a", "set_b"]


def classes_of(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, text_hash and KEY for every row of docs; KEY, component and component_id (smallest doc_id) per class."""
    schema = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signatures, schema), "signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(full.groupBy(*KEY).agg(F.min("doc_id").alias("first_doc"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "reps")
    exploded = reps.select("id", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "bucket"))
    shared = exploded.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(exploded.join(shared, ["band", "bucket"]), "members")

    candidates = members.select("id").distinct().join(reps.select("id", "first_doc", "set_a", "set_b"), "id")
    texts = source.join(candidates, source.doc_id == candidates.first_doc).withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "id", "text_hash"])
    sets = texts.select("id", "set_a", "set_b", "text").mapInArrow(_sets, "id long, shingles array<long>, low long, high long, parity array<long>")
    sets = materialize(sets, "sets")
    if sets.count() > candidates.count():  # two texts of one doc_id with one set
        sets = materialize(sets.dropDuplicates(["id"]), "sets")
    lone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where("_n = 1")
    kind = F.col("s").bitwiseAND(F.lit(15))
    byte = F.expr("shiftleft(1L, cast(8 * (s & 7) as int))")
    # Sums overflow only for sets whose own counts are not packed; they become null, which filters nothing.
    lone = lone.groupBy("id").agg(F.count("*").alias("own"), F.try_sum(F.when(kind < 8, byte)).alias("own_low"), F.try_sum(F.when(kind >= 8, byte)).alias("own_high"))
    own = sets.select("id", "low", "high").join(lone, "id", "left")
    own = materialize(own.select("id", F.coalesce("own", F.lit(0)).alias("own"), *(F.try_subtract(F.col(k), F.coalesce(f"own_{k}", F.lit(0))).alias(k) for k in ("low", "high"))), "own")
    members2 = members.join(own, "id")
    pivots = members2.groupBy("band", "bucket").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "id", "n", "own", "low", "high")).alias("p"), F.min("n").alias("least_n"))
    starred = materialize(members2.join(pivots, ["band", "bucket"]), "starred")
    side = lambda prefix="", suffix="": {k: F.col(f"{prefix}{k}{suffix}") for k in ("n", "own", "low", "high")}
    allowed = starred.where((F.col("id") != F.col("p.id")) & _can_link(side(), side("p."), percent))
    pairs = allowed.select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()
    edges = materialize(_confirmed(pairs, sets, percent), "links")
    labels = connected_components(edges)

    lab = labels.select("id", "component")
    own_label = starred.select("band", "bucket", "size", "id", "n", "own", "low", "high", "least_n", F.col("p.id").alias("pivot"))
    placed = own_label.join(lab, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = placed.join(lab.select(F.col("id").alias("pivot"), F.col("component").alias("pivot_component")), "pivot", "left")
    placed = materialize(placed.withColumn("pivot_component", F.coalesce("pivot_component", "pivot")), "placed")
    room = F.greatest("least_n", F.col("n") - F.col("own"))
    parts = F.ceil(F.col("size") / PART_ROWS).cast("int")
    rest = placed.where((F.col("component") != F.col("pivot_component")) & (100 * (F.col("n") - F.col("own")) >= percent * (F.col("own") + room))).withColumn("part", _every(parts))
    other = placed.select("band", "bucket", _part(parts, "id").alias("part"), F.col("component").alias("component2"), *(F.col(k).alias(f"{k}2") for k in ("id", "n", "own", "low", "high")))
    cross = rest.join(other, ["band", "bucket", "part"]).where((F.col("component") != F.col("component2")) & _can_link(side(), side(suffix="2"), percent))
    pairs2 = cross.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
    pairs2 = materialize(_near(pairs2, sets, percent), "pairs")
    more = materialize(_confirmed(pairs2, sets, percent), "links")
    if not more.isEmpty():
        labels = connected_components(edges.unionByName(more))
    for table in (members, own, starred, placed, sets, edges, pairs2, more):
        drop_materialized(table)

    least = labels.join(reps.select("id", "first_doc"), "id").groupBy("component").agg(F.min("first_doc").alias("component_id"))
    linked = labels.join(least, "component")
    classes = reps.select("id", "first_doc", *KEY).join(linked, "id", "left")
    # A table of its own: a join with it then reads both sides from exchanges, and a class with very many copies can be split.
    classes = materialize(classes.select(*KEY, F.coalesce("component", "id").alias("component"), F.coalesce("component_id", "first_doc").alias("component_id")), "classes")
    return signed.drop("bands"), classes


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Links are between texts: rows of one doc_id with different texts are judged by their own texts, each with the smallest
    doc_id that its text reaches. Repeated rows come out as often as they came in. Null, empty and blank texts have n_shingles
    0, are their own component and are kept. Rows without doc_id come out with component_id null and kept true. An empty
    table gives an empty result.
    """
    rows, classes = classes_of(docs, percent)
    out = rows.join(classes.drop("component"), KEY, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows of docs: of each component one row, of its smallest doc_id. Rows without doc_id and texts without words stay.

    Of several texts of that doc_id in the component, the one of smallest hash stays. The bands miss a pair at exactly 0.80
    with probability 6e-5.
    """
    rows, classes = classes_of(docs, percent)
    judged = rows.where("n_shingles > 0 and doc_id is not null").join(classes.select(*KEY, "component"), KEY)
    first = judged.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("f.*")
    blank = rows.where("n_shingles = 0 and doc_id is not null").select("doc_id", "text_hash").distinct()
    kept = materialize(first.withColumn("once", F.lit(True)).unionByName(blank.withColumn("once", F.lit(False))), "kept")
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.col("text").cast("string")))
    kept_rows = keyed.join(kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"), "once").withColumnRenamed("once", "_once"), (F.col("doc_id") == F.col("_kept_id")) & (F.col("_text_hash") == F.col("_kept_hash")))
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").join(first, ["doc_id", "text_hash"], "left_semi")
    if not repeated.isEmpty():
        kept_rows = kept_rows.where("not _once").unionByName(kept_rows.where("_once").dropDuplicates(["doc_id", "_text_hash"]))
    return kept_rows.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


__all__ = ["near_duplicates", "keep_first", "classes_of", "connected_components", "shingle_sets", "bands"]
