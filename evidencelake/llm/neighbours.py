"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are normalised, so that the largest cosine is the smallest distance. Each of TABLES tables has PROJECTIONS Gaussian
projections cut into cells of width WIDTH; the cells form a bucket. A neighbour of a query, at cosine c, projects normally
around c times the query's projection, so each bucket has an estimated success: its chance to hold the neighbour over its
share of the rows, a product over the cells. Buckets of all tables are visited in falling order of that success, until the
promised share of simulated neighbours is met; that ends at one level per query, so a visit needs no list of buckets.

c and the promise come from a bounded sample: SAMPLE_QUERIES vectors have their true neighbours found in one linear pass over
the table, and the promise is the one that finds RECALL of them. Every vector is indexed.

Rows are grouped by (table, cells of the first projections); a query goes once to each group where some bucket reaches its
level, and there only to the buckets that do. Groups are split by the rows and the visits that they have, so a hot cell is many
tasks. Each part reranks by exact cosine and only its best leave it; tables are merged by (query, candidate). Equal vectors are
one entry with the smallest ids that any query could want, so a very common vector is one row. Queries that got fewer than k
rows that way are compared with all vectors, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import materialize

TABLES, PROJECTIONS, WIDTH, RECALL = 4, 24, 1.5, 0.96
#: Cells on each side of zero; the outermost are open.
REACH = 4
CELLS = 2 * REACH + 1
#: Rows, and visiting queries, that one task of a group takes.
GROUP_ROWS, GROUP_VISITS = 6000, 6000
SAMPLE_ROWS, SAMPLE_QUERIES, SIMULATED = 2000, 200, 400
#: Vectors, and queries, of one block of the exact scan.
SCAN_ROWS = 4000
MAX_COARSE = 5


@dataclass
class Index:
    """What every task needs to know: projections, shares of cells, the neighbours' cosine, the promise."""

    a: np.ndarray  # [TABLES, PROJECTIONS, dim]
    shift: np.ndarray  # [TABLES, PROJECTIONS]
    share: np.ndarray  # [TABLES, PROJECTIONS, CELLS]: of the sample's rows
    noise: np.ndarray  # [SIMULATED, TABLES, PROJECTIONS]: projections of fixed Gaussian vectors
    coarse: int  # projections whose cells make the group
    cosine: float = 0.5
    promise: float = RECALL

    def cells(self, x: np.ndarray) -> np.ndarray:
        """[rows, TABLES, PROJECTIONS] cell numbers from 0."""
        return self.cells_of(np.einsum("tpd,nd->ntp", self.a, x, optimize=True))

    def cells_of(self, projected: np.ndarray) -> np.ndarray:
        return (np.clip(np.floor((projected + self.shift) / WIDTH), -REACH, REACH) + REACH).astype(np.int16)

    def success(self, x: np.ndarray) -> np.ndarray:
        """[rows, TABLES, PROJECTIONS, CELLS]: log of each cell's chance to hold a neighbour over its share of the rows."""
        centre = self.cosine * np.einsum("tpd,nd->ntp", self.a, x, optimize=True)
        spread = math.sqrt(max(1 - self.cosine**2, 1e-4))
        edges = np.arange(-REACH + 1, REACH + 1) * WIDTH - self.shift[..., None]
        below = _normal_cdf((edges - centre[..., None]) / spread)
        chance = np.diff(below, axis=-1, prepend=0.0, append=1.0)
        return np.clip(np.log(np.maximum(chance, 1e-9) / self.share), -8, 8)

    def levels(self, x: np.ndarray, success: np.ndarray) -> np.ndarray:
        """[rows, SIMULATED]: the best bucket's success of each simulated neighbour, ascending."""
        centre = self.cosine * np.einsum("tpd,nd->ntp", self.a, x, optimize=True)
        spread = math.sqrt(max(1 - self.cosine**2, 1e-4))
        out = [np.sort(bucket_success(s, self.cells_of(c + spread * self.noise)).max(-1)) for c, s in zip(centre, success, strict=True)]
        return np.array(out).reshape(len(x), -1)


def bucket_success(success: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """[n, TABLES]: one query's success of the buckets with these cells [n, TABLES, PROJECTIONS]."""
    t, p = np.indices(cells.shape[1:])
    return success[t, p, cells].sum(-1)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26; off by less than 1e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x > 0, 1 - tail / 2, tail / 2)


def _group_key(cells: np.ndarray) -> np.ndarray:
    """One number from the coarse cells in the last axis."""
    key = np.zeros(cells.shape[:-1], np.int32)
    for i in range(cells.shape[-1]):
        key = key * CELLS + cells[..., i].astype(np.int32)
    return key


def _vectors(batch: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    column = batch.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def usable_vectors(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, embedding, entry) of the vectors that take part; entry is a hash of the vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return v.withColumn("entry", F.xxhash64("embedding"))


def distinct_vectors(vectors: DataFrame, keep: int, kind: str = "double") -> DataFrame:
    """(entry, embedding, ids): one row per distinct usable vector with its `keep` smallest ids.

    The ranks are limited within each task before the shuffle, so that a common vector brings few rows.
    """
    w = Window.partitionBy("entry", "embedding").orderBy("vec_id")
    top = usable_vectors(vectors, kind).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    return top.groupBy("entry", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fit(entries: DataFrame, n: int, dim: int, k: int, recall: float = RECALL, seed: int = 11) -> Index:
    """The index's parameters, from SAMPLE_ROWS entries; SAMPLE_QUERIES of them are compared once with all entries."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, shift = rng.standard_normal((TABLES, PROJECTIONS, dim)), rng.random((TABLES, PROJECTIONS)) * WIDTH
    sample = unit(np.array([r[0] for r in entries.orderBy("entry").limit(SAMPLE_ROWS).select("embedding").collect()], np.float64))
    coarse = int(np.clip(round(math.log(max(n / 3000, 1)) / math.log(4)), 1, MAX_COARSE))
    noise = np.einsum("tpd,sd->stp", a, rng.standard_normal((SIMULATED, dim)) / math.sqrt(dim), optimize=True)
    index = Index(a, shift, np.ones((TABLES, PROJECTIONS, CELLS)), noise, coarse)
    held = index.cells(sample)
    counts = np.stack([(held == c).sum(0) for c in range(CELLS)], -1)
    edges = np.arange(-REACH + 1, REACH + 1) * WIDTH - shift[..., None]
    normal = np.diff(_normal_cdf(edges), axis=-1, prepend=0.0, append=1.0)
    index.share = np.maximum((counts + 50 * normal) / (len(sample) + 50), 1e-6)

    asked = sample[:SAMPLE_QUERIES]
    shared = entries.sparkSession.sparkContext.broadcast(asked)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _vectors(batch, dim)
            s = cosine(shared.value, c)
            s[s > 1 - 1e-12] = -2  # the query itself
            m = min(k, len(c))
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            q = np.repeat(np.arange(len(s)), m)
            yield pa.record_batch([pa.array(q), pa.array(s[q, best.ravel()]), batch.column("embedding").take(pa.array(best.ravel())).cast(pa.list_(pa.float64()))], ["q", "score", "embedding"])

    best = Window.partitionBy("q").orderBy(F.desc("score"))
    near = entries.select("embedding").mapInArrow(nearest, "q long, score double, embedding array<double>").where("score > -2")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).toArrow()  # SAMPLE_QUERIES * k rows
    if not near.num_rows:
        return index
    score, q = near.column("score").to_numpy(), near.column("q").to_numpy()
    index.cosine = float(np.clip(np.quantile(score, 0.3), 0.05, 0.98))
    success = index.success(asked)
    levels = index.levels(asked, success)
    cells = index.cells(unit(np.array(near.column("embedding").to_pylist())))
    reached = np.array([bucket_success(success[i], c[None]).max() for i, c in zip(q, cells, strict=True)])
    promised = [1 - np.searchsorted(levels[i], r, "left") / levels.shape[1] for i, r in zip(q, reached, strict=True)]
    index.promise = float(np.quantile(promised, min(recall, 1.0), method="higher"))
    return index


PAIRS = "q long, e long, score double, ids array<long>, scored long"
_PAIRS = pa.schema([("q", pa.int64()), ("e", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64())), ("scored", pa.int64())])


def _best_of(q: np.ndarray, e: np.ndarray, scored: np.ndarray, ids: pa.ChunkedArray, scores: np.ndarray, most: int) -> pa.Table:
    """The `most` best of each row of scores, ties included; -2 is a pair that wasn't compared. A query's first row has its number of compared pairs."""
    m = min(most, scores.shape[1])
    cut = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m]
    a, b = np.nonzero((scores >= cut[:, None]) & (scores > -2))
    first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    return pa.table([q[a], e[b], scores[a, b], ids.take(pa.array(b)), np.where(first, scored[a], 0)], schema=_PAIRS)


def _every(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _hashed(parts: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("entry", F.lit(salt)), parts).cast("int")


def probe(entries: DataFrame, asked: DataFrame, index: Index, dim: int, most: int) -> DataFrame:
    """PAIRS: for each asked (entry, embedding) the `most` best of the entries (entry, embedding, ids) that each part of a visited group holds."""
    kind = "float" if dict(entries.dtypes)["embedding"] == "array<float>" else "double"
    shared = entries.sparkSession.sparkContext.broadcast(index)
    list_type = pa.list_(pa.float32() if kind == "float" else pa.float64())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            cells = index.cells(unit(_vectors(batch, dim)))
            for t in range(TABLES):
                fine = pa.FixedSizeListArray.from_arrays(pa.array(cells[:, t].ravel().astype(np.int8)), PROJECTIONS).cast(pa.list_(pa.int8()))
                yield pa.record_batch([pa.array(np.full(len(cells), t, np.int32)), pa.array(_group_key(cells[:, t, : index.coarse])), fine, batch.column("entry"), batch.column("embedding").cast(list_type), batch.column("ids")], ["t", "grp", "cells", "entry", "embedding", "ids"])

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            key = _group_key(index.cells(unit(_vectors(batch, dim)))[:, :, : index.coarse])
            for t in range(TABLES):
                found, count = np.unique(key[:, t], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(found), t, np.int32)), pa.array(found), pa.array(count)], ["t", "grp", "n_rows"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups where a query's best possible bucket reaches its level, with what the other projections must reach there."""
        index = shared.value
        c = index.coarse
        combos = np.stack(np.meshgrid(*[np.arange(CELLS)] * c, indexing="ij"), -1).reshape(-1, c)
        keys, step = _group_key(combos), int(np.clip(40_000 // len(combos), 1, 64))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = unit(_vectors(part, dim))
                success = index.success(x)
                levels = index.levels(x, success)
                take = min(levels.shape[1] - 1, int((1 - index.promise) * levels.shape[1]))
                need = levels[:, take][:, None, None] - sum(success[:, :, i, combos[:, i]] for i in range(c))  # [rows, TABLES, groups]
                q, t, g = np.nonzero(success[:, :, c:].max(-1).sum(-1)[..., None] >= need)
                yield pa.record_batch(
                    [pa.array(t.astype(np.int32)), pa.array(keys[g]), part.column("entry").take(pa.array(q)), pa.array(need[q, t, g]), part.column("embedding").take(pa.array(q)).cast(list_type)],
                    ["t", "grp", "entry", "need", "embedding"],
                )

    # A row per group that has entries: TABLES * CELLS ** MAX_COARSE at most.
    held = entries.select("embedding").mapInArrow(groups_of, "t int, grp int, n_rows long").groupBy("t", "grp").agg(F.sum("n_rows").alias("n_rows"))
    visits = asked.mapInArrow(visit, f"t int, grp int, entry long, need double, embedding array<{kind}>")
    visits = materialize(visits.join(F.broadcast(held.select("t", "grp")), ["t", "grp"], "left_semi"), "visits")
    sizes = held.join(visits.groupBy("t", "grp").agg(F.count("*").alias("n_visits")), ["t", "grp"])
    sizes = sizes.select("t", "grp", F.ceil(F.col("n_rows") / GROUP_ROWS).cast("int").alias("of_rows"), F.ceil(F.col("n_visits") / GROUP_VISITS).cast("int").alias("of_visits"))
    sizes = materialize(sizes, "groups", 1)
    placed = entries.mapInArrow(place, f"t int, grp int, cells array<tinyint>, entry long, embedding array<{kind}>, ids array<long>").join(F.broadcast(sizes), ["t", "grp"])
    placed = placed.withColumn("row_part", _hashed(F.col("of_rows"), 2)).withColumn("visit_part", _every(F.col("of_visits"))).drop("of_rows", "of_visits")
    visits = visits.join(F.broadcast(sizes), ["t", "grp"]).withColumn("visit_part", _hashed(F.col("of_visits"), 3)).withColumn("row_part", _every(F.col("of_rows"))).drop("of_rows", "of_visits")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """Only rows whose bucket reaches what the query needs are compared, exactly."""
        if not left.num_rows or not right.num_rows:
            return _PAIRS.empty_table()
        index = shared.value
        t, c = left.column("t")[0].as_py(), index.coarse
        x, y = (_vectors(z, dim) for z in (left, right))
        cells = np.asarray(left.column("cells").combine_chunks().flatten()).reshape(-1, PROJECTIONS)[:, c:]
        fine, which = np.unique(cells, axis=0, return_inverse=True)
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        qe, ce, need = right.column("entry").to_numpy(), left.column("entry").to_numpy(), right.column("need").to_numpy()
        out = []
        for i in range(0, len(y), 128):
            part = y[i : i + 128]
            success = index.success(unit(part))[:, t, c:]
            reach = sum(success[:, p, fine[:, p]] for p in range(fine.shape[1])) if fine.shape[1] else np.zeros((len(part), len(fine)))
            a, b = np.nonzero((reach >= need[i : i + 128, None])[:, which.ravel()])
            scores = np.full((len(part), len(x)), -2.0)
            for j in range(0, len(a), 50_000):
                u, v = a[j : j + 50_000], b[j : j + 50_000]
                scores[u, v] = np.einsum("ij,ij->i", part[u], x[v]) / (ny[i + u] * nx[v])
            out.append(_best_of(qe[i : i + 128], ce, np.bincount(a, minlength=len(part)), left.column("ids"), scores, most))
        return pa.concat_tables(out)

    by = ("t", "grp", "row_part", "visit_part")
    return placed.groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(rerank, PAIRS)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine, never itself; ties to the smaller vec_id.

    vectors and queries: (vec_id, embedding). Vectors that are null, zero or hold null or non-finite components take no part,
    nor those of another length than most. Repeated (vec_id, embedding) rows count once. Empty tables give an empty result.
    """
    kind = "float" if all(dict(d.dtypes)["embedding"] == "array<float>" for d in (vectors, queries)) else "double"
    entries = materialize(distinct_vectors(vectors, k + 1, kind), "vectors")
    usable = entries.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not usable:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = usable[0]["dim"], usable[0]["count"]
    entries = entries.where(F.size("embedding") == dim)
    asked = distinct_vectors(queries, 1, kind).where(F.size("embedding") == dim).select("entry", "embedding")
    found = probe(entries, asked, fit(entries, n, dim, k, recall), dim, k + 1)
    best = found.groupBy("q", "e").agg(F.max("score").alias("score"), F.first("ids").alias("ids")).select("q", "score", F.explode("ids").alias("vec_id"))
    few = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    ids = usable_vectors(queries, kind).select(F.col("vec_id").alias("query_id"), F.col("entry").alias("q")).distinct()
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.where("vec_id <> query_id").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = materialize(ranked(ids.join(best.select("q", "score", "vec_id"), "q")), "neighbours")
    full = out.where(F.col("rank") == k).select("query_id")
    short = materialize(ids.join(asked.select(F.col("entry").alias("q"), "embedding"), "q").join(full, "query_id", "left_anti"), "short")
    n_short = short.count()
    if not n_short:
        return out

    # The buckets gave these queries fewer than k rows: all entries are compared with them, in blocks. An id that stands for
    # several vectors may take as many places of its own query.
    same = usable_vectors(vectors, kind).select(F.col("vec_id").alias("query_id"), F.col("entry").alias("e")).join(short.select("query_id").distinct(), "query_id", "left_semi")
    own_rows = same.groupBy("query_id").agg(F.count_distinct("e").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks, parts = math.ceil(n / SCAN_ROWS), math.ceil(n_short / SCAN_ROWS)
    left = entries.select("entry", "embedding", "ids", _hashed(F.lit(blocks), 1).alias("block"), _every(F.lit(parts)).alias("part"))
    right = short.select(F.col("q").alias("entry"), "embedding").dropDuplicates(["entry"]).withColumn("part", _hashed(F.lit(parts), 1)).select("entry", "embedding", "part", _every(F.lit(blocks)).alias("block"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIRS.empty_table()
        x, y = (_vectors(z, dim) for z in (left, right))
        qe, ce = right.column("entry").to_numpy(), left.column("entry").to_numpy()
        return pa.concat_tables([_best_of(qe[i : i + 256], ce, np.full(len(y[i : i + 256]), len(x)), left.column("ids"), cosine(y[i : i + 256], x), k + own_rows) for i in range(0, len(y), 256)])

    scanned = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(scan, PAIRS)
    scanned = scanned.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + own_rows)
    completed = ranked(short.select("query_id", "q").join(scanned.select("q", "score", "vec_id"), "q"))
    return out.join(short.select("query_id").distinct(), "query_id", "left_anti").select(out.columns).unionByName(completed)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products over norms, in double precision, on the original vectors."""
    return (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])
