"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text come from vectorised byte and word counts. Cyclic boosting visits one feature after another and
adds a shallow tree over its bins to the feature's lookup table; then the strongest pairs of what is left get tables of
their own, in the same way. Scoring looks up bins and adds: no tree is walked. The fit is NumPy on a bounded sample of
labelled rows (max_rows, taken by the hash of doc_id); scoring is one narrow pass over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.hashing import Powers, mix, odd, slices

FEATURES = (
    "log_words", "word_bytes", "symbols", "upper", "pipes", "distinct_words", "repeats_previous", "distinct_triples", "repeated_lines", "digits", "exclamations",
    "words_a_line", "log_lines", "ends_in_mark", "top_word", "capitals", "symbol_ends",
)
BINS, PAIR_BINS = 32, 8

_SYMBOL, _UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>~^_={}[]")] = True
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARK[list(b".,;:!?")] = True
_TRIPLE = odd(3, 6)


def features(texts: pa.Array, powers: Powers | None = None) -> np.ndarray:
    """One row of FEATURES per text; zeros for null and blank texts."""
    out = []
    for s in slices(texts, powers or Powers()):
        n_texts = len(s.offsets) - 1
        x = np.zeros((n_texts, len(FEATURES)))
        size = np.maximum(np.diff(s.offsets), 1)

        def per_text(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(flags)))
            return sums[s.offsets[1:]] - sums[s.offsets[:-1]]  # noqa: B023

        def per_words(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(flags)))
            return sums[s.bounds[1:]] - sums[s.bounds[:-1]]  # noqa: B023

        n = np.diff(s.bounds)
        some = np.maximum(n, 1)
        upper, lower = per_text(_UPPER[s.data]), per_text(_LOWER[s.data])
        breaks = np.flatnonzero(s.data == 10)
        lines = per_text(s.data == 10) + 1
        last = s.data[s.ends - 1] if len(s.ends) else s.data[:0]
        x[:, 0] = np.log1p(n)
        x[:, 1] = per_words(s.ends - s.starts) / some
        x[:, 2] = per_text(_SYMBOL[s.data]) / size
        x[:, 3] = upper / np.maximum(upper + lower, 1)
        x[:, 4] = per_text(s.data == 124) / some
        x[:, 9] = per_text(_DIGIT[s.data]) / size
        x[:, 10] = per_text(s.data == 33) / some
        x[:, 11] = np.log1p(n / lines)
        x[:, 12] = np.log(lines)
        x[:, 13] = per_words(_MARK[last]) / some
        x[:, 15] = per_words(_UPPER[s.data[s.starts]] if len(s.starts) else last) / some
        x[:, 16] = per_words(_SYMBOL[last]) / some
        triple = mix(s.word[:-2] * _TRIPLE[0] + s.word[1:-1] * _TRIPLE[1] + s.word[2:] * _TRIPLE[2]) if len(s.word) > 2 else s.word[:0]
        for i in range(n_texts):
            a, b = s.bounds[i], s.bounds[i + 1]
            if a == b:
                continue
            own = np.sort(s.word[a:b])
            changes = np.flatnonzero(own[1:] != own[:-1])
            runs = np.diff(np.concatenate(([-1], changes, [b - a - 1])))
            x[i, 5] = len(runs) / (b - a)
            x[i, 14] = runs.max() / (b - a)
            x[i, 6] = np.count_nonzero(s.word[a + 1 : b] == s.word[a : b - 1]) / (b - a)
            x[i, 7] = len(np.unique(triple[a : b - 2])) / (b - a - 2) if b - a > 2 else 1.0
            cut = breaks[np.searchsorted(breaks, s.offsets[i]) : np.searchsorted(breaks, s.offsets[i + 1])]
            if len(cut):
                at = np.unique(np.searchsorted(s.starts[a:b], np.concatenate(([s.offsets[i]], cut))))
                at = at[at < b - a]
                sums = _line_hashes(s.word[a:b], at)
                x[i, 8] = 1 - len(np.unique(sums)) / len(sums)
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _line_hashes(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per line from its words and their places in it."""
    place = np.arange(len(word), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(word)))).astype(np.uint64)
    return np.add.reduceat(mix(word + place * np.uint64(0x9E3779B97F4A7C15)), at)


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best gain and place of one cut of a row of bins; place 0 for none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((hl >= least) & (hr >= least), gain, 0)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) and gain[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Steps per bin of a tree of depth two."""
    step = np.zeros(len(g))
    _, k = _cut(g, h, least)
    for a, b in ((0, k), (k, len(g))):
        if b > a:
            _, m = _cut(g[a:b], h[a:b], least)
            for c, d in ((a, a + m), (a + m, b)):
                if d > c:
                    step[c:d] = g[c:d].sum() / (h[c:d].sum() + 1)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Steps per cell: one cut of the first feature, then one of the second on each side."""
    step = np.zeros(g.shape)
    _, k = _cut(g.sum(1), h.sum(1), least)
    for a, b in ((0, k), (k, len(g))):
        if b > a:
            gs, hs = g[a:b].sum(0), h[a:b].sum(0)
            _, m = _cut(gs, hs, least)
            for c, d in ((0, m), (m, len(gs))):
                if d > c:
                    step[a:b, c:d] = gs[c:d].sum() / (hs[c:d].sum() + 1)
    return step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1) -> Model:
    """Additive tables, then pair tables on what they leave. Without both labels: the share of label 1 (0.5 without rows)."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    grid = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) for f in range(x.shape[1])]
    model.edges, model.pair_edges = grid(BINS), grid(PAIR_BINS)
    bins = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z, least = np.full(len(y), model.intercept), 2.0
    for _ in range(rounds):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-z))
            n = len(model.tables[f])
            step = rate * _tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), least)
            model.tables[f] += step
            z += step[b]
    coarse = [np.searchsorted(model.pair_edges[f], x[:, f], "right") for f in range(x.shape[1])]
    wide = [len(e) + 1 for e in model.pair_edges]
    p = 1 / (1 + np.exp(-z))
    found = []
    for a, b in combinations(range(x.shape[1]), 2):
        cell = coarse[a] * wide[b] + coarse[b]
        g, h = np.bincount(cell, y - p, wide[a] * wide[b]), np.bincount(cell, p * (1 - p), wide[a] * wide[b])
        found.append((float((g**2 / (h + 1)).sum()), a, b))
    for _, a, b in sorted(found, reverse=True)[:n_pairs]:
        model.pairs.append((a, b))
        model.pair_tables.append(np.zeros((wide[a], wide[b])))
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            cell = coarse[a] * wide[b] + coarse[b]
            g, h = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p)))
            step = rate * _pair_tree(g, h, least)
            table += step
            z += step[coarse[a], coarse[b]]
    return model


def is_held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        x = features(batch.column("text"), powers)
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64())), batch.column("label")], ["doc_id", "x", "label"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 30_000) -> Model:
    """Fit on at most max_rows rows of docs joined with labels (doc_id, quality), the labels of smallest hash of doc_id, held-out rows left aside.

    Of a doc_id with several labels the largest counts; each of its distinct texts is a row. Without rows the model knows only
    a share of 0.5.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("label"))
    known = known.where(~is_held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # at most max_rows ids
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("doc_id", "text", "label")
    got = chosen.mapInArrow(_feature_rows, "doc_id long, x array<double>, label double").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(FEATURES))
    return fit(x, got.column("label").to_numpy())


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Null and empty texts get the score of a text without words. Repeated rows come out as often as they came in, each judged
    by its own text; rows without doc_id are not held out. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                s = shared.value.score(features(part.column("text"), powers))
                yield pa.record_batch([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, score double, predicted int")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def keep_accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs with score's `predicted` 1, each judged by its own text; ids play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array(shared.value.score(features(part.column("text"), powers)) >= threshold))

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(rows, typed.schema)
