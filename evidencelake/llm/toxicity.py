"""Toxicity by weak supervision.

Voters are lexicons of insults (several themes, four languages), lexicons mined from the labels (whole words and beginnings
of words that toxic documents have far more often, in two tiers), and patterns over their hits. One pass over the whole texts
gives each document its hit counts; the distinct vote patterns, with their counts, are all that the label model sees (at
most 2 ** voters rows). The label model is generative: given the hidden class, voters form a tree of pairs, each firing at a
rate that depends on the class and on its parent in the tree. Rates (accuracies) and pairs (correlations: the tree of most
mutual information given the class) are found by EM over all documents, nearly all of them without a label; where a label may
be learnt from it is one more voter, whose error rates are estimated like the others'. EM starts from the votes alone.

The model's posteriors label a bounded sample of all documents, on which a linear classifier over the hit counts is fitted.
That classifier scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm.common import materialize
from evidencelake.llm.hashing import NOT_LETTER, Powers, Slice, mix, slices, word_hash
from evidencelake.llm.quality_model import is_held_out

#: Fixed word lists by theme, lower case, whole words.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid stupidity imbecile imbeciles dimwit dimwits halfwit brainless dumbass dunce nitwit dumb idiotisch dumm dummkopf trottel vollidiot schwachkopf imbécile crétin débile abruti idiota idiotas imbécil estúpido estúpida tarado",
    "worth": "worthless pathetic loser losers useless failure nobody wertlos erbärmlich versager nichtsnutz minable pathétique incapable inútil patético fracasado perdedor",
    "disgust": "disgusting vile repulsive revolting filthy sickening widerlich ekelhaft abstoßend dégoûtant répugnant immonde asqueroso repugnante",
    "refuse": "trash garbage scum scumbag vermin filth lowlife abschaum gesindel dreckskerl drecksack ordure raclure vermine escoria basura chusma",
    "ridicule": "clown clowns buffoon laughable witzfigur hampelmann bouffon guignol payaso bufón",
    "curse": "bastard bitch asshole fuck fucking shit bullshit crap arschloch scheiße hurensohn miststück connard salope putain merde enculé mierda puta cabrón gilipollas pendejo",
    "threat": "kys verrecke crève muérete",
}
PATTERNS = ("several", "distinct", "dense", "shouted", "mined_strong", "mined_family", "mined_distinct", "mined_dense")
#: Bytes of a word's beginning that the miner counts, beside whole words (0).
STEMS = (0, 4, 5, 6, 7, 8, 10)
VOTERS = (*LEXICONS, *PATTERNS)
_VOTER_OF = np.concatenate([np.full(len(v.split()), i) for i, v in enumerate(LEXICONS.values())])
_HASHES = word_hash([w for v in LEXICONS.values() for w in v.split()])
_ORDER = np.argsort(_HASHES)
_SORTED, _SORTED_VOTER = _HASHES[_ORDER], _VOTER_OF[_ORDER]
N_LEX = len(LEXICONS)
N_COUNTS = N_LEX + 6  # hits per lexicon, distinct words hit, shouted hits, words, mined hits of both tiers, distinct words with one


@dataclass
class Mined:
    """Sorted hashes of the mined words and beginnings, and whether each is of the strong tier."""

    hashes: np.ndarray
    strong: np.ndarray

    @staticmethod
    def none() -> Mined:
        return Mined(np.empty(0, np.uint64), np.empty(0, bool))


def stem_hashes(s: Slice, powers: Powers, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of words, hashes) of the words' first bytes, where a word is longer; all words for length 0."""
    if not length:
        return np.arange(len(s.word)), s.word
    at = np.flatnonzero(s.ends - s.starts > length)
    return at, s.span(s.starts[at], length, powers)


def hit_counts(texts: pa.Array, mined: Mined, powers: Powers | None = None) -> np.ndarray:
    """Per text the N_COUNTS counts. Zeros for null and blank texts."""
    powers = powers or Powers()
    texts = texts.cast(pa.large_string())
    out = []
    lowered = slices(pc.utf8_lower(texts), powers, NOT_LETTER)
    for s in lowered:
        n = len(s.offsets) - 1
        x = np.zeros((n, N_COUNTS))
        at = np.minimum(np.searchsorted(_SORTED, s.word), len(_SORTED) - 1)
        hits = np.flatnonzero(_SORTED[at] == s.word)
        doc = np.searchsorted(s.bounds, hits, "right") - 1
        np.add.at(x, (doc, _SORTED_VOTER[at[hits]]), 1)
        pairs = np.unique(doc * len(_SORTED) + at[hits])
        np.add.at(x, (pairs // len(_SORTED), N_LEX), 1)
        x[:, N_LEX + 2] = np.diff(s.bounds)
        if len(mined.hashes) and len(s.word):
            tier = np.zeros(len(s.word), np.int8)
            for length in STEMS:
                at, h = stem_hashes(s, powers, length)
                k = np.minimum(np.searchsorted(mined.hashes, h), len(mined.hashes) - 1)
                found = mined.hashes[k] == h
                tier[at[found]] = np.maximum(tier[at[found]], 1 + mined.strong[k[found]])
            for column, level in ((N_LEX + 3, 2), (N_LEX + 4, 1)):
                sums = np.concatenate(([0], np.cumsum(tier == level)))
                x[:, column] = sums[s.bounds[1:]] - sums[s.bounds[:-1]]
            hits = np.flatnonzero(tier)
            doc = np.searchsorted(s.bounds, hits, "right") - 1
            _, first = np.unique(s.word[hits] + mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
            x[:, N_LEX + 5] = np.bincount(doc[first], minlength=n)
        out.append(x)
    x = np.concatenate(out) if out else np.zeros((0, N_COUNTS))
    for i in np.flatnonzero(x[:, :N_LEX].sum(1)):
        text = texts[int(i)].as_py()
        x[i, N_LEX + 1] = sum(w.isupper() and len(w) > 1 for w in text.split() if w.strip(".,;:!?").lower() in _ALL) if not text.isupper() else 0
    return x


_ALL = frozenset(w for v in LEXICONS.values() for w in v.split())


def votes(x: np.ndarray) -> np.ndarray:
    """0/1 per voter: each lexicon with a hit; three hits or more; two distinct words; one hit in 40 words; a shouted hit; then the mined hits likewise."""
    total, strong, family, distinct = x[:, :N_LEX].sum(1), x[:, N_LEX + 3], x[:, N_LEX + 4], x[:, N_LEX + 5]
    own = (total >= 3, x[:, N_LEX] >= 2, (total > 0) & (40 * total >= x[:, N_LEX + 2]), x[:, N_LEX + 1] > 0)
    mined = (strong >= 1, family >= 2, distinct >= 3, (strong + family >= 2) & (60 * (strong + family) >= x[:, N_LEX + 2]))
    return np.column_stack((x[:, :N_LEX] > 0, *own, *mined)).astype(int)


def linear_features(x: np.ndarray) -> np.ndarray:
    total, mined = x[:, :N_LEX].sum(1), x[:, N_LEX + 3] + x[:, N_LEX + 4]
    rest = (*np.log1p(x[:, N_LEX + 3 : N_LEX + 6]).T, x[:, N_LEX + 5] >= 2, x[:, N_LEX + 5] >= 3, np.log1p(100 * mined / np.maximum(x[:, N_LEX + 2], 1)))
    return np.column_stack((*rest, np.log1p(x[:, :N_LEX]), total >= 1, total >= 2, total >= 3, np.log1p(total), np.log1p(x[:, N_LEX]), np.log1p(100 * total / np.maximum(x[:, N_LEX + 2], 1)), np.log1p(x[:, N_LEX + 1])))


@dataclass
class LabelModel:
    """P(class), and given the class: each voter's rate per state of its parent, and the share of labels that are 1."""

    prior: float
    parent: np.ndarray  # of each voter in the tree; -1 for none
    rates: np.ndarray  # [2 classes, voters, 2 states of the parent]
    label_rates: np.ndarray  # [2]

    def posterior(self, v: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic | votes, label); label -1 is none."""
        above = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)
        fires = self.rates[:, np.arange(v.shape[1]), above]  # [2, rows, voters]
        seen = np.where(v == 1, np.log(fires), np.log1p(-fires)).sum(-1)
        told = np.where(label == 1, np.log(self.label_rates)[:, None], np.where(label == 0, np.log1p(-self.label_rates)[:, None], 0.0))
        z = np.log(self.prior / (1 - self.prior)) + (seen + told)[1] - (seen + told)[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_label_model(v: np.ndarray, label: np.ndarray, n: np.ndarray, rounds: int = 80) -> LabelModel:
    """EM over distinct (votes, label) rows with counts n; label -1 is none. Starts with: voters that agree, and aren't copies of each other, are right."""
    k = v.shape[1]
    centred = v - (n @ v) / max(n.sum(), 1)
    spread = np.sqrt(np.maximum(n @ centred**2, 1e-9))
    copies = np.triu(np.abs((centred * n[:, None]).T @ centred / np.outer(spread, spread)) > 0.98, 1)
    parent, known = np.where(copies.any(0), copies.argmax(0), -1), label >= 0
    fired = v @ (parent < 0)
    q = np.where(fired >= 2.5, 0.9, np.where(fired > 0, 0.4, 0.02))
    for step in range(rounds):
        if step in (5, 20, 40):
            parent = correlation_tree(v, n, q)
        rates, shares = np.empty((2, k, 2)), np.empty(2)
        for y, w in ((0, n * (1 - q)), (1, n * q)):
            alone = (w @ v + (0.01, 0.5)[y]) / (w.sum() + 1)
            for state in (0, 1):
                # Of voters without a parent both states hold the one rate
                has = np.where(parent[None] >= 0, v[:, np.maximum(parent, 0)] == state, True) * w[:, None]
                rates[y, :, state] = ((has * v).sum(0) + 2 * alone) / (has.sum(0) + 2)
            ones, zeros = ((1, 3), (3, 1))[y]
            shares[y] = ((w * known) @ (label == 1) + ones) / ((w * known).sum() + ones + zeros)
        prior = float(np.clip((n @ q) / max(n.sum(), 1), 1e-4, 0.5))
        model = LabelModel(prior, parent, np.clip(rates, 1e-5, 1 - 1e-5), np.clip(shares, 1e-3, 1 - 1e-3))
        q = model.posterior(v, label)
    return model


def correlation_tree(v: np.ndarray, n: np.ndarray, q: np.ndarray, evidence: float = 8.0) -> np.ndarray:
    """Each voter's parent in the tree of most mutual information between voters given the class; -1 where the data show none."""
    k, information = v.shape[1], np.zeros((v.shape[1], v.shape[1]))
    for w in (n * (1 - q), n * q):
        if w.sum() < 20:
            continue
        one, both = (w @ v) / w.sum(), (v * w[:, None]).T @ v / w.sum()
        for a, b, joint in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one[None] - both), (1 - one, 1 - one, 1 - one[:, None] - one[None] + both)):
            apart = np.maximum(np.outer(a, b), 1e-15)
            information += w.sum() * np.where(joint > 1e-12, joint * np.log(np.maximum(joint, 1e-12) / apart), 0)
    np.fill_diagonal(information, 0)
    parent = np.full(k, -1)
    inside = [int(information.sum(0).argmax())]
    while len(inside) < k:
        gain, a, b = max((information[i, j], i, j) for i in inside for j in range(k) if j not in inside)
        if gain < evidence:
            break
        parent[b] = a
        inside.append(b)
    return parent


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last coefficient is the intercept."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (target - p)) - penalty @ w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w)), g)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and stem: toxic and clean documents that have it."""
    powers = Powers()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            label = part.column("label").to_numpy()
            done, keys, owners = 0, [], []
            for s in slices(pc.utf8_lower(part.column("text").cast(pa.large_string())), powers, NOT_LETTER):
                for length in STEMS:
                    at, h = stem_hashes(s, powers, length)
                    owner = np.searchsorted(s.bounds, at, "right") - 1
                    _, first = np.unique(h + mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)
                    keys.append(h[first].view(np.int64))
                    owners.append(owner[first] + done)
                done += len(s.offsets) - 1
            if keys:
                key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                toxic = np.bincount(inverse, label[np.concatenate(owners)] == 1, len(key)).astype(np.int64)
                both = np.bincount(inverse, minlength=len(key))
                yield pa.record_batch([pa.array(key), pa.array(toxic), pa.array(both - toxic)], ["stem", "toxic", "clean"])


def mine(docs: DataFrame, known: DataFrame, max_rows: int = 8_000, most: int = 300, least: int = 5, evidence: float = 30.0) -> Mined:
    """Stems of label 1, from at most max_rows labelled documents (half of them toxic, as far as there are): at least `least`
    toxic documents have them and the likelihood ratio against chance is over `evidence`; the `most` strongest are kept."""
    half = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for y in (0, 1)]
    sample = F.broadcast(half[0].unionByName(half[1]))  # at most max_rows ids
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("text", "label")
    totals = {int(r["label"]): r["count"] for r in half[0].unionByName(half[1]).groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Mined.none()
    sums = rows.mapInArrow(_stem_counts, "stem long, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= least)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    part = lambda k, n: k * F.log(F.greatest(k, F.lit(1e-9)) / ((t + c) * n / (n1 + n0)))
    gain = 2 * (part(t, n1) + part(c, n0) + _rest(n1 - t, n1, t, c, n1 + n0) + _rest(n0 - c, n0, t, c, n1 + n0))
    share = (c + 0.5) / n0 / ((t + 0.5) / n1)
    found = sums.withColumn("gain", gain).withColumn("share", share).where((F.col("gain") > evidence) & (F.col("share") < 0.25)).orderBy(F.desc("gain"), "stem").limit(most).select("stem", "share").toArrow()
    h = found.column("stem").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Mined(h[order], found.column("share").to_numpy()[order] < 0.02)


def _rest(k: Column, n: int, t: Column, c: Column, total: int) -> Column:
    """The likelihood ratio's term of the documents without the stem."""
    return F.when(k > 0, k * F.log(k / F.greatest((total - t - c) * n / total, F.lit(1e-9)))).otherwise(0.0)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) that may be learnt from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return known.where(~is_held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("label").alias("label"))


def count_hits(docs: DataFrame, mined: Mined) -> DataFrame:
    """(doc_id, x, pattern) for every row of docs, kept as a table: the only pass over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(mined)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = hit_counts(part.column("text"), shared.value, powers)
                pattern = votes(x) @ (1 << np.arange(len(VOTERS)))
                yield pa.record_batch([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64())), pa.array(pattern.astype(np.int32))], ["doc_id", "x", "pattern"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(source.mapInArrow(rows, "doc_id long, x array<double>, pattern int"), "hits")


def train(hits: DataFrame, known: DataFrame, max_rows: int = 30_000) -> np.ndarray:
    """Linear coefficients. The label model sees the vote patterns of all rows, with the labels of at most max_rows; the
    classifier is fitted to its posteriors of at most max_rows rows, labelled or not, those of smallest hash of doc_id."""
    labels = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # at most max_rows ids
    voted = hits.join(labels, "doc_id", "left").select("doc_id", "pattern", F.coalesce("label", F.lit(-1)).alias("label"), "x")
    every = voted.groupBy("pattern", "label").count().toArrow()  # at most three rows per pattern of votes
    patterns, label, n = (every.column(c).to_numpy() for c in ("pattern", "label", "count"))
    if not len(patterns):
        return np.append(np.zeros(linear_features(np.zeros((1, N_COUNTS))).shape[1]), -2.0)
    bits = lambda p: (p[:, None] >> np.arange(len(VOTERS))) & 1
    model = fit_label_model(bits(patterns), label, n.astype(float))
    sample = voted.orderBy(F.xxhash64("doc_id"), "doc_id", "pattern", "label", "x").limit(max_rows).toArrow()
    x = np.asarray(sample.column("x").combine_chunks().flatten()).reshape(-1, N_COUNTS)
    target = model.posterior(bits(sample.column("pattern").to_numpy()), sample.column("label").to_numpy())
    return fit_linear(linear_features(x), target, np.ones(len(x)))


def _probability(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(linear_features(x) @ coefficients[:-1] + coefficients[-1], -30, 30)))


def score(hits: DataFrame, coefficients: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of hits; plain column arithmetic on the counts."""
    shared = hits.sparkSession.sparkContext.broadcast(coefficients)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            s = _probability(flat.reshape(-1, N_COUNTS), shared.value)
            yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = hits.select("doc_id", "x").mapInArrow(rows, "doc_id long, score double, predicted int")
    return scored.select("doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    Null and empty texts have no hits and get the clean score. Repeated rows come out as often as they came in; of a doc_id
    with several labels the largest counts. Without labels the vote patterns alone are learnt from. An empty table gives an
    empty result.
    """
    known = materialize(known_labels(labels), "labels")
    hits = count_hits(docs, mine(docs, known))
    return score(hits, train(hits, known), threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with score_toxicity's `predicted` 0, each judged by its own text in a second pass; ids play no part."""
    known = materialize(known_labels(labels), "labels")
    mined = mine(docs, known)
    shared = docs.sparkSession.sparkContext.broadcast((mined, train(count_hits(docs, mined), known)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        mined, coefficients = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(_probability(hit_counts(part.column("text"), mined, powers), coefficients) < threshold))

    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(rows, typed.schema)
