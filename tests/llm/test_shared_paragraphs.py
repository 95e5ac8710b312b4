"""Texts that share most of their paragraphs and aren't near-duplicates: few are compared on full sets, and no link is lost."""

import random

import numpy as np
import pyarrow as pa

from evidencelake.llm import minhash


def test_few_full_comparisons(spark, monkeypatch):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    common = [" ".join(word() for _ in range(20)) for _ in range(40)]
    texts = []
    for _ in range(300):
        chosen = sorted(rnd.sample(range(40), 34))
        texts.append(" ".join(common[k] for k in chosen))
    texts += [t + " some words more at the end" for t in texts[:20]]
    compared = []
    confirmed = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, sets, percent: compared.append(pairs.count()) or confirmed(pairs, sets, percent))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(s.tolist()) for s in minhash.shingle_sets(pa.array(texts))]
    component = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if 100 * common_ >= 85 * (len(sets[i]) + len(sets[j]) - common_) and component[i] != component[j]:
                a, b = sorted((component[i], component[j]))
                component = [a if c == b else c for c in component]
    assert got == dict(enumerate(component))
    pairs = len(texts) * (len(texts) - 1) // 2
    assert sum(compared) < 0.1 * pairs, (compared, pairs)


def test_parities_bound_differences():
    rng = np.random.default_rng(2)
    for n in (1, 10, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3, np.uint64)])
        apart = int(np.bitwise_count((minhash._parity(a.view(np.int64)) ^ minhash._parity(b.view(np.int64))).view(np.uint64)).sum())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
        assert len(minhash._parity(a.view(np.int64))) * 64 == minhash.PARITY_BITS
