"""The manifest against a tree built by plain Python: several tiers, other fans, nulls, repeated rows, one hot language."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import merkle, sha256

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int, tree int"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def walk(at, tree, now, fan):
    """The siblings of place `at` up to the root, and the root with `now` in its place."""
    proof = ""
    for below in tree[:-1]:
        run = list(below[at // fan * fan : at // fan * fan + fan])
        proof += "".join(h for i, h in enumerate(run) if i != at % fan)
        run[at % fan] = now
        at, now = at // fan, H("".join(run))
    return proof, now


def brute(rows, fan):
    by = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        by.setdefault(r[2], []).append((r[0], leaf(*r[:5]), leaf(*r[:3], r[3] + 1, r[4]) if changed else leaf(*r[:5])))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = levels([x[1] for x in by[lang]], fan)
    top = levels([trees[lang][-1][0] for lang in order], fan)
    out = []
    for k, lang in enumerate(order):
        for i, (doc_id, own, other) in enumerate(by[lang]):
            proof, sub = walk(i, trees[lang], other, fan)
            more, root = walk(k, top, sub, fan)
            out.append((doc_id, own, trees[lang][-1][0], top[-1][0], H(proof + more), root, root == top[-1][0]))
    return out


def rows_of(n):
    rng = np.random.default_rng(5)
    langs = [None, "", "de", "é", "zh"]
    rows = [(i - 3, "s" if i % 4 else None, "en" if i % 3 == 0 else langs[i % 5], i if i % 6 else None, "é" * int(rng.integers(0, 40)) if i % 9 else None, "x", 1, 2) for i in range(n)]
    return rows + [rows[0]] * 40 + [(None, None, None, None, None, None, None, None)] * 2 + [(rows[4][0], "other", *rows[4][2:])]


@pytest.mark.parametrize(("fan", "most"), [(2, 8), (3, 10), (2, 4096)])
def test_equals_plain_trees(spark, fan, most):
    rows = rows_of(230)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.verify(docs, F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars")), fan, most)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows, fan)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1])
def test_none_and_one(spark, n):
    rows = rows_of(9)[:n]
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA), F.col("n_chars")).collect()
    assert [tuple(r) for r in got] == ([] if n == 0 else [(-3, leaf(*rows[0][:5]), *[leaf(*rows[0][:5])] * 2, H(""), leaf(*rows[0][:5]), True)])


def test_midstates_resume():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, (50, 32)).astype(np.uint8) for _ in range(5)]
    state = sha256.start(50)
    for k, p in enumerate(parts):
        stored = sha256.unpack(state)
        assert stored.shape == (50, 32)
        state = sha256.compress(sha256.pack(stored), sha256.hex_block(p))
        want = [hashlib.sha256(b"".join(q[i].tobytes().hex().encode() for q in parts[: k + 1])).digest() for i in range(50)]
        assert [x.tobytes() for x in sha256.finish(state, k + 1)] == want
