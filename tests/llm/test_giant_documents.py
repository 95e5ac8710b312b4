"""Documents over the production limit take the chunked path, whose matrices are combined in a tree."""

import random

import pyarrow as pa
from test_llm_operators import documents, odd_rows

from evidencelake.llm import sentencepiece


def test_giant_documents_get_the_encoders_ids(spark):
    v = sentencepiece.load(sentencepiece.MODEL)
    rng = random.Random(9)
    words = ["the", "of", "internationalisation", "naïve", "straße", "中文", "😀", "x" * 40, "a", "-", "12345", "\n", "  "]
    giant = " ".join(rng.choice(words) for _ in range(70_000))
    assert len(giant) > 300_000
    rows = [r for r in odd_rows() if r[0] in (4, 6, 7)] + [(20, giant, "en", "a"), (21, giant, "en", "b"), (None, giant[:120_000], "en", "b")]
    got = sentencepiece.encode(documents(spark, rows)).collect()
    key = lambda i, ids: (-1 if i is None else i, ids)
    assert sorted(key(r["doc_id"], r["ids"]) for r in got) == sorted(key(i, v.sp.encode(t)) for i, t, *_ in rows)
    assert all(r["round_trip"] for r in got)


def test_the_tree_of_matrices_finds_the_one_path(spark):
    """Any number of chunks: the states handed down are those of a walk from left to right."""
    v = sentencepiece.load(sentencepiece.MODEL)
    rng = random.Random(10)
    rows, want = [], {}
    for n in (1, 2, 3, 4, 5, 7, 13):
        text = "".join(rng.choice(["the ", "ing", "nonon", " a", "isis", "é"]) for _ in range(200))[: 9 * n]
        m = [sentencepiece.transfer(v, *p[1:]) for p in sentencepiece.chunks(v, v.sp.normalize(text), 9)]
        path = sentencepiece.states(m)
        for i, x in enumerate(m):
            rows.append((bytes([n]), i, sentencepiece._pack([(a, b) for a, bs in x.items() for b in bs]).tolist()))
            want[n, i] = [*path[i], *path[i + 1]]
    got = sentencepiece.boundary_states(spark.createDataFrame(rows, "key binary, node int, cells array<int>"))
    assert {(r["key"][0], r["node"]): r["between"] for r in got.collect()} == want


def test_products_do_not_depend_on_their_order():
    v = sentencepiece.load(sentencepiece.MODEL)
    text = v.sp.normalize("some words and more of them, nonononon " * 4)
    m = [sentencepiece.transfer(v, *p[1:]) for p in sentencepiece.chunks(v, text, 11)]
    left = m[0]
    for x in m[1:]:
        left = sentencepiece.combine(left, x)
    right = m[-1]
    for x in reversed(m[:-1]):
        right = sentencepiece.combine(x, right)
    assert left == right
    packed = pa.table({"key": [b"k"] * 2, "node": pa.array([1, 0], pa.int32()), "cells": pa.array([sentencepiece._pack([(a, b) for a, bs in x.items() for b in bs]) for x in (m[1], m[0])], pa.list_(pa.int32()))})
    assert sentencepiece._matrix(sentencepiece._pair(packed).column("cells")[0].as_py()) == sentencepiece.combine(m[0], m[1])


def test_documents_without_a_legal_path(spark):
    """They have no states, whatever the others have; the encoder's own ids are theirs."""
    pack = lambda m: sentencepiece._pack([(a, b) for a, bs in m.items() for b in bs]).tolist()
    start, other, end = (0, 0), (-1, 2), (-1, 0)
    rows = [(b"a", 0, pack({start: [other]})), (b"a", 1, pack({other: [end]})), (b"b", 0, pack({start: [end]})), (b"b", 1, pack({other: [end]})), (b"c", 0, pack({start: [end]})), (b"d", 0, []), (b"e", 0, pack({other: [end]}))]
    got = sentencepiece.boundary_states(spark.createDataFrame(rows, "key binary, node int, cells array<int>")).collect()
    assert sorted((bytes(r["key"]), r["node"], tuple(r["between"])) for r in got) == [(b"a", 0, (*start, *other)), (b"a", 1, (*other, *end)), (b"c", 0, (*start, *end))]
    v = sentencepiece.load(sentencepiece.MODEL)
    texts = spark.createDataFrame([(b"x", ""), (b"y", "some words of a text " * 9)], "key binary, text string")  # an empty text has no chunk, so no path
    assert {bytes(r["key"]): r["ids"] for r in sentencepiece.encode_giants(texts, chunk_chars=20).collect()} == {b"x": [], b"y": v.sp.encode("some words of a text " * 9)}
    nothing = sentencepiece.encode_giants(texts.where("key = X'78'"))
    assert [(bytes(r["key"]), r["ids"]) for r in nothing.collect()] == [(b"x", [])]
