"""Decontamination against plain Python: short items, null and empty texts, repeats, overlaps, words beyond ASCII, long documents."""

import random
import re

from evidencelake.llm import decontaminate

DOCS = "doc_id long, text string, item_id int, row int"
ITEMS = "item_id int, text string, window string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    wins = {}
    for item, text, *_ in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    lengths = {len(k) for k in wins}
    out = []
    for doc_id, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    names.update(str(x) for x in wins[k] if x is not None)
        runs = [[p for p in sorted(hit) if p - 1 not in hit], [p for p in sorted(hit) if p + 1 not in hit]]
        out.append((doc_id, len(w), len(hit), len(names), sorted(names), list(zip(*runs, strict=True)), bool(hit)))
    return out


def same(spark, docs, items, size=10):
    got = decontaminate.judge(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), size)
    have = [(r[0], r[1], r[2], r[3], r[4], sorted(map(tuple, r[5])), r[6]) for r in got.collect()]
    want = brute(docs, items, size)
    assert sorted(map(str, have)) == sorted(map(str, want))
    return want


def test_equals_brute_force(spark):
    rnd = random.Random(7)
    some = lambda n: [rnd.choice(["a", "B", "c1", "é", "Öx", "中文", "dd"]) for _ in range(n)]
    items = [(i, " ".join(some(rnd.choice([1, 2, 3, 9, 10, 11, 25]))), "w") for i in range(12)]
    items += [(12, None, ""), (13, " .,; ", ""), (None, " ".join(some(14)), ""), (3, " ".join(some(12)), ""), items[0], (14, "same same same same same same same same same same same", "")]
    docs = [(i, " ".join(some(40)), 1, 1) for i in range(20)]
    for k, (_, text, _w) in enumerate(items):
        noise = " ".join(some(rnd.randint(0, 8)))
        docs.append((100 + k, f"{noise}, {(text or '').upper().replace('É', 'é').replace('ÖX', 'ÖX')}!{text or ''} {noise}", 1, 1))
    docs += [(7, docs[3][1], 1, 1), docs[25], docs[25], (None, docs[26][1], 1, 1), (300, None, 1, 1), (301, "", 1, 1), (302, "same " * 500, 1, 1), (303, " ".join(some(30_000)) + " " + items[6][1], 1, 1)]
    want = same(spark, docs, items)
    assert {w[-1] for w in want} == {True, False}
    same(spark, docs, items, size=4)


def test_no_items_no_documents(spark):
    docs = [(1, "a b c", 0, 0), (2, None, 0, 0)]
    same(spark, docs, [])
    same(spark, docs, [(1, "...", "")])
    same(spark, [], [(1, "a b", "")])


def test_a_map_of_any_size_hides_nothing(spark):
    from pyspark.sql import functions as F

    hashes = spark.range(3000).select(F.xxhash64("id").alias("shingle"))
    import numpy as np

    have = np.array([r[0] for r in hashes.collect()], np.int64).view(np.uint64)
    old = decontaminate.MAP_BITS
    for most in (old, 10):
        decontaminate.MAP_BITS = most
        try:
            m = decontaminate.Map(hashes)
        finally:
            decontaminate.MAP_BITS = old
        assert m.may_have(have).all() and m.may_have(have ^ np.uint64(0x5A5A5A5A5A5A5A5A)).mean() <= (0.01 if most == old else 1)
