"""Posting lists of the n-gram index take a few bytes an entry on their way, and several segments give what a scan gives."""

import random

import pyarrow as pa
from evidencelake.operators import gram_index as G
from evidencelake.operators import search as S
from pyspark.sql import functions as F


def texts(n):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    return [(f"e{i:04}", " ".join(word() for _ in range(40)), None, rnd.randrange(1 << 40)) for i in range(n)]


def test_a_posting_takes_few_bytes():
    rows = texts(2000)
    batch = pa.record_batch([pa.array(range(len(rows))), pa.array([r[3] for r in rows]), pa.array([r[1] for r in rows])], ["doc", "at", "folded"])
    made = list(G._segments(iter([batch])))
    entries = sum(len(set(G.grams_of(G._code_points(r[1])).tolist())) for r in rows)
    assert entries > 200_000 and sum(b.nbytes for b in made) < 4 * entries


def test_several_segments_equal_a_scan(spark, tmp_path):
    rows = texts(3000)
    evidence = spark.createDataFrame(rows, "evidence_id string, markdown string, meta_title string, created_at long").repartition(3).cache()
    for batch in (0, 1):
        G.append(evidence.where(F.col("created_at") % 2 == batch), str(tmp_path), batch)
    for query, limit in (("abc", 30), ("ab cd efg", 100), ("a", 10), ("abcdef", 30), ("nowhere", 30)):
        assert G.search(spark, str(tmp_path), query, limit).collect() == S.search(evidence, query, limit=limit).collect()
    evidence.unpersist()
