"""Every query has k rows, or all candidates where there are fewer, at the recall of production."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import neighbours

SF = "/root/testdata/sf0.1"


def check(spark, vectors, asked):
    got = neighbours.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), spark.createDataFrame([v for v in vectors if v[0] in asked], "vec_id long, embedding array<double>")).collect()
    lines = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lines.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in asked:
        near = []
        for _, x in (v for v in vectors if v[0] == q):
            near += [(-round(float(neighbours.cosine(np.array([x]), np.array([y]))[0, 0]), 12), i) for i, y in vectors if i != q]
        yield q, lines.get(q, []), [i for _, i in sorted(near)][:5]


def test_small_tables_give_all_candidates(spark):
    for n, seed in ((2, 13), (4, 55), (6, 55)):  # with these seeds the visited buckets miss some
        rng = np.random.default_rng(seed)
        vectors = [(i, rng.standard_normal(8).tolist()) for i in range(n)]
        for _, mine, want in check(spark, vectors, range(n)):
            assert mine == list(enumerate(want, 1)) and len(mine) == n - 1


def test_outliers_beside_a_tight_cluster(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    vectors = [(i, (centre + 0.001 * rng.standard_normal(16)).tolist()) for i in range(300)] + [(300, (-centre).tolist())]
    for q, mine, want in check(spark, vectors, [0, 300]):
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5]
        assert q == 0 or [i for _, i in mine] == want  # its buckets hold nothing else: the scan is exact


def test_long_vectors_repeats_and_hot_cells(spark, monkeypatch):
    """Vectors of 3,000 components, many equal ones, and groups that are split into parts by rows and by visits."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 40)
    monkeypatch.setattr(neighbours, "GROUP_VISITS", 15)
    rng = np.random.default_rng(5)
    long = [(i, rng.standard_normal(3000).tolist()) for i in range(60)]
    centre = rng.standard_normal(16)
    tight = [(i, (centre + 0.05 * rng.standard_normal(16)).tolist()) for i in range(300)] + [(300 + i, centre.tolist()) for i in range(40)]
    for vectors in (long, tight):
        asked = [v[0] for v in vectors if v[0] % 5 == 0]
        found = [(len(set(want) & {i for _, i in mine}), len(want), [r for r, _ in mine]) for _, mine, want in check(spark, vectors, asked)]
        assert all(ranks == [1, 2, 3, 4, 5] for *_, ranks in found)
        assert sum(a for a, *_ in found) >= 0.85 * sum(b for _, b, _ in found)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the tables")
def test_the_index_compares_a_part_of_the_rows(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    entries = neighbours.materialize(neighbours.distinct_vectors(vectors, 6, "float"), "vectors")
    n = entries.count()
    asked = neighbours.distinct_vectors(vectors.where("vec_id % 50 = 0"), 1, "float").select("entry", "embedding")
    found = neighbours.probe(entries, asked, neighbours.fit(entries, n, 64, 5), 64, 6)
    scored, queries = found.agg(F.sum("scored"), F.count_distinct("q")).first()
    assert scored < 0.5 * n * queries
