"""Places within a key: ranges that cut a hot key, null keys, ties, other columns; and the folder that clean() removes."""

import os

from pyspark.sql import functions as F

from evidencelake import tables
from evidencelake.operators.ordered import numbered


def test_places_equal_a_sort(spark):
    rows = [("hot", i % 50, f"v{i}") for i in range(900)] + [(None, i, "n") for i in range(30)] + [(f"k{i % 7}", -i, None) for i in range(60)]
    got = numbered(spark.createDataFrame(rows, "k string, o int, _key string").repartition(6), "k", [F.col("o")], "place")
    assert got.columns == ["k", "o", "_key", "place"] and got.count() == len(rows)
    by = {}
    for r in got.collect():
        by.setdefault(r["k"], []).append((r["place"], r["o"]))
    for k, found in by.items():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert [o for _, o in sorted(found)] == sorted(r[1] for r in rows if r[0] == k)
    assert numbered(spark.createDataFrame([], "k string, o int"), "k", [F.col("o")], "place").collect() == []


def test_clean_removes_the_tables_of_an_application(spark):
    root = f"{tables.shared_dir(spark)}/evidencelake"
    t = tables.materialize(spark.range(5).toDF("a"), "some")
    assert t.count() == 5 and t.inputFiles()[0].split("/")[-3] == spark.sparkContext.applicationId
    spark.range(3).write.parquet(f"{root}/other-application/table-1")
    tables.clean(spark, "other-application")
    assert not os.path.exists(f"{root}/other-application") and t.count() == 5
    file = t.inputFiles()[0].removeprefix("file://")
    tables.drop_materialized(t)
    assert not os.path.exists(file)
