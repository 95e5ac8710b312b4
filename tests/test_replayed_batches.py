"""A table that is replayed in batches: many files per batch, each batch whole and in order of time."""

from pyspark.sql import functions as F

from evidencelake.plans import streams
from evidencelake.plans.registry import Tables


def test_batches_are_many_files_and_stay_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    monkeypatch.setattr(streams, "_work", lambda t, name: f"{tmp_path}/work")
    rows = spark.range(3000).select(F.col("id"), (F.col("id") * 7919 % 3000).alias("at"))
    seen = []
    s = streams._in_batches(Tables(spark, str(tmp_path)), rows, "pieces", "at")
    s.writeStream.foreachBatch(lambda d, _: seen.append((d.count(), d.agg(F.min("at"), F.max("at")).first()))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sum(n for n, _ in seen) == 3000 and len(seen) == 3
    assert all(a[1][1] < b[1][0] for a, b in zip(seen, seen[1:], strict=False))
    assert [len(list((tmp_path / "work").glob(f"b{i}/*.parquet"))) for i in range(3)] in ([9] * 3, [10] * 3)
