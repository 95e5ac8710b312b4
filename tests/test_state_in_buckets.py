"""Streams with state keep a row of state per bucket of keys, not per key, and give the same rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidencelake.streaming import jobs
from test_state_in_event_order import rocksdb, run  # noqa: F401

T0 = dt.datetime(2024, 1, 1)
N = 6000


@pytest.fixture
def ticks(spark, tmp_path):
    """(id, at) second by second: N ids in a first batch, one far later row in a second; null is an id too."""
    first = spark.range(N).select(F.when(F.col("id") > 0, F.col("id") + (1 << 55)).alias("id"), F.col("id").alias("n"), at_of("id").alias("at"))
    first.coalesce(1).write.parquet(f"{tmp_path}/in/b0")
    spark.range(1).select(F.lit(-5).cast("long").alias("id"), F.lit(10 * N).cast("long").alias("n"), at_of(F.lit(10 * N)).alias("at")).write.parquet(f"{tmp_path}/in/b1")
    return spark.readStream.schema("id long, n long, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def at_of(n):
    return F.timestamp_seconds(F.lit(1704067200) + (F.col(n) if isinstance(n, str) else n))


def test_stale_runs_of_many_keys(spark, tmp_path, ticks, rocksdb):  # noqa: F811
    u = ticks.select(F.col("id").alias("run_id"), F.when(F.col("n") % 3 == 0, "running").otherwise("done").alias("status"), F.col("at").alias("updated_at"))
    got, rows = run(jobs.stale_runs_stream(u, 600), tmp_path)
    want = [(None, "pending")] + [(n + (1 << 55), "pending") for n in range(3, N, 3)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < max(rows) <= 4 * (jobs.BUCKETS + 1) < N


def test_retries_of_many_keys(spark, tmp_path, ticks, rocksdb):  # noqa: F811
    a = ticks.select(F.col("id").alias("task_id"), (F.col("n") % 3 + 1).alias("attempt_no"), F.col("at").alias("attempt_at"), (F.col("n") % 2 == 0).alias("retryable"))
    got, rows = run(jobs.retries_stream(a), tmp_path)
    want = [(n + (1 << 55) if n else None, n % 3 + 2, T0 + dt.timedelta(seconds=n + 2 ** (n % 3))) for n in range(0, N, 2) if n % 3 < 2]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < max(rows) <= 4 * (jobs.BUCKETS + 1) < N
