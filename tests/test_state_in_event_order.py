"""Streams with state: late rows, ends, counts that follow changes, versions that read latest rows only; hot resources in pieces."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidencelake.operators.ledger import assign_versions, latest_assets
from evidencelake.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
VERSION = "resource_key string, asset_id string, sha256 string, fetched_at long"


def s(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def in_batches(spark, path, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, jobs.ROCKSDB)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def run(df, tmp_path):
    """Rows of a stream at its end, and how many rows of state are left."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/out").collect(), [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


def test_a_late_update_doesnt_reopen_a_run(spark, tmp_path, rocksdb):
    batches = [[(1, "done", s(100)), (2, "running", s(100))], [(1, "running", s(99)), (2, "running", s(90)), (3, "running", None)], [(1, "running", s(98)), (4, "success", s(5000))], [(5, "success", s(9000))], [(6, "success", s(9001))]]
    got, rows = run(jobs.stale_runs_stream(in_batches(spark, tmp_path / "in", "run_id long, status string, updated_at timestamp", batches), 600), tmp_path)
    assert [tuple(r) for r in got] == [(2, "pending")]
    assert max(rows) > 0 and rows[-1] <= 2  # a state and a timer of the newest run; the others are forgotten


def test_retries_are_forgotten(spark, tmp_path, rocksdb):
    a = in_batches(spark, tmp_path / "in", "task_id long, attempt_no long, attempt_at timestamp, retryable boolean", [[(i, 1, s(i), i % 2 == 0) for i in range(20)], [(0, 1, s(0), True), (99, 1, s(500), False)], [(100, 1, s(900), False)]])
    got, rows = run(jobs.retries_stream(a), tmp_path)
    assert sorted((r[0], r[1], r[2]) for r in got) == [(i, 2, s(i + 1)) for i in range(0, 20, 2)]
    assert max(rows) > 10 and rows[-1] <= 2


def test_finished_jobs_are_left_out_and_forgotten(spark, tmp_path, rocksdb):
    schema = "run_id long, seq long, state string, poll_count long, updated_at timestamp"
    batches = [
        [(1, 1, "running", 9, s(1)), (1, 2, "pending", 3, s(2)), (2, 1, "running", 4, s(1)), (2, 2, "done", 5, s(2)), (3, 1, "failed", None, s(3)), (4, 5, "running", 2, s(3))],
        [(2, 1, "running", 7, s(1)), (4, 4, "pending", 8, s(2)), (5, 1, "done", 1, s(4)), (5, 2, "running", None, s(5))],
        [(6, 1, "done", 1, s(100))],
        [(7, 1, "failed", 1, s(200))],
    ]
    jobs_ = jobs.job_states(in_batches(spark, tmp_path / "in", schema, batches))
    got = jobs.run_updates(jobs_, "run_id", f"{tmp_path}/o", f"{tmp_path}/c")
    assert sorted(tuple(r) for r in got.where("not ended").select("run_id", "state", "poll_count").collect()) == [(1, "pending", 9), (4, "running", 8), (5, "running", None)]
    assert sorted(r[0] for r in got.where("ended").collect()) == [2, 3, 6, 7]


def test_counts_follow_changes(spark, tmp_path, rocksdb):
    batches = [[(i, 1, "pending") for i in range(10)], [(i, 2, "success") for i in range(4)] + [(4, 0, "failed")], [(0, 3, "failed"), (11, 1, "pending"), (1, 2, "success")]]
    d = jobs.status_deltas(in_batches(spark, tmp_path / "in", "task_id long, seq long, status string", batches))
    got = jobs.run_status_counts(d, f"{tmp_path}/o", f"{tmp_path}/c")
    assert {r["status"]: r["n"] for r in got.collect()} == {"pending": 7, "success": 3, "failed": 1}


def test_a_hot_resource_in_pieces_equals_one_window(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else f"r{i % 11}", f"a{i}", rnd.choice("xyz"), rnd.randint(0, 300)) for i in range(900)] + [(None, "n1", "x", 5), (None, "n2", None, 500), ("late", "l", "x", None)]
    new, old = spark.createDataFrame(rows[:500] + rows[900:], VERSION).repartition(4), None
    for part in (new, spark.createDataFrame(rows[500:900], VERSION)):
        whole = sorted(map(str, assign_versions(part, old).collect()))
        for size in (7, 100):
            pieces = assign_versions(part, old, size)
            assert pieces.columns == [*new.columns, "version_no", "previous_asset_id", "changed_from_previous"] and sorted(map(str, pieces.collect())) == whole
        old = latest_assets(assign_versions(part, old)) if old is None else old
    from evidencelake.operators import ledger

    hot = spark.createDataFrame(rows, VERSION).where("resource_key = 'hot'")
    sizes = [r["count"] for r in hot.groupBy(ledger._pieces(hot, "fetched_at", 50)).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 100


def test_versions_read_latest_rows_only_and_replay(spark, tmp_path):
    path = f"{tmp_path}/out"
    batches = [[(f"r{k}", f"b{i}-{k}", str((i + k) % 3), i) for k in range(40)] for i in range(4)]
    got = jobs.version_stream(in_batches(spark, tmp_path / "in", VERSION, batches), path, f"{tmp_path}/ck", 8)
    whole = assign_versions(spark.createDataFrame([r for b in batches for r in b], VERSION))
    want = sorted(map(str, whole.collect()))
    assert sorted(map(str, got.select(whole.columns).collect())) == want
    assert spark.read.parquet(f"{path}/latest").groupBy("batch").count().orderBy("batch").collect()[-1]["count"] == 40  # what a next batch reads: a row per resource
    assert all(len(b) == 2 for b in jobs._batches_of(spark, f"{path}/latest").values())
    # The last batch again: as after a crash before its commit.
    import glob
    import os

    for f in glob.glob(f"{tmp_path}/ck/commits/3*") + glob.glob(f"{tmp_path}/ck/commits/.3*"):
        os.remove(f)
    again = jobs.version_stream(spark.readStream.schema(VERSION).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), path, f"{tmp_path}/ck", 8)
    assert sorted(map(str, again.select(whole.columns).collect())) == want
