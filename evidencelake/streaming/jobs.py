"""Structured Streaming jobs: ingestion, versions, dedupe, stale runs, retries, folded states, live counts.

Replays are safe: ids are hashes of what they name, sinks drop what they already have, state is kept per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evidencelake.functions.identity import backoff_seconds
from evidencelake.operators.ledger import assign_versions, latest_assets, upsert_latest
from evidencelake.tables import delete_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSION_SCHEMA = "resource_key string, asset_id string, sha256 string, fetched_at long, version_no int, previous_asset_id string, changed_from_previous boolean"


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Write a stream to Parquet until what is there now is done, and read the result."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest_stream(outbox: DataFrame, assets: DataFrame, converter: Callable[[DataFrame], DataFrame], fingerprint: str, evidence_path: str, checkpoint: str) -> StreamingQuery:
    """Evidence for each raw_asset.created event whose asset has none yet for this fingerprint; failures stay rows with an error_code.

    outbox (event_id, event_type, aggregate_id); assets (asset_id, ...); converter: assets -> (asset_id, markdown, error_code). The
    evidence has a folder per fingerprint; a batch looks for its assets in this fingerprint's ids alone.
    """
    own = f"{evidence_path}/pipeline_fingerprint={fingerprint}"

    def batch(events: DataFrame, _: int) -> None:
        spark = events.sparkSession
        wanted = events.where("event_type = 'raw_asset.created'").select(F.col("aggregate_id").alias("asset_id")).distinct()
        new = assets.join(wanted, "asset_id", "left_semi")
        try:
            new = new.join(spark.read.parquet(own).select("asset_id").join(wanted, "asset_id", "left_semi"), "asset_id", "left_anti")
        except AnalysisException as e:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        converter(new).write.mode("append").parquet(own)

    return outbox.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches_of(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """The batches that each bucket of a bucketed table was written in, from the names of its folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/bucket=*/batch=*")
    found: dict[int, list[int]] = {}
    for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []:
        bucket, batch = (int(x.split("=")[1]) for x in str(s.getPath().toString()).split("/")[-2:])
        found.setdefault(bucket, []).append(batch)
    return found


def version_stream(captures: DataFrame, path: str, checkpoint: str, buckets: int = 256) -> DataFrame:
    """Next version per resource as captures (resource_key, asset_id, sha256, fetched_at) arrive. A late one takes the next number.

    The latest row of every resource is a table of hash buckets beside the output. A batch reads the buckets of its resources as they
    were before it, versions its rows (in pieces of time, so that no resource is one task), and writes those buckets anew: what it
    reads grows with the resources it touches, not with the history. Output and buckets are in folders of the batch's number, which a
    replay overwrites; of each bucket the state before this batch is kept for that, older ones are removed.
    """
    spark = captures.sparkSession
    root, bucket = f"{path}/latest", F.pmod(F.xxhash64("resource_key"), F.lit(buckets)).cast("int")
    columns = ["resource_key", "asset_id", "sha256", "version_no"]

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # as many as there are buckets, at most
        if not touched:
            return
        before = {b: max((x for x in seen if x < number), default=None) for b, seen in _batches_of(own, root).items()}
        paths = [f"{root}/bucket={b}/batch={n}" for b, n in before.items() if b in touched and n is not None]
        schema = ", ".join(f"{c} {'int' if c == 'version_no' else 'string'}" for c in columns)
        latest = own.read.schema(schema).parquet(*paths) if paths else own.createDataFrame([], schema)
        assign_versions(rows, latest).write.mode("overwrite").parquet(f"{path}/versions/batch={number}")
        now = own.read.schema(VERSION_SCHEMA).parquet(f"{path}/versions/batch={number}").select(columns)
        merged = latest_assets(latest.unionByName(now)).withColumns({"bucket": bucket, "batch": F.lit(number)})
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(root)
        for b, seen in _batches_of(own, root).items():
            for n in seen:
                if b in touched and n < number and n != before.get(b):
                    delete_path(own, f"{root}/bucket={b}/batch={n}")

    captures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(VERSION_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/versions")


def dedupe_stream(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each event once, as long as repeats come within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


#: Bits of the filter of a ledger bucket, and its largest size therefore: 128 KB as words.
FILTER_BITS = 20


def _filter_slots(key: Column) -> Column:
    """Two places in its bucket's filter for each id."""
    return F.array(*(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << FILTER_BITS)) for salt in (1, 2)))


def dedupe_with_ledger(events: DataFrame, key: str, time: str, delay: str, path: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Each event once for good, with state for the delay only: near repeats end in the stream's state, old ones at the ledger of ids.

    The ledger is a table of hash buckets, each with a filter of 2^FILTER_BITS bits that never grows. A batch reads the filters of its
    buckets; only ids that a filter doesn't rule out are looked up in the ledger itself. Everything a batch writes is below its number
    and is read by later batches only, so a replay gives the same rows. Rows with null keys are dropped.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    filters, ledger = f"{path}/filters", f"{path}/ledger"

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        rows = rows.where(F.col(key).isNotNull()).withColumn("bucket", bucket)
        asked = rows.select("bucket", F.col(key).alias("_key")).distinct()
        before = {b: max((x for x in seen if x < number), default=None) for b, seen in _batches_of(own, filters).items()}
        paths = [f"{filters}/bucket={b}/batch={n}" for b, n in before.items() if n is not None]
        words = own.read.option("basePath", filters).schema("word_at long, bits long, bucket int, batch long").parquet(*paths).drop("batch") if paths else own.createDataFrame([], "word_at long, bits long, bucket int")
        slots = asked.withColumn("slot", F.explode(_filter_slots(F.col("_key")))).withColumn("word_at", F.expr("slot div 32"))
        set_ = slots.join(words, ["bucket", "word_at"]).where(F.expr("bits & shiftleft(1L, cast(slot % 32 AS int))") != 0)
        maybe = set_.groupBy("bucket", "_key").agg(F.count("*").alias("n")).where(F.col("n") == 2).select("bucket", "_key")
        if paths:
            known = own.read.option("basePath", ledger).schema(f"{key} string, batch long, bucket int").parquet(ledger).where(F.col("batch") < number)
            seen = maybe.join(known.select("bucket", F.col(key).alias("_key")), ["bucket", "_key"], "left_semi")
            rows = rows.join(seen.withColumnRenamed("_key", key), ["bucket", key], "left_anti")
        rows.drop("bucket").write.mode("overwrite").parquet(f"{path}/events/batch={number}")
        new = own.read.parquet(f"{path}/events/batch={number}").select(F.col(key).cast("string").alias(key)).withColumn("bucket", bucket)
        new.withColumn("batch", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(ledger)
        added = new.select("bucket", F.explode(_filter_slots(F.col(key))).alias("slot")).select("bucket", F.expr("slot div 32").alias("word_at"), F.expr("shiftleft(1L, cast(slot % 32 AS int))").alias("bits"))
        touched = new.select("bucket").distinct()
        merged = added.unionByName(words.join(F.broadcast(touched), "bucket").select("bucket", "word_at", "bits")).groupBy("bucket", "word_at").agg(F.bit_or("bits").alias("bits"))  # a row per bucket
        merged.withColumn("batch", F.lit(number)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(filters)
        for b, old in _batches_of(own, filters).items():
            for n in old:
                if n < number and n != before.get(b) and (newest := max(x for x in old if x <= number)) != n and newest == number:
                    delete_path(own, f"{filters}/bucket={b}/batch={n}")

    near = events.withColumn(key, F.col(key).cast("string"))
    dedupe_stream(near, key, time, delay).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return events.sparkSession.read.schema(near.schema).option("recursiveFileLookup", "true").parquet(f"{path}/events")


def stale_runs(runs: DataFrame, now: object, timeout_seconds: int) -> DataFrame:
    """Batch form: running rows without an update for the timeout go back to pending."""
    stale = (F.col("status") == "running") & (F.col("updated_at") <= F.lit(now) - F.make_dt_interval(secs=F.lit(timeout_seconds)))
    return runs.withColumn("status", F.when(stale, "pending").otherwise(F.col("status")))


#: Hash buckets of the keys of a stream with state. A bucket is one state, so that a batch costs calls per bucket and not per key.
BUCKETS = 1024


def _bucket(key: str, buckets: int = BUCKETS) -> Column:
    """The hash bucket of a key; -1, a bucket of its own, for null."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int").alias("bucket")


def _newest(frames: Iterable[pd.DataFrame], key: str, by: str) -> pd.DataFrame | None:
    """The row of each key with the largest value of `by`, one frame at a time; the later of equal ones."""
    best = None
    for frame in frames:
        both = frame if best is None else pd.concat([best, frame[best.columns]])
        best = both.sort_values(by, kind="stable").drop_duplicates(key, keep="last")
    return best


class _Bucket(StatefulProcessor):
    """The rows of a bucket's keys as one value of state, which is read and written once per batch, and one timer: the next that is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("rows", "rows binary")

    def kept(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(bytes(self.state.get()[0])).read_pandas() if self.state.exists() else None

    def keep(self, frame: pd.DataFrame) -> None:
        if len(frame) == 0:
            self.state.clear()
            return
        table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))

    def only_timer(self, at_ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            if t != at_ms:
                self.handle.deleteTimer(t)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def expired(self, due_ms: Callable[[pd.DataFrame], pd.Series], clock_ms: int) -> pd.DataFrame | None:
        """The rows whose time the clock has reached; the others stay, with a timer for the next of them."""
        frame = self.kept()
        if frame is None:
            return None
        due = due_ms(frame)
        rest = due > clock_ms
        self.keep(frame[rest])
        if rest.any():
            self.handle.registerTimer(int(due[rest].min()))
        return frame[~rest]


def _ids(ids: pd.Series, bucket: int) -> object:
    return pd.array([None] * len(ids) if bucket == -1 else ids.to_numpy(), "Int64")


class _Stale(_Bucket):
    """Each run's newest status and its time. Older rows change nothing; a run that doesn't run ends as the clock reaches its row,
    from when on Spark itself drops older ones."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def due(self, frame: pd.DataFrame) -> pd.Series:
        return frame["at_us"] // 1000 + np.where(frame["running"], self.timeout_ms, 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        old = self.kept()
        new = _newest(chain([] if old is None else [old], (r[["run_id", "running", "at_us"]] for r in rows)), "run_id", "at_us")
        self.keep(new)
        self.only_timer(int(self.due(new).min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        over = self.expired(self.due, timerValues.getCurrentWatermarkInMs())
        if over is not None and over["running"].any():
            ids = over["run_id"][over["running"]]
            yield pd.DataFrame({"run_id": _ids(ids, key[0]), "status": "pending"})


def stale_runs_stream(updates: DataFrame, timeout_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(run_id, status) of running runs that the event clock has passed by; updates: run_id, status, updated_at, in any order within the delay.

    State ends: a run that is given back, or that has another status than running, is forgotten once the clock has passed its row.
    """
    running = F.coalesce(F.col("status") == "running", F.lit(False)).alias("running")
    u = updates.withWatermark("updated_at", delay).where("updated_at is not null").select(_bucket("run_id"), F.coalesce(F.col("run_id").cast("long"), F.lit(0)).alias("run_id"), running, "updated_at", F.unix_micros("updated_at").alias("at_us"))
    return u.groupBy("bucket").transformWithStateInPandas(_Stale(timeout_seconds * 1000), "run_id long, status string", "append", "eventTime")


def retries(attempts: DataFrame, most: int = 3) -> DataFrame:
    """When each retryable failure is due again: attempts (task_id, attempt_no, attempt_at, retryable). Narrow, so it serves batch and stream."""
    due = F.col("attempt_at") + F.make_dt_interval(secs=backoff_seconds(F.col("attempt_no")))
    return attempts.where(F.col("retryable") & (F.col("attempt_no") < most)).select("task_id", (F.col("attempt_no") + 1).alias("attempt_no"), due.alias("due_at"))


#: Stands for the time of an attempt after which nothing is due.
NEVER = -1 << 62


class _Due(_Bucket):
    """Each task's newest attempt: when it is due again, or, if it isn't, when its time has passed. Then it is forgotten."""

    @staticmethod
    def due(frame: pd.DataFrame) -> pd.Series:
        return (frame["at_us"] // 1000 + 1).where(frame["due_us"] == NEVER, frame["due_us"] // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        old, new = self.kept(), _newest((r[["task_id", "attempt_no", "due_us", "at_us"]] for r in rows), "task_id", "attempt_no")
        new = new if old is None else _newest([new, old], "task_id", "attempt_no")  # the attempt that is known already stands before an equal one
        self.keep(new)
        self.only_timer(int(self.due(new).min()))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        over = self.expired(self.due, timerValues.getCurrentWatermarkInMs())
        if over is not None and len(over := over[over["due_us"] != NEVER]):
            yield pd.DataFrame({"task_id": _ids(over["task_id"], key[0]), "attempt_no": over["attempt_no"].to_numpy() + 1, "due_us": over["due_us"].to_numpy()})


def retries_stream(attempts: DataFrame, most: int = 3, delay: str = "0 seconds") -> DataFrame:
    """(task_id, attempt_no, due_at) as the event clock passes the time at which a failure is due again.

    A newer attempt of the task replaces the timer of an older one; one that is final (not retryable, or the last) removes it.
    attempts: task_id, attempt_no, attempt_at, retryable.
    """
    again = F.col("retryable") & (F.col("attempt_no") < most)
    due = F.when(again, F.col("attempt_at") + F.make_dt_interval(secs=backoff_seconds(F.col("attempt_no"))))
    a = attempts.withWatermark("attempt_at", delay).where("attempt_no is not null and attempt_at is not null")
    a = a.select(_bucket("task_id"), F.coalesce(F.col("task_id").cast("long"), F.lit(0)).alias("task_id"), F.col("attempt_no").cast("long").alias("attempt_no"), "attempt_at", F.coalesce(F.unix_micros(due), F.lit(NEVER)).alias("due_us"), F.unix_micros("attempt_at").alias("at_us"))
    out = a.groupBy("bucket").transformWithStateInPandas(_Due(), "task_id long, attempt_no long, due_us long", "append", "eventTime")
    return out.select("task_id", "attempt_no", F.timestamp_micros("due_us").alias("due_at"))


#: States from which a job doesn't go on.
ENDED = ("done", "failed")


#: Stands for a number that isn't known.
UNKNOWN = -(1 << 63)


class _Job(_Bucket):
    """The folds of a bucket's jobs: the newest update decides the state, poll_count never falls. With an end a fold starts anew: the end
    is kept until the clock has passed it, so that older updates don't bring the job back, and then forgotten."""

    columns = ("run_id", "seq", "state", "polls", "ended", "clear_ms")

    @staticmethod
    def due(frame: pd.DataFrame) -> pd.Series:
        return frame["clear_ms"]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        old = self.kept()
        old = pd.DataFrame({c: pd.Series([], dtype=object if c == "state" else "int64") for c in self.columns}) if old is None else old
        new = pd.concat([r[["run_id", "seq", "state", "polls", "at_us"]] for r in rows], ignore_index=True)  # a bucket's updates of one batch
        ids = np.unique(np.concatenate([old["run_id"], new["run_id"]]))
        at, job = np.searchsorted(ids, old["run_id"]), np.searchsorted(ids, new["run_id"])

        def known(column: str, default: object) -> np.ndarray:
            out = np.full(len(ids), default, object if column == "state" else np.int64)
            out[at] = old[column].to_numpy()
            return out

        seq, state, polls, ended, clear = known("seq", -1), known("state", None), known("polls", UNKNOWN), known("ended", -1), known("clear_ms", -NEVER)
        later = new["seq"].to_numpy() > ended[job]
        new, job = new[later].reset_index(drop=True), job[later]
        n, over = new["seq"].to_numpy(), new["state"].isin(ENDED).to_numpy()
        before = ended.copy()
        np.maximum.at(ended, job[over], n[over])
        anew = (ended > before) & (seq < ended)
        seq[anew], state[anew], polls[anew] = -1, None, UNKNOWN
        counted = n > ended[job]
        np.maximum.at(polls, job[counted], new["polls"].to_numpy()[counted])
        order = np.lexsort((n, job))  # stable: the later of equal ones is last
        last = order[np.flatnonzero(np.diff(job[order], append=-1))]
        last = last[n[last] > seq[job[last]]]
        seq[job[last]], state[job[last]] = n[last], new["state"].to_numpy()[last]
        changed = np.zeros(len(ids), bool)
        changed[job] = True
        done, newest = seq == ended, np.full(len(ids), UNKNOWN)
        np.maximum.at(newest, job, new["at_us"].to_numpy())
        clear[changed] = np.where(done, newest // 1000 + 1, -NEVER)[changed]
        self.keep(pd.DataFrame(dict(zip(self.columns, (ids, seq, state, polls, ended, clear), strict=True))))
        self.only_timer(int(clear.min()) if len(clear) and clear.min() < -NEVER else None)
        if changed.any():
            made = pd.DataFrame({"run_id": _ids(pd.Series(ids), key[0]), "seq": seq, "state": state, "poll_count": pd.array(polls, "Int64"), "ended": done})
            made.loc[polls == UNKNOWN, "poll_count"] = pd.NA
            yield made[changed]

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        self.expired(self.due, timerValues.getCurrentWatermarkInMs())
        return iter(())


def job_states(updates: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(run_id, seq, state, poll_count, ended) of each job whose fold changes; updates: run_id, seq, state, poll_count, updated_at.

    The last row of a job is its present fold; jobs whose last row has ended are over and not among those to resume.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(UNKNOWN))
    u = updates.withWatermark("updated_at", delay).where("seq is not null")
    u = u.select(_bucket("run_id"), F.coalesce(F.col("run_id").cast("long"), F.lit(0)).alias("run_id"), F.col("seq").cast("long").alias("seq"), "state", number("poll_count").alias("polls"), "updated_at", F.coalesce(F.unix_micros("updated_at"), F.lit(UNKNOWN)).alias("at_us"))
    return u.groupBy("bucket").transformWithStateInPandas(_Job(), "run_id long, seq long, state string, poll_count long, ended boolean", "append", "eventTime")


class _Present(_Bucket):
    """The present statuses of a bucket's tasks; a change is one task less in the old and one more in the new."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        old, new = self.kept(), _newest((r[["task_id", "seq", "status"]] for r in rows), "task_id", "seq")
        now = new if old is None else _newest([old, new], "task_id", "seq")
        self.keep(now)
        # Of every task that came or changed its status: one row before (if any), one after.
        counts = now["status"].value_counts(dropna=False) if old is None else now["status"].value_counts(dropna=False).sub(old["status"].value_counts(dropna=False), fill_value=0)
        counts = counts[counts != 0].astype("int64")
        if len(counts):
            yield pd.DataFrame({"status": counts.index.to_series().where(counts.index.notna(), None).to_numpy(object), "delta": counts.to_numpy()})


def status_deltas(updates: DataFrame) -> DataFrame:
    """(status, delta) as tasks come and change; updates: task_id, seq, status, in any order. A small row of state per task stays."""
    u = updates.where("seq is not null").select(_bucket("task_id"), F.coalesce("task_id", F.lit(0).cast(updates.schema["task_id"].dataType)).alias("task_id"), F.col("seq").cast("long").alias("seq"), "status")
    return u.groupBy("bucket").transformWithStateInPandas(_Present(), "status string, delta long", "append", "none")


def run_status_counts(deltas: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """(status, n): tasks by present status. Each batch adds its deltas to the counts of the batch before, a row per status."""

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        totals = rows.groupBy("status").agg(F.sum("delta").alias("n"))
        if number > 0:
            totals = totals.unionByName(own.read.parquet(f"{path}/batch={number - 1}").select("status", "n")).groupBy("status").agg(F.sum("n").alias("n"))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    deltas.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return deltas.sparkSession.read.schema("status string, n long").parquet(f"{path}/batch={_last_batch(deltas.sparkSession, path)}").where("n <> 0")


def _last_batch(spark: SparkSession, path: str) -> int:
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    return max(int(str(s.getPath().getName()).split("=")[1]) for s in glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob))


def run_updates(df: DataFrame, key: str, path: str, checkpoint: str) -> DataFrame:
    """A stream's changed rows of every batch go to Parquet, below its number; the last batch's row of each key is its present state."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log = df.sparkSession.read.option("basePath", path).parquet(path)
    return upsert_latest(log, key, "_batch").drop("_batch")
