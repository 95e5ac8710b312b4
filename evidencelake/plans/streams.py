"""Stream queries: replayed to their end with availableNow, each with the SQL of the batch result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.operators.convert import convert
from evidencelake.plans.ledger import VERSIONS
from evidencelake.plans.pages import H13, typed_gates, written
from evidencelake.plans.registry import Tables, query
from evidencelake.plans.reports import TASKS
from evidencelake.streaming import jobs as J
from evidencelake.tables import materialize


def _work(t: Tables, name: str) -> str:
    """A folder that all executors share: below spark.checkpoint.dir, or below the warehouse where that is unset."""
    base = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = t.spark.conf.get("spark.sql.warehouse.dir")
        if base.split(":")[0] in (base, "file") and not t.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base += "/_streams"
    return f"{base.rstrip('/')}/evidencelake/{name}-{uuid.uuid4().hex}"


def _stream(t: Tables, name: str) -> DataFrame:
    """A table as a file stream; times without zone become instants in UTC."""
    batch = getattr(t, name)
    s = t.spark.readStream.schema(batch.schema).parquet(f"{t.sf_dir}/{name}.parque[t]")  # a pattern, as a stream takes a single file only by one; a folder fits too
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in batch.schema if f.dataType.typeName() == "timestamp_ntz"})


#: Rows of a file of a batch, about; no batch is one task therefore.
FILE_ROWS = 100_000


def _in_batches(t: Tables, rows: DataFrame, name: str, time: str, batches: int = 3) -> DataFrame:
    """A table as a stream of several batches, in order of time; all have the same number of files, so that a trigger takes one whole."""
    folder, rows = _work(t, name), materialize(rows, name)
    bounds = rows.agg(F.percentile_approx(time, [i / batches for i in range(1, batches)])).first()[0] or []
    piece = F.array_size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < F.col(time)))
    sizes = dict(tuple(r) for r in rows.groupBy(piece).count().collect()) or {0: 0}  # a row per batch that isn't empty
    files = max(1, min(sizes.values()) // FILE_ROWS)
    for i in sorted(sizes):
        rows.where(piece == i).repartition(files).write.parquet(f"{folder}/b{i}")
        made = len(t.spark.read.schema(rows.schema).parquet(f"{folder}/b{i}").inputFiles())
        if made != files:
            raise RuntimeError(f"batch {i} of {name} has {made} files, not {files}")
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)


@contextmanager
def _rocksdb(t: Tables) -> Iterator[None]:
    """State in RocksDB for the streams that run inside; the session's own setting comes back after them."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key, None)
    t.spark.conf.set(key, J.ROCKSDB)
    try:
        yield
    finally:
        t.spark.conf.set(key, before) if before else t.spark.conf.unset(key)


@query(f"SELECT page_id AS asset_id, markdown, error_code, 'fp1' AS pipeline_fingerprint FROM ({H13})")
def r1_ingest_stream(t: Tables) -> DataFrame:
    """Every page's event, converted. Run twice: the second run finds nothing new."""
    work = _work(t, "ingest")
    outbox = _stream(t, "pages").select(F.sha2(F.col("page_id").cast("string"), 256).alias("event_id"), F.lit("raw_asset.created").alias("event_type"), F.col("page_id").alias("aggregate_id"))
    assets = typed_gates(t).withColumnRenamed("page_id", "asset_id")
    pages = lambda a: convert(a.withColumnRenamed("asset_id", "page_id")).select(F.col("page_id").alias("asset_id"), written(F.col("markdown")).alias("markdown"), "error_code")
    for i in (1, 2):
        J.ingest_stream(outbox, assets, pages, "fp1", f"{work}/evidence", f"{work}/checkpoint{i}").awaitTermination()
    return t.spark.read.parquet(f"{work}/evidence")


@query(VERSIONS)
def r2_version_stream(t: Tables) -> DataFrame:
    """Three batches in order of time, each following on the latest rows of its resources."""
    captures = t.documents.select(F.col("source").alias("resource_key"), F.col("doc_id").cast("string").alias("asset_id"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") * 60).alias("fetched_at"))
    work = _work(t, "versions")
    return J.version_stream(_in_batches(t, captures, "captures", "fetched_at"), f"{work}/out", f"{work}/checkpoint")


@query("SELECT DISTINCT user_id || ':' || event_type AS event_id FROM events")
def r3_dedupe_stream(t: Tables) -> DataFrame:
    e = _stream(t, "events").select(F.concat_ws(":", "user_id", "event_type").alias("event_id"), "ts")
    work = _work(t, "dedupe")
    with _rocksdb(t):
        return J.run_once(J.dedupe_stream(e, "event_id", "ts", "3650 days"), f"{work}/out", f"{work}/checkpoint").select("event_id")


@query("SELECT DISTINCT user_id || ':' || event_type AS event_id FROM events")
def r3_dedupe_with_ledger(t: Tables) -> DataFrame:
    """As above over several batches, with state for a minute: repeats that come later are found in the ledger."""
    e = t.events.select(F.concat_ws(":", "user_id", "event_type").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    work = _work(t, "ledger")
    with _rocksdb(t):
        return J.dedupe_with_ledger(_in_batches(t, e, "repeats", "ts"), "event_id", "ts", "1 minute", f"{work}/out", f"{work}/checkpoint").select("event_id")


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY THEN 'pending' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'F' THEN 'success' ELSE 'pending' END AS status FROM orders")
def r4_stale_runs(t: Tables) -> DataFrame:
    import datetime

    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "success").otherwise("pending")
    runs = t.orders.select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))
    now = datetime.datetime(1998, 1, 1)  # noqa: DTZ001
    return J.stale_runs(runs.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")), now, 30 * 86400).select("run_id", "status")


@query("SELECT event_id AS task_id, (event_id % 4 + 2)::BIGINT AS attempt_no, ts + to_seconds(least(pow(2, event_id % 4), 4)::INTEGER) AS due_at FROM events WHERE event_type IN ('click','purchase','error') AND event_id % 4 + 1 < 3")
def r5_retries(t: Tables) -> DataFrame:
    a = t.events.select(F.col("event_id").alias("task_id"), (F.col("event_id") % 4 + 1).alias("attempt_no"), F.col("ts").alias("attempt_at"), F.col("event_type").isin("click", "purchase", "error").alias("retryable"))
    return J.retries(a)


@query("SELECT task_id, attempt_no, due_at FROM (SELECT event_id AS task_id, (event_id % 4 + 2)::BIGINT AS attempt_no, ts + to_seconds(least(pow(2, event_id % 4), 4)::INTEGER) AS due_at FROM events WHERE event_type IN ('click','purchase','error') AND event_id % 4 + 1 < 3) WHERE epoch_ms(due_at) <= (SELECT max(epoch_ms(ts)) FROM events)")
def r5_retries_stream(t: Tables) -> DataFrame:
    """Retries by timers: those whose time the event clock has reached at the stream's end."""
    a = _stream(t, "events").select(F.col("event_id").alias("task_id"), (F.col("event_id") % 4 + 1).alias("attempt_no"), F.col("ts").alias("attempt_at"), F.col("event_type").isin("click", "purchase", "error").alias("retryable"))
    work = _work(t, "retries")
    with _rocksdb(t):
        return J.run_once(J.retries_stream(a), f"{work}/out", f"{work}/checkpoint").withColumn("due_at", F.col("due_at").cast("timestamp_ntz"))


_STATE = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'pending' END"


@query(f"""WITH e AS (SELECT user_id AS run_id, event_id AS seq, {_STATE} AS state, event_id % 17 AS poll_count FROM events),
 o AS (SELECT *, coalesce(max(seq) FILTER (state IN ('done', 'failed')) OVER (PARTITION BY run_id), -1) AS ended FROM e)
 SELECT run_id, arg_max(state, seq) AS state, max(poll_count) AS poll_count FROM o WHERE seq > ended GROUP BY run_id""")
def r6_job_state_stream(t: Tables) -> DataFrame:
    """Jobs to resume: folds since a job last ended; those that are over are left out."""
    e = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.expr(_STATE).alias("state"), (F.col("event_id") % 17).alias("poll_count"), F.col("ts").cast("timestamp").alias("updated_at"))
    work = _work(t, "states")
    with _rocksdb(t):
        return J.run_updates(J.job_states(_in_batches(t, e, "updates", "updated_at")), "run_id", f"{work}/out", f"{work}/checkpoint").where("not ended").select("run_id", "state", "poll_count")


@query(f"SELECT status, count(*) AS n FROM (SELECT user_id, arg_max(status, task_id) AS status FROM (SELECT t.*, user_id FROM ({TASKS}) t JOIN events ON event_id = task_id) GROUP BY user_id) GROUP BY status")
def r7_status_counts_stream(t: Tables) -> DataFrame:
    """Tasks by their present status, over batches in which tasks change it."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "success").when(kind == "click", "failed").when(kind == "signup", "blocked").when(kind == "purchase", "partial").otherwise("pending")
    e = t.events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    work = _work(t, "counts")
    with _rocksdb(t):
        return J.run_status_counts(J.status_deltas(_in_batches(t, e, "changes", "ts")), f"{work}/out", f"{work}/checkpoint")
