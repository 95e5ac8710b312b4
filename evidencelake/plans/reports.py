"""Queries of the reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.operators import reports as R
from evidencelake.plans.registry import Tables, query

TASKS = """SELECT event_id AS task_id, ts AS created_at, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'failed' WHEN 'signup' THEN 'blocked' WHEN 'purchase' THEN 'partial' ELSE 'pending' END AS status, CASE event_type WHEN 'click' THEN 'HTTP_403' WHEN 'signup' THEN 'HTTP_404' WHEN 'error' THEN 'HTTP_5XX' END AS error_code,
 CASE WHEN event_id % 5 = 0 THEN 'nowhere' ELSE concat('https://h', CAST(user_id % 40 AS STRING), '.example.com/p/', CAST(event_id AS STRING)) END AS url, event_id % 1000 AS staged_bytes FROM {events}"""
ASSETS = "SELECT event_id AS task_id, ts AS fetched_at, event_id * 3 AS size_bytes, 'success' AS status FROM {events} WHERE event_type = 'view'"
_DOMAIN = "CASE WHEN contains(url, '://') THEN split_part(split_part(url, '://', 2), '/', 1) ELSE 'unknown' END"


@query(f"SELECT (SELECT count(*) FROM ({TASKS})) AS tasks, count(*) AS assets, sum(size_bytes)::BIGINT AS stored_bytes FROM ({ASSETS})")
def a1_summary(t: Tables) -> DataFrame:
    return R.summary(t.sql(TASKS), t.sql(ASSETS))


@query(f"SELECT status, count(*) AS n FROM ({TASKS}) GROUP BY status")
def a1_by_status(t: Tables) -> DataFrame:
    return R.by_status(t.sql(TASKS))


@query(f"SELECT coalesce(error_code, 'UNKNOWN') AS error_code, count(*) AS n FROM ({TASKS}) WHERE status <> 'success' GROUP BY ALL")
def a2_failures_by_code(t: Tables) -> DataFrame:
    return R.failures_by_code(t.sql(TASKS))


@query(f"SELECT {_DOMAIN} AS domain, count(*) AS n FROM ({TASKS}) WHERE status <> 'success' GROUP BY ALL ORDER BY n DESC, domain LIMIT 20")
def a3_failures_by_domain(t: Tables) -> DataFrame:
    return R.failures_by_domain(t.sql(TASKS))


@query(f"SELECT task_id, status, url, {_DOMAIN} AS domain, coalesce(error_code, 'UNKNOWN') AS error_code FROM ({TASKS}) WHERE status <> 'success'")
def a4_failure_list(t: Tables) -> DataFrame:
    """From task rows kept as JSON, as the ledger keeps them."""
    j = t.sql(TASKS).select("task_id", "created_at", "status", F.to_json(F.struct(F.col("url").alias("requested_url"), F.col("error_code").alias("last_error_code"))).alias("payload"))
    tasks = j.select("task_id", "created_at", "status", F.get_json_object("payload", "$.requested_url").alias("url"), F.get_json_object("payload", "$.last_error_code").alias("error_code"))
    return R.failure_list(tasks).select("task_id", "status", "url", "domain", "error_code")


@query(f"SELECT task_id, status FROM ({TASKS}) WHERE status = 'failed' ORDER BY created_at DESC, task_id LIMIT 50")
def a5_list_tasks(t: Tables) -> DataFrame:
    return R.newest(t.sql(TASKS), "task_id", "created_at", 50, "failed").select("task_id", "status")


@query(f"SELECT task_id, size_bytes FROM ({ASSETS}) ORDER BY fetched_at DESC, task_id LIMIT 50")
def a5_list_assets(t: Tables) -> DataFrame:
    return R.newest(t.sql(ASSETS), "task_id", "fetched_at", 50).select("task_id", "size_bytes")


@query(f"SELECT t.task_id, t.status, coalesce(a.size_bytes, t.staged_bytes) AS size_bytes FROM ({TASKS}) t LEFT JOIN ({ASSETS}) a ON t.task_id = a.task_id")
def a6_dashboard_rows(t: Tables) -> DataFrame:
    return R.dashboard_rows(t.sql(TASKS), t.sql(ASSETS)).select("task_id", "status", "size_bytes")


@query(f"SELECT count(*) FILTER (WHERE status IN ('failed','blocked')) AS failures FROM ({TASKS})")
def a7_failure_count(t: Tables) -> DataFrame:
    return R.failure_count(t.sql(TASKS))


@query("""WITH o AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'success' WHEN 'signup' THEN 'blocked' WHEN 'purchase' THEN 'partial' ELSE 'pending' END AS status FROM events) SELECT section, count(*) AS submitted, count(*) FILTER (WHERE status IN ('success','partial')) AS evidence, count(*) FILTER (WHERE status = 'blocked') AS blocked
 FROM (SELECT 's' || page_id % 6 AS section, page_id FROM pages) LEFT JOIN o ON event_id = page_id GROUP BY ROLLUP (section)""")
def a9_submission_report(t: Tables) -> DataFrame:
    items = t.pages.select(F.concat(F.lit("s"), (F.col("page_id") % 6).cast("string")).alias("section"), F.col("page_id").alias("resource_key"))
    status = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "signup", "blocked").when(F.col("event_type") == "purchase", "partial").otherwise("pending")
    return R.submission_report(items, t.events.select(F.col("event_id").alias("resource_key"), status.alias("status")))


@query("SELECT conv_id AS asset_id, count(*) AS discovered, count(*) FILTER (WHERE length(text) > 100) AS saved FROM conversations GROUP BY conv_id")
def a10_child_image_stats(t: Tables) -> DataFrame:
    return R.child_image_stats(t.conversations.select(F.col("conv_id").alias("asset_id"), (F.length("text") > 100).alias("saved")))
