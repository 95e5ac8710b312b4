"""Operational reports. Aggregates are partial before their shuffle; lists are top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(tasks: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: tasks, assets, stored_bytes (primary sizes, shared blobs counted each time). Two scalar aggregates, joined on a constant."""
    a = tasks.agg(F.count("*").alias("tasks")).withColumn("_k", F.lit(1))
    b = assets.agg(F.count("*").alias("assets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("stored_bytes")).withColumn("_k", F.lit(1))
    return a.join(b, "_k").drop("_k")


def by_status(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("n"))


def failures_by_code(tasks: DataFrame) -> DataFrame:
    return tasks.where("status <> 'success'").groupBy(F.coalesce(F.nullif("error_code", F.lit("")), F.lit("UNKNOWN")).alias("error_code")).agg(F.count("*").alias("n"))


def failure_domain(url: Column) -> Column:
    """The authority between :// and /; `unknown` without one."""
    return F.when(url.contains("://"), F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "/", 1)).otherwise("unknown")


def failures_by_domain(tasks: DataFrame, limit: int = 20) -> DataFrame:
    d = tasks.where("status <> 'success'").groupBy(F.coalesce(failure_domain(F.col("url")), F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "domain").limit(limit)


def failure_list(tasks: DataFrame) -> DataFrame:
    """Every task that isn't a success (partial and pending ones too), newest first."""
    return tasks.where("status <> 'success'").withColumn("domain", F.coalesce(failure_domain(F.col("url")), F.lit("unknown"))).withColumn("error_code", F.coalesce("error_code", F.lit("UNKNOWN"))).orderBy(F.desc("created_at"), "task_id")


def newest(rows: DataFrame, key: str, time: str, limit: int, status: str | None = None) -> DataFrame:
    """list_tasks, list_assets, list_runs."""
    r = rows.where(F.col("status") == status) if status else rows
    return r.orderBy(F.desc(time), key).limit(limit)


def dashboard_rows(tasks: DataFrame, assets: DataFrame) -> DataFrame:
    """Tasks with the size of their asset, else of what was staged."""
    return tasks.join(assets.select("task_id", "size_bytes"), "task_id", "left").withColumn("size_bytes", F.coalesce("size_bytes", "staged_bytes"))


def failure_count(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count_if(F.col("status").isin("failed", "blocked")).alias("failures"))


def submission_report(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per section, and in all (null): submitted, evidence produced, blocked. items: (section, resource_key); outcomes: (resource_key, status)."""
    j = items.join(outcomes, "resource_key", "left")
    return j.rollup("section").agg(F.count("*").alias("submitted"), F.count_if(F.col("status").isin("success", "partial")).alias("evidence"), F.count_if(F.col("status") == "blocked").alias("blocked"))


def child_image_stats(images: DataFrame) -> DataFrame:
    return images.groupBy("asset_id").agg(F.count("*").alias("discovered"), F.count_if("saved").alias("saved"))
