"""The ledger: batches, versions, latest states, idempotent ingestion, attempts, upgrades, blobs, lineage.

Tables carry hashes, not bodies, through every shuffle. Windows are keyed by resource, task or evidence; a version chain is
seeded with the latest ledger row only, never with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import urls as U

DONE = ("success", "partial")
ASSET_SCHEMA = "resource_key string, asset_id string, sha256 string, fetched_at long"


def dedupe_batch(urls: DataFrame) -> DataFrame:
    """(position, url, normalized, reason) of (position, url): blanks skipped; reason is null for what is submitted.

    The first of equal normalised URLs is submitted. Rejected rows don't enter the window, so that they make no hot key.
    """
    u = urls.withColumn("reason", U.url_reject_reason(F.col("url"))).where("reason is null or reason <> 'blank'")
    ok = u.where("reason is null").withColumn("normalized", U.normalize_url(F.col("url")))
    first = ok.groupBy("normalized").agg(F.min("position").alias("_first"))
    ok = ok.join(first, "normalized").withColumn("reason", F.when(F.col("position") > F.col("_first"), "duplicate_in_batch"))
    columns = ["position", "url", "normalized", "reason"]
    return ok.select(columns).unionByName(u.where("reason is not null").withColumn("normalized", F.lit(None).cast("string")).select(columns))


def skip_existing(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of new (resource_key, force_refetch) whose resource isn't in the ledger with success or partial, or that are forced."""
    have = ledger.where(F.col("status").isin(*DONE)).select("resource_key").distinct()
    return new.where("force_refetch").unionByName(new.where("not coalesce(force_refetch, false)").join(have, "resource_key", "left_anti").select(new.columns))


def latest_assets(ledger: DataFrame) -> DataFrame:
    """The row of the highest version of each resource_key."""
    rest = [c for c in ledger.columns if c != "resource_key"]
    return ledger.groupBy("resource_key").agg(F.max_by(F.struct(*rest), F.struct("version_no", "asset_id")).alias("_r")).select("resource_key", "_r.*").select(ledger.columns)


def _pieces(rows: DataFrame, time: str, rows_a_piece: int) -> Column | None:
    """The piece of time that a row lies in: pieces of about as many rows each, by approximate quantiles of all rows; none if all are in one."""
    n = rows.agg(F.count("*")).first()[0]
    pieces = min(4096, -(-n // rows_a_piece))
    if pieces < 2:
        return None
    bounds = rows.agg(F.percentile_approx(time, [i / pieces for i in range(1, pieces)], 10 * pieces)).first()[0] or []  # 4,095 at most
    return F.array_size(F.filter(F.array(*(F.lit(b) for b in sorted(set(bounds)))), lambda b: b < F.col(time))) if bounds else None


def assign_versions(new: DataFrame, latest: DataFrame | None = None, rows_a_piece: int = 1_000_000) -> DataFrame:
    """new with version_no, previous_asset_id and changed_from_previous, following on the latest known version of each resource.

    new: resource_key, asset_id, sha256, fetched_at. latest: resource_key, asset_id, sha256, version_no. An unchanged
    recapture is a version too; changed_from_previous is null on version 1.

    A segmented scan: rows are ranked within (resource, piece of time), and a row per resource and piece, its count and its last
    capture, is carried to the next piece. So a resource with a third of all rows is as many tasks as it has pieces.
    """
    piece = _pieces(new, "fetched_at", rows_a_piece)
    n = new.withColumn("_piece", F.lit(0) if piece is None else piece)
    w = Window.partitionBy("resource_key", "_piece").orderBy("fetched_at", "asset_id")
    over = Window.partitionBy("resource_key").orderBy("_piece")
    ends = n.groupBy("resource_key", "_piece").agg(F.count("*").alias("_n"), F.max_by(F.struct("asset_id", "sha256"), F.struct("fetched_at", "asset_id")).alias("_last"))
    carried = ends.select(F.col("resource_key").alias("_key"), F.col("_piece").alias("_in"), (F.sum("_n").over(over) - F.col("_n")).alias("_before"), F.lag("_last").over(over).alias("_carried"))
    carried = carried.where("_before > 0")
    ranked = n.withColumns({"version_no": F.row_number().over(w), "_pa": F.lag("asset_id").over(w), "_ps": F.lag("sha256").over(w), "_at": F.lag(F.lit(1)).over(w)})
    if piece is None:
        out = ranked.withColumns({"_before": F.lit(None).cast("long"), "_carried": F.lit(None).cast(carried.schema["_carried"].dataType)})
    else:
        out = ranked.join(carried, ranked["resource_key"].eqNullSafe(carried["_key"]) & (ranked["_piece"] == carried["_in"]), "left")
    if latest is not None:
        known = latest.select(F.col("resource_key").alias("_known"), F.col("asset_id").alias("_a"), F.col("sha256").alias("_s"), F.col("version_no").alias("_v"))
        out = out.join(known, F.col("resource_key").eqNullSafe(F.col("_known")), "left")
    else:
        out = out.withColumns({"_known": F.lit(None), "_a": F.lit(None).cast("string"), "_s": F.lit(None).cast("string"), "_v": F.lit(None).cast("int")})
    # The row before: in the piece, else the last of the pieces before, else the latest known.
    within, carried_on = F.col("_at").isNotNull(), F.col("_before").isNotNull()
    before = lambda here, there, known: F.when(within, F.col(here)).when(carried_on, F.col(there)).otherwise(F.col(known))
    return out.select(
        *(ranked[c] for c in new.columns),
        (F.col("version_no") + F.coalesce("_before", F.lit(0)) + F.coalesce("_v", F.lit(0))).cast("int").alias("version_no"),
        before("_pa", "_carried.asset_id", "_a").cast(new.schema["asset_id"].dataType).alias("previous_asset_id"),
        (F.col("sha256") != before("_ps", "_carried.sha256", "_s")).alias("changed_from_previous"),
    )


def version_history(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole chains of the resources in keys (resource_key), with each version's place from the end."""
    w = Window.partitionBy("resource_key").orderBy(F.desc("version_no"))
    return ledger.join(keys.distinct(), "resource_key", "left_semi").withColumn("versions_after", F.row_number().over(w) - 1)


def asset_status(warnings: Column) -> Column:
    return F.when(F.exists(warnings, lambda x: x.contains("child_")), "partial").otherwise("success")


def upsert_latest(log: DataFrame, key: str, seq: str, maxima: tuple[str, ...] = (), keep_last_known: tuple[str, ...] = ()) -> DataFrame:
    """Last write wins per key; `maxima` fold with max, `keep_last_known` keep their last value that isn't null."""
    rest = [c for c in log.columns if c not in (key, *maxima, *keep_last_known)]
    folds = [F.max(c).alias(c) for c in maxima] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in keep_last_known]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r"), *folds).select(key, "_r.*", *maxima, *keep_last_known).select(log.columns)


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """existing, and of new the first row of each key that existing doesn't have."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
    return existing.unionByName(first.join(existing.select(keys), keys, "left_anti").select(existing.columns))


def pending_ingestion(assets: DataFrame, evidence: DataFrame, fingerprint: Column) -> DataFrame:
    """Assets without evidence for this fingerprint."""
    a = assets.withColumn("pipeline_fingerprint", fingerprint)
    return a.join(evidence.select("asset_id", "pipeline_fingerprint"), ["asset_id", "pipeline_fingerprint"], "left_anti")


def repair_tasks(tasks: DataFrame, assets: DataFrame) -> DataFrame:
    """Unfinished tasks whose asset exists take its status and id."""
    a = assets.groupBy("task_id").agg(F.max_by(F.struct("asset_id", "acquisition_status"), "asset_id").alias("_a"))
    open_ = ~F.col("status").isin("success", "partial", "failed", "blocked") & F.col("_a").isNotNull()
    j = tasks.join(a, "task_id", "left")
    return j.withColumns({"status": F.when(open_, F.col("_a.acquisition_status")).otherwise(F.col("status")), "asset_id": F.when(open_, F.col("_a.asset_id"))}).drop("_a")


def fail_drifted_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Unfinished model runs whose fingerprint is no longer current fail with PIPELINE_VARIANT_UNAVAILABLE."""
    j = runs.join(current.select("asset_id", F.col("pipeline_fingerprint").alias("_now")), "asset_id", "left")
    drifted = F.col("status").isin("pending", "running") & (F.col("provider") == "llm") & ~F.col("pipeline_fingerprint").eqNullSafe(F.col("_now"))
    return j.withColumns({"status": F.when(drifted, "failed").otherwise(F.col("status")), "error_code": F.when(drifted, "PIPELINE_VARIANT_UNAVAILABLE")}).drop("_now")


def recoverable(rows: DataFrame, terminal: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Rows that aren't finished, in claim order."""
    return rows.where(~F.col("status").isin(*terminal)).orderBy(*order)


def attempt_outcome(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Per task the attempts that really happen (up to the first success or final failure, `most` at most) and the final status."""
    w = Window.partitionBy("task_id").orderBy("attempt_at", "attempt_id")
    a = attempts.withColumn("attempt_no", F.row_number().over(w)).where(F.col("attempt_no") <= most)
    ends = (F.col("success") | ~F.col("retryable")).cast("int")
    a = a.withColumn("_ended", F.coalesce(F.max(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_ended = 0")
    last = a.groupBy("task_id").agg(F.count("*").alias("attempts"), F.max_by(F.struct("success", "code"), "attempt_no").alias("_r"))
    return last.select("task_id", "attempts", F.when(F.col("_r.success"), "success").otherwise("failed").alias("status"), F.when(~F.col("_r.success"), F.col("_r.code")).alias("error_code"))


def attempts_of(tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """tasks with their attempts nested in order."""
    nested = attempts.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("attempt_at", "attempt_id", "status"))).alias("attempts"))
    return tasks.join(nested, "task_id", "left")


def select_upgrade(captures: DataFrame) -> DataFrame:
    """Kept captures of each resource in version order, with warnings.

    captures: resource_key, tier (0 anonymous, 1, 2), success, truncated. A truncated anonymous capture stays; the best
    successful, untruncated alternative follows it. Alternatives that fail leave a warning on the anonymous one.
    """
    base = captures.where("tier = 0")
    need = base.where("truncated").select("resource_key")
    tried = captures.where("tier > 0").join(need, "resource_key", "left_semi")
    best = tried.where("success and not truncated").groupBy("resource_key").agg(F.min("tier").alias("_best"))
    kept = tried.join(best, "resource_key").where(F.col("tier") == F.col("_best")).withColumn("warnings", F.lit("")).drop("_best")
    failed = tried.join(best, "resource_key", "left").where("(not success or truncated) and tier < coalesce(_best, 9)")
    notes = failed.groupBy("resource_key").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("upgrade_failed_tier_"), F.col("tier").cast("string")))), ",").alias("warnings"))
    first = base.join(notes, "resource_key", "left").withColumn("warnings", F.coalesce("warnings", F.lit("")))
    both = first.unionByName(kept)
    return both.withColumn("version_no", F.when(F.col("tier") == 0, 1).otherwise(2))


def find_blobs(assets: DataFrame) -> DataFrame:
    """(blob_id, asset_id): the newest asset that refers to each blob, be it as primary, as one of its blobs or as a child."""
    every = F.array_union(F.array_union(F.array("primary_blob"), F.coalesce("blobs", F.array().cast("array<string>"))), F.coalesce("children", F.array().cast("array<string>")))
    return assets.select("asset_id", "fetched_at", F.explode(every).alias("blob_id")).groupBy("blob_id").agg(F.max_by("asset_id", F.struct("fetched_at", "asset_id")).alias("asset_id"))


def blob_dedup(blobs: DataFrame) -> DataFrame:
    """Per hash: references, the first of them, and the bytes that sharing saves."""
    g = blobs.groupBy("sha256").agg(F.count("*").alias("refs"), F.min("ref").alias("first_ref"), F.max("size_bytes").alias("size_bytes"))
    return g.withColumn("saved_bytes", (F.col("refs") - 1) * F.col("size_bytes"))


def artifact_lineage(artifacts: DataFrame, assets: DataFrame) -> DataFrame:
    """artifact -> parent artifact's blob -> raw blob of the asset."""
    parent = artifacts.select(F.col("blob_id").alias("parent_blob_id"), F.col("evidence_id"), F.col("logical_path").alias("parent_path"))
    j = artifacts.join(parent, ["evidence_id", "parent_blob_id"], "left")
    return j.join(assets.select("asset_id", F.col("blob_id").alias("raw_blob_id")), "asset_id", "left").select("evidence_id", "logical_path", "blob_id", "parent_path", "raw_blob_id")


def explode_artifacts(evidence: DataFrame) -> DataFrame:
    """One row per (evidence, role, path) of evidence(evidence_id, artifacts array<struct<role, path, sha256>>); the last wins."""
    a = evidence.select("evidence_id", F.posexplode("artifacts").alias("pos", "a")).select("evidence_id", "pos", "a.*")
    return a.groupBy("evidence_id", "role", "path").agg(F.max_by("sha256", "pos").alias("sha256"))


def image_collisions(artifacts: DataFrame) -> DataFrame:
    """Paths of an evidence that stand for different bytes."""
    return artifacts.groupBy("evidence_id", "path").agg(F.count_distinct("sha256").alias("versions")).where("versions > 1")


def refetch_list(assets: DataFrame, tasks: DataFrame) -> DataFrame:
    """New forced tasks for URL assets; other assets come out with a reason."""
    j = assets.join(tasks.select("task_id", "kind", "url"), "task_id", "left")
    ok = F.coalesce((F.col("kind") == "url") & F.col("url").isNotNull(), F.lit(False))
    return j.select("asset_id", F.when(ok, F.col("url")).alias("url"), ok.alias("force_refetch"), F.when(~ok, "only URL assets can be fetched again").alias("reason"))


def document_markdown(members: DataFrame) -> DataFrame:
    """(archive_id, path): the first full.md of each parse result, null where there is none."""
    found = F.min(F.when(F.element_at(F.split("path", "/"), -1) == "full.md", F.col("path")))
    return members.groupBy("archive_id").agg(found.alias("path"))
