"""Append-only ledger, content-addressed blobs, dated evidence, outbox, manifests, Markdown export."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import identity as I


def _existing(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException:  # nothing written yet
        return None


def write_ledger(assets: DataFrame, root: str) -> None:
    """Append only: a row is never overwritten. Partitioned by the date of fetched_at."""
    assets.withColumn("fetch_date", F.to_date("fetched_at")).write.mode("append").partitionBy("fetch_date").parquet(root)


def write_blobs(blobs: DataFrame, root: str) -> None:
    """Each sha256 once, below its first two digits. blobs: sha256, body and what else belongs to a blob."""
    new = blobs.dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    old = _existing(blobs, root)
    if old is not None:
        new = new.join(old.select("prefix", "sha256"), ["prefix", "sha256"], "left_anti")
    new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(root)


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _live(spark: SparkSession, root: str) -> tuple[int, list[dict]]:
    """Number and parts of the newest manifest; 0 and none where nothing is published."""
    fs, glob = _fs(spark, f"{root}/manifests/*.json")
    names = sorted(str(s.getPath().getName()) for s in fs.globStatus(glob) or [])
    if not names:
        return 0, []
    return int(names[-1][:-5]), json.loads("".join(r[0] for r in spark.read.text(f"{root}/manifests/{names[-1]}", wholetext=True).collect()))


def write_evidence(evidence: DataFrame, root: str, batch: str, rebuild: bool = False) -> None:
    """Publish a batch of evidence by year, month and day: staged, moved, and then named by a new manifest.

    What a reader sees is what the newest manifest names, so it sees the batch whole or not at all: a failure before the manifest
    leaves the old view, and what was staged is never read. A batch that is live already changes nothing. A rebuild writes its days
    anew, their other evidence with them, and the manifest hides those days of older parts. One writer at a time per root.
    """
    spark = evidence.sparkSession
    number, parts = _live(spark, root)
    if any(p["batch"] == batch for p in parts):
        return
    dated = evidence.withColumns({"year": F.year("fetched_at"), "month": F.month("fetched_at"), "day": F.dayofmonth("fetched_at")})
    days, touched = ["year", "month", "day"], []
    if rebuild and parts:
        touched = ["-".join(map(str, r)) for r in dated.select(*days).distinct().collect()]  # days of the batch
        old = read_evidence(spark, root).join(F.broadcast(dated.select(*days).distinct()), days, "left_semi").join(dated.select("evidence_id"), "evidence_id", "left_anti")  # a row per day
        dated = dated.unionByName(old.select(dated.columns))
    folder = f"{batch}-{uuid.uuid4().hex}"
    dated.write.partitionBy(*days).parquet(f"{root}/staging/{folder}")
    _publish(spark, root, number + 1, [{**p, "hidden": sorted({*p["hidden"], *touched})} for p in parts], {"batch": batch, "folder": folder, "hidden": []})


def _publish(spark: SparkSession, root: str, number: int, parts: list[dict], new: dict) -> None:
    """Move what is staged to its place and name it: the rename of the manifest is the moment at which readers see it."""
    fs, staged = _fs(spark, f"{root}/staging/{new['folder']}")
    fs.mkdirs(_fs(spark, f"{root}/data")[1])
    if not fs.rename(staged, _fs(spark, f"{root}/data/{new['folder']}")[1]):
        raise OSError(f"{new['folder']} can't be moved to its place")
    name = f"{root}/manifests/{number:012}.json"
    draft = _fs(spark, f"{root}/staging/{new['folder']}.json")[1]
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps([*parts, new]).encode()))
    out.close()
    fs.mkdirs(_fs(spark, f"{root}/manifests")[1])
    target = _fs(spark, name)[1]
    if fs.exists(target) or not fs.rename(draft, target):
        raise OSError(f"{name} is there already: another writer has published")


def read_evidence(spark: SparkSession, root: str) -> DataFrame:
    """What is live, as the newest manifest names it."""
    parts = _live(spark, root)[1]
    if not parts:
        raise FileNotFoundError(f"no evidence is published below {root}")
    key = F.concat_ws("-", "year", "month", "day")
    shown = [spark.read.parquet(f"{root}/data/{p['folder']}").where(~key.isin(p["hidden"]) if p["hidden"] else F.lit(True)) for p in parts]
    return reduce(DataFrame.unionByName, shown)


def outbox_events(rows: DataFrame, event_type: str, aggregate: str) -> DataFrame:
    """One event per row with an id that a replay repeats, so that it can be told."""
    return rows.select(F.sha2(F.concat_ws(":", F.lit(event_type), F.col(aggregate)), 256).alias("event_id"), F.lit(event_type).alias("event_type"), F.col(aggregate).alias("aggregate_id"))


def asset_view_manifest(assets: DataFrame) -> DataFrame:
    """Readable names of an asset's blobs: original.ext, attachments/NNN-role.ext, images/image-NNN.ext.

    assets: asset_id, resource_type, blobs array<struct<role, mime_type, blob_id>>, children array<struct<mime_type, blob_id>>.
    """
    b = assets.select("asset_id", "resource_type", F.posexplode("blobs").alias("pos", "b"))
    ext = lambda c: I.extension_for(c["mime_type"], c["role"], F.col("resource_type"))
    name = F.when(F.col("pos") == 0, F.concat(F.lit("original"), ext(F.col("b")))).otherwise(F.concat(F.lit("attachments/"), F.lpad(F.col("pos").cast("string"), 3, "0"), F.lit("-"), F.col("b.role"), ext(F.col("b"))))
    c = assets.select("asset_id", F.posexplode("children").alias("pos", "b"))
    image = F.concat(F.lit("images/image-"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0"), I.extension_for(F.col("b.mime_type"), F.lit("image"), F.lit("image")))
    return b.select("asset_id", name.alias("path"), F.col("b.blob_id").alias("blob_id")).unionByName(c.select("asset_id", image.alias("path"), F.col("b.blob_id").alias("blob_id")))


def package_manifest(artifacts: DataFrame) -> DataFrame:
    """evidence_id and its sorted paths, without the diagnostic archive."""
    kept = artifacts.where("role <> 'diagnostic_archive'")
    return kept.groupBy("evidence_id").agg(F.array_sort(F.collect_set("logical_path")).alias("paths"))


def export_markdown(evidence: DataFrame, root: str, by_evidence: bool = True) -> None:
    """content.md and meta.yaml of each evidence below its date: as text in a folder of their own, or as JSON lines
    (evidence_id, file, value) per date, which a corpus of millions needs."""
    files = evidence.select("evidence_id", F.to_date("fetched_at").alias("date"), F.explode(F.create_map(F.lit("content.md"), F.col("markdown"), F.lit("meta.yaml"), F.col("meta_yaml"))).alias("file", "value"))
    if by_evidence:
        files.write.mode("append").partitionBy("date", "evidence_id", "file").text(root)
    else:
        files.write.mode("append").partitionBy("date").json(root)
