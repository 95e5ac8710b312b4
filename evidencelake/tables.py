"""Intermediate tables in the folder that all executors share, below one folder per application that clean() removes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one below the warehouse where that is unset.

    On a cluster a warehouse on the driver's own disk won't do: each executor would write to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.split(":")[0] in (warehouse, "file") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse + "/_intermediate"


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/evidencelake/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partitions: int | None = None, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(partitions) if partitions else df).write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_materialized(df: DataFrame) -> None:
    """Remove the files of a table made by materialize(); call it only when nothing reads the table any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/evidencelake/" in folder:
            delete_path(df.sparkSession, folder)


def clean(spark: SparkSession, application_id: str | None = None) -> None:
    """Remove the intermediate tables of an application, this one unless another is named: when its results are written."""
    delete_path(spark, f"{shared_dir(spark)}/evidencelake/{application_id or spark.sparkContext.applicationId}")
