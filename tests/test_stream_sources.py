"""A table that is a folder of parts is a stream's source as a single file is."""

import shutil

from evidencelake.plans.registry import Tables
from evidencelake.plans.streams import _stream, r1_ingest_stream

SF = "/root/testdata/sf0.001"


def test_ingestion_of_a_folder_of_parts(spark, tmp_path):
    spark.read.parquet(f"{SF}/pages.parquet").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    shutil.copy(f"{SF}/orders.parquet", f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    assert r1_ingest_stream(t).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    for name in ("pages", "orders"):
        q = _stream(t, name).writeStream.format("memory").queryName(f"source_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"source_{name}").count() == spark.read.parquet(f"{SF}/{name}.parquet").count()
