"""Sharding by proportional stratified interleaving. DataFrame functions; the law that holds is `rows`.

Rows are shuffled by a seeded hash and ranked within their source; (rank + 1/2) / rows of the source is a fraction that
spreads each source evenly over 0..1. Sorted by that fraction, any stretch of rows has the mixture's shares, and cutting
the order into equal stretches makes shards of equal counts. Both ranks are taken in two steps (buckets of the hash, then
of the fraction; their number follows the number of rows), so that neither a hot source nor the whole table is ever ordered
in one task. Groups of equal texts have no part in this law: their rows are dealt like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import hash_bits, materialize, running_offsets


def shard(docs: DataFrame, shards: int = 8, seed: int = 29) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, source, text).

    Null texts count as no bytes (size 1, crc 0); null sources are a source of their own; repeated rows take neighbouring
    ranks and are interchangeable. Groups of equal texts are not kept together under this law. With fewer rows than shards, some shards are empty. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    d = materialize(d.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id")), "rows")
    bits = hash_bits(d.count())
    d = d.withColumn("part", F.shiftrightunsigned("shuffle", 64 - bits).cast("int"))
    before = running_offsets(d, ["source"], "part", F.lit(1), "of_source", "before")
    within = Window.partitionBy("source", "part").orderBy("shuffle", "doc_id", "size", "text_crc32")
    r = d.join(before, ["source", "part"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1)
    r = r.withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("of_source"))).withColumn("bucket", F.floor(F.col("fraction") * (1 << bits)).cast("int"))
    r = materialize(r.select("doc_id", "source", "size", "text_crc32", "shuffle", "rank", "fraction", "bucket"), "fractions")
    stretch = running_offsets(r, [], "bucket", F.lit(1), "rows", "before")
    order = Window.partitionBy("bucket").orderBy("fraction", "source", "rank")
    p = r.join(stretch, "bucket").withColumn("place", F.col("before") + F.row_number().over(order) - 1)
    number = F.floor(F.col("place") * shards / F.col("rows")).cast("int")
    first = F.ceil(number * F.col("rows") / shards).cast("long")
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), number.alias("shard"), (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
