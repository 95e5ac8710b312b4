"""What several training-data operators share: durable intermediate tables, distributed ranks, word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.tables import drop_materialized, materialize, shared_dir  # noqa: F401  the operators take them from here

#: Separators of words in every contract of this subpackage.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of the whole text; an empty array for null and for blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building them: runs of non-separators."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def hash_bits(rows: int, rows_a_bucket: int = 50_000) -> int:
    """Leading bits of a hash that deal rows into buckets of about rows_a_bucket: 6 at least, 30 at most."""
    return min(30, max(6, (rows // rows_a_bucket).bit_length()))


def hash_bucket(buckets: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def running_offsets(df: DataFrame, group: list[str], bucket: str, amount: Column, total: str, before: str) -> DataFrame:
    """Per (group, bucket): the amount in all earlier buckets of the group, and the group's total.

    Rows are summed per bucket before the shuffle, so that a group with a third of all rows only brings its buckets here.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_amount"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    ordered = w.orderBy(bucket)
    return sums.select(
        *group,
        bucket,
        (F.sum("_amount").over(ordered) - F.col("_amount")).cast("long").alias(before),
        F.sum("_amount").over(w).cast("long").alias(total),
    )
