"""Pages without html, and texts with code points that are no characters, against the SQL."""

import pytest
from pyspark.sql import functions as F

from test_references_and_charsets import SF, differences


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """The smallest table; one page in five has no html, the others such code points, also ones that stand alone in a paragraph, beside a vertical tab."""
    folder = str(tmp_path_factory.mktemp("none"))
    p = spark.read.parquet(f"{SF}/pages.parquet")
    odd = F.regexp_replace("html", r"(?=</(?:p|h1|title|div)>)", "﷐\x0b</p><p>﷕</p><p>\x0b</p><p>\n</p>")
    p.withColumn("html", F.when(F.col("page_id") % 5 != 1, odd)).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize(("name", "n"), [("h3_quality_gate", 50), ("h7_drop_noise", 50), ("h2_visible_text", 50), ("gate_report", None)])
def test_they_equal_their_sql(spark, pages, name, n):
    found, got = differences(spark, pages, name)
    assert found == [] and got == (n or got)
