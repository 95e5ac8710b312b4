"""Pages with white space that the SQL takes for text, with references that it leaves alone, and without words, against the SQL."""

import pytest
from pyspark.sql import functions as F

from evidencelake.plans.pages import spelled, written
from test_references_and_charsets import SF, differences

NAMES = ("h2_visible_text", "h3_quality_gate", "h7_drop_noise", "h8_prune_link_density", "h10_content_root", "h11_to_markdown", "h12_focused_text", "h13_convert")
PIECES = ("\x0b", "&lt;", "\x0b", "&#39;", "\x1c", "\x85", "\u2028", "", "\t", "\n")


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """The smallest table; each page has a piece at the edges and in the midst of its texts, and one in five has an article without words."""
    folder = str(tmp_path_factory.mktemp("odd"))
    p = spark.read.parquet(f"{SF}/pages.parquet")
    piece = F.get(F.array(*map(F.lit, PIECES)), (F.col("page_id") % len(PIECES)).cast("int"))
    odd = F.regexp_replace(F.regexp_replace("html", r"(?=</(?:p|h1|div|footer)>)", "@PIECE@"), r"(<p>\S+ )", "$1@PIECE@ ")
    bare = F.regexp_replace("html", r"(?s)<article>.*</article>", "<article><h1></h1><p></p></article>")
    p.withColumn("html", F.when(F.col("page_id") % 5 == 2, bare).otherwise(F.replace(odd, F.lit("@PIECE@"), piece))).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_odd_pages_equal_their_sql(spark, pages, name):
    found, n = differences(spark, pages, name)
    assert n == 50 and found == []


def test_what_stands_for_white_space_is_given_back(spark):
    text = "a\x0bb\x1c\x85\u2028\xa0\u3000c \t\n&lt; & &amp; \U0001f600"
    row = spark.createDataFrame([(text,)], "t string").select(spelled(F.col("t")).alias("s")).select("s", written(F.col("s")).alias("w")).first()
    assert row["w"] == text.replace("&lt;", "&amp;lt;").replace(" & ", " &amp; ")
    assert len(row["s"].split()) == 5  # only the blank, the tab and the line break divide it
