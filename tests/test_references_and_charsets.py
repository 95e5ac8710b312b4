"""Pages whose titles are cut off inside a reference, and pages without the letters by which a charset is told, against the SQL."""

import duckdb
import pytest

from evidencelake.operators import html as H
from evidencelake.operators.page_pass import with_visible
from evidencelake.plans.registry import oracle_sql, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CUT = ("h2_visible_text", "h3_quality_gate", "h7_drop_noise", "h8_prune_link_density", "h9_main_content", "h10_content_root", "h11_to_markdown", "h12_focused_text", "h13_convert", "r1_ingest_stream")


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """The smallest table with headlines that end in half a reference, and articles in which no o or u occurs."""
    folder = str(tmp_path_factory.mktemp("cut"))
    p = spark.read.parquet(f"{SF}/pages.parquet")
    cut = F.regexp_replace("html", r"(?s)</(title|h1)>", r" cut &amp;&amp</$1>")
    bare = F.regexp_replace("html", r"(?s)<article>.*</article>", "<article><h1>Then</h1><p>the end as that is then let, and all is near here at last; the end as that is then let</p></article>")
    p.withColumn("html", F.when(F.col("page_id") % 8 == 3, bare).when(F.col("page_id") % 3 > 0, cut).otherwise(F.col("html"))).coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


def differences(spark, folder, name):
    got = queries()[name](spark, folder).toArrow()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    con.register("got", got)
    columns = ", ".join(got.column_names)
    want = f"SELECT {columns} FROM ({oracle_sql()[name]})"
    return con.execute(f"SELECT * FROM (({want}) EXCEPT ALL (SELECT {columns} FROM got)) UNION ALL ((SELECT {columns} FROM got) EXCEPT ALL ({want}))").fetchall(), got.num_rows


@pytest.mark.parametrize("name", CUT)
def test_a_reference_that_is_cut_off_is_text(spark, pages, name):
    found, n = differences(spark, pages, name)
    assert n > 0 and found == []


def test_the_operator_itself_reads_references_as_html_does(spark):
    p = spark.createDataFrame([(1, "<body><p>a&amp b &copy c&#39 &ampx &am; AT&T &lt;</p></body>")], "page_id long, html string")
    assert with_visible(p).first()["visible"].startswith("a& b © c'")
    assert with_visible(p.withColumn("html", H.whole_references(F.col("html")))).first()["visible"] == "a&amp b &copy c&#39 &ampx &am; AT&T <"


def test_every_page_has_letters_of_its_charset(spark, pages):
    found, n = differences(spark, pages, "e11_other_charsets")
    assert n > 0 and found == []
