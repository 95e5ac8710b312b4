"""Versions and retries over several batches; containers scored by what lies inside them; guesses, plug-ins, profiles."""

import datetime as dt

from pyspark.sql import functions as F

from evidencelake.functions import text as X
from evidencelake.operators import convert, html, page_pass
from evidencelake.operators.ledger import assign_versions
from evidencelake.sources import readers
from evidencelake.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
VERSION = "resource_key string, asset_id string, sha256 string, fetched_at long"


def in_batches(spark, path, schema, batches):
    """A stream that reads the given rows batch by batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_versions_follow_over_batches(spark, tmp_path):
    batches = [[("a", "1", "x", 1), ("a", "2", "x", 2), ("b", "3", "y", 1)], [("a", "4", "z", 3), (None, "5", "n", 1)], [("b", "6", "y", 9), ("a", "7", "z", 4), ("c", "8", None, 1)]]
    got = jobs.version_stream(in_batches(spark, tmp_path / "in", VERSION, batches), f"{tmp_path}/out", f"{tmp_path}/ck")
    whole = assign_versions(spark.createDataFrame([r for b in batches for r in b], VERSION))
    assert sorted(map(str, got.select(whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_a_late_capture_takes_the_next_version(spark, tmp_path):
    got = jobs.version_stream(in_batches(spark, tmp_path / "in", VERSION, [[("a", "2", "x", 20)], [("a", "1", "y", 10)]]), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert {r["asset_id"]: (r["version_no"], r["previous_asset_id"]) for r in got.collect()} == {"2": (1, None), "1": (2, "2")}


def test_retries_come_when_they_are_due(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, jobs.ROCKSDB)
    s = lambda seconds: T0 + dt.timedelta(seconds=seconds)
    batches = [[(1, 1, s(0), True), (2, 1, s(0), True), (3, 3, s(0), True), (4, 1, s(0), False)], [(2, 2, s(0.5), False), (5, 1, s(50), True), (5, 2, s(51), True)], [(6, 1, s(100), True)]]
    a = in_batches(spark, tmp_path / "in", "task_id long, attempt_no long, attempt_at timestamp, retryable boolean", batches)
    try:
        got = jobs.run_once(jobs.retries_stream(a), f"{tmp_path}/out", f"{tmp_path}/ck").collect()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    assert sorted((r["task_id"], r["attempt_no"], r["due_at"]) for r in got) == [(1, 2, s(1)), (5, 3, s(53))]


def test_main_content_counts_by_ancestor(spark):
    words = "some words of the text " * 8
    page = f'<body><div id="a">\n <div id="b"><p>{words}</p><p>{words}</p></div><div id="c"><p class="share">{words}</p><p>{words}</p></div>\n</div><div id="d">{words}<a href="/x">{words}</a></div></body>'
    pages = spark.createDataFrame([(1, page), (2, "<body><p>short</p></body>"), (3, f"<a href='/'><div id='e'>{words}</div></a>")], "page_id long, html string")
    n = len(words.strip())
    for nodes, want in ((html.html_nodes(pages), 4 * (n + 40)), (html.drop_noise(html.html_nodes(pages)), 3 * (n + 40))):
        best = html.main_content(nodes).join(nodes, ["page_id", "node_id"]).orderBy("page_id").select("page_id", "dom_id", "score").collect()
        assert [tuple(r) for r in best] == [(1, "a", want), (3, "e", n)]


def test_charset_is_guessed_from_all_bytes(spark):
    chinese = "这是一个用来猜测编码的中文网页，内容足够长。"
    rows = [(1, b"plain ascii"), (2, chinese.encode()), (3, b"a" * 70_000 + (chinese * 400).encode("gb18030")), (4, b""), (5, None)]
    d = spark.createDataFrame(rows, "id int, body binary").withColumn("cs", X.detect_charset(F.col("body"), F.lit(None).cast("string")))
    got = {r["id"]: (r["cs"], r["t"]) for r in d.select("id", "cs", X.decode_html(F.col("body"), F.col("cs")).alias("t")).collect()}
    assert got[1] == ("ascii", "plain ascii") and got[2] == ("utf_8", chinese)
    assert got[3][1].endswith(chinese) and got[4] == (None, "") and got[5] == (None, None)


def test_another_converter_is_another_fingerprint(spark):
    own = lambda rows: rows
    d = spark.createDataFrame([("text",), ("pdf",), (None,)], "k string")
    a = [r[0] for r in d.select(convert.fingerprint(F.col("k"))).collect()]
    b = [r[0] for r in d.select(convert.fingerprint(F.col("k"), {**convert.CONVERTERS, "pdf": own})).collect()]
    assert a[0] == b[0] and a[1] != b[1] and a[2] == b[2] == a[1]


def test_profiles_as_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"truncation_markers": {"X.com": ["m1", "m2"]}}\n{"platform_domains": {"d.com": "Own"}, "truncation_markers": null}\n{broken\n')
    p = readers.load_profiles(spark, str(tmp_path / "p.json"), {"platform_domains": {"d.com": "D", "e.com": "E"}}, lines=True)
    assert sorted(map(tuple, p["platforms"].collect())) == [("d.com", "Own"), ("e.com", "E")]
    assert sorted(map(tuple, p["markers"].collect())) == [("x.com", 0, "m1"), ("x.com", 1, "m2")] and p["extractors"].count() == 0


def test_marks_of_nested_blocks(spark):
    page = "<body><ul><li><p>in</p></li><li>own <b>text</b></li></ul><blockquote><p>said</p> more</blockquote><h2><p>head</p></h2><p>plain</p></body>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    lines = ["- in", "- own text", "> more", "> said", "## head", "plain"]
    nodes = html.html_nodes(pages)
    body = nodes.where("tag = 'body'").select("page_id", "node_id", "end_id")
    assert sorted(html.to_markdown(nodes, body).collect()[0]["markdown"].split("\n\n")) == sorted(lines)
    assert sorted(page_pass.markdown(html.parse_nodes(page)).split("\n\n")) == sorted(lines)
