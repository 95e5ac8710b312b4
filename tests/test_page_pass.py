"""One parse a page: the gate's visible text, pruning, roots and Markdown."""

from pyspark.sql import functions as F

from evidencelake.operators import convert, gates, html, page_pass

LONG = "A sentence of the article that goes on for a while. " * 4


def nodes(text):
    return html.parse_nodes(text)


def test_visible_text_leaves_out_noise_by_class_and_id(spark):
    words = "many words in a side column " * 20
    noisy = f'<html><body><div class="a sidebar">{words}</div><div id="footer">{words}</div><div class="login">{words}</div></body></html>'
    assert page_pass.visible(nodes(noisy)) == ""
    assert page_pass.visible(nodes("<head><title>T</title></head><body><p> a&amp;b </p><script>x</script>c<!-- d --></body>tail")) == "a&b c"
    assert page_pass.visible(nodes("no <b>body</b> at all")) == "no body at all"
    assert page_pass.visible(nodes(None)) == page_pass.visible(nodes("")) == ""
    d = spark.createDataFrame([(1, noisy, "x"), (2, None, None)], "page_id long, html string, visible_chars_of string")
    assert [(r["tag"], r["visible_chars"], r["visible_chars_of"]) for r in gates.quality_gate(d).orderBy("page_id").collect()] == [("CONTENT_EMPTY", 0, "x"), ("CONTENT_EMPTY", 0, None)]


def test_markdown_of_blocks_and_without_blocks():
    assert page_pass.markdown(nodes("<body><div>one</div><div>two</div></body>")) == "one\ntwo"
    assert page_pass.markdown(nodes(f"<body><h2>Head</h2><p>{LONG}</p><ul><li>item <b>bold</b></ul><blockquote>said</blockquote></body>")) == f"## Head\n\n{LONG.strip()}\n\n- item bold\n\n> said"
    list_of_links = "<ul>" + "<li><a href='/'>a link text</a></li>" * 5 + "</ul>"
    page = f"<body><div class='top-nav'>nav</div>{list_of_links}<div class='content-links'><p><a>a link text</a></p></div><div class='links'><p><a>other links</a></p></div><div id='content'><p>{LONG}</p></div></body>"
    assert page_pass.markdown(nodes(page)) == LONG.strip()
    assert page_pass.markdown(nodes(page.replace("id='content'", "id='other'"))) == f"a link text\n\n{LONG.strip()}"  # a core word protects its box
    assert page_pass.markdown(nodes("<a><div>six letters or more</div></a>")) == "six letters or more"  # a link around a box isn't one inside it
    special = f"<body><p>outside</p><div id='js_content'><p>{LONG}</p></div></body>"
    assert page_pass.markdown(nodes(special), html.WECHAT_ROOTS, 0, False) == LONG.strip()


def test_the_pass_agrees_with_the_node_jobs(spark):
    pages = spark.createDataFrame([(1, f"<html><body><nav><a>m</a></nav><article><h1>Head</h1><p>{LONG}</p><ul><li>a</ul></article><footer>f</footer></body></html>"), (2, f"<body><div><p>{LONG}<p>{LONG}</div><section><a>{LONG}</a></section></body>")], "page_id long, html string")
    table = html.html_nodes(pages)
    clean = html.prune_link_density(html.drop_noise(table))
    md = {r["page_id"]: r["markdown"] for r in html.to_markdown(clean, html.content_root(clean)).collect()}
    seen = {r["page_id"]: r["text"] for r in html.visible_text_exact(table).collect()}
    for r in pages.collect():
        assert page_pass.markdown(nodes(r["html"])) == md[r["page_id"]].strip()
        assert page_pass.visible(nodes(r["html"])) == seen[r["page_id"]]


def test_conversion_is_one_parse_without_a_shuffle(spark):
    rows = spark.range(50).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "web_page").otherwise("wechat_article").alias("resource_type"), F.lit(f"<body><p>{LONG}{LONG}</p></body>").alias("html"))
    out = convert.convert(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert out.where("error_code is null").count() == 50


def test_metadata_of_elements(spark):
    from evidencelake.operators import metadata

    rows = [
        (1, "https://h.org/x", "<body><p>A sentence that mentions 来源：and then goes on for many more words than a label would ever have in any page</p></body>"),
        (2, "https://h.org/x", "<body><div><span>发布时间：2024-03-05 10:20</span></div><p>记者：王五 </p></body>"),
        (3, "https://mp.weixin.qq.com/s", "<body><strong class='account_nickname'> Daily <i>News</i></strong><script>var nickname = 'x'; var createTime = '2024-01-02 03:04';</script></body>"),
        (4, "https://mp.weixin.qq.com/s", "<script>nickname: '未命名账号'</script>"),
        (5, "https://www.zhihu.com/q", "<div itemprop='author'><meta itemprop='url' content='u'><meta itemprop='name' content='Zhang'></div>"),
        (6, "https://h.org/2023/04/05/x", "<p>时间：星期三</p>"),
        (7, None, None),
    ]
    got = {r["page_id"]: (r["published_at"], r["author"]) for r in metadata.article_metadata(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (None, None), 2: ("2024-03-05 10:20:00", "王五"), 3: ("2024-01-02 03:04:00", "DailyNews"), 4: (None, None), 5: (None, "Zhang"), 6: ("2023-04-05 00:00:00", None), 7: (None, None)}
