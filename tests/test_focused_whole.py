"""Focused text of pages without body, and of titles outside the main content."""

from evidencelake.operators import html, page_pass

LONG = "A sentence of the article that goes on for a while. " * 4


def test_fragments_and_titles_outside_the_root(spark):
    rows = [
        (1, f"<p>{LONG}</p><p>second</p>"),
        (2, f"<html><head><title>Site name</title></head><body><header><h1>The <b>headline</b></h1></header><article><p>{LONG}</p></article></body></html>"),
        (3, f"<html><head><title> Only title </title></head><body><h1>x</h1><article><p>{LONG}</p></article></body></html>"),
        (4, f"<body><article><h1>Inside</h1><p>{LONG}</p></article></body>"),
        (5, f"<body><form><h1>Search form</h1></form><svg><title>icon</title></svg><article><p>{LONG}</p></article></body>"),
        (6, None),
        (7, ""),
        (8, "plain text only"),
    ]
    got = {r["page_id"]: r["text"] for r in page_pass.focused_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    text = LONG.strip()
    prefix = "【页面标题】："
    assert got == {1: text + "\nsecond", 2: f"{prefix}Theheadline\n\n{text}", 3: f"{prefix}Only title\n\n{text}", 4: f"Inside\n{text}", 5: text, 6: "", 7: "", 8: "plain text only"}


def test_which_container_is_the_main_content():
    focused = lambda h: page_pass.focused(html.parse_nodes(h))
    text = LONG.strip()
    assert focused(f"<body><aside><article>{LONG}{LONG}</article></aside><article><p>{LONG}</p></article>x</body>") == text  # one in noise doesn't count
    assert focused(f"<body><article id='content'>short</article><p id='content'>{LONG}</p><div>{LONG}{LONG}</div></body>") == f"{LONG}{text}"  # the first of each selector only
    assert focused(f"<body><a href='/'><div class='box'><p>{LONG}</p></div></a>end</body>") == text  # a link around a container isn't one in it
    assert focused(f"<body><div><a href='/'>{LONG}</a><p>more</p></div><div><p>{LONG}</p></div></body>") == text  # a list of links goes
    assert focused(f"<body><section><p>{LONG}</p></section><section><p>{LONG}</p><p>most</p></section></body>") == f"{text}\nmost"
    assert focused("<body><p>a</p><p>b</p></body>") == "a\nb"


def test_nodes_that_fit_several_selectors_and_links_around_containers(spark):
    pages = spark.createDataFrame([(1, f"<body><article class='post-content'>short</article><div class='post-content'><p>{LONG}</p></div></body>"), (2, f"<body><a href='/'><div class='box'>{LONG}</div></a></body>")], "page_id long, html string")
    nodes = html.html_nodes(pages)
    main = {r["page_id"]: r["score"] for r in html.main_content(nodes).collect()}
    assert main[1] > 0  # the first of .post-content is too short, so a div is scored
    assert [(r["total"], r["link"]) for r in html.link_density(nodes).where("page_id = 2").collect()] == [(len(LONG.strip()), 0)]


def test_deep_pages_take_time_in_their_depth_only():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    assert page_pass.focused(html.parse_nodes(deep)) == LONG.strip()
    assert page_pass.dates_of(html.parse_nodes("<div>" * 300 + f"<span>{LONG}</span>" * 300 + "<p>发布时间：2024-03-12</p>")) == ["发布时间：2024-03-12"]
