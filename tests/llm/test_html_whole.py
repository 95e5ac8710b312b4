"""Pages without an article element keep what only some pages of a large host share."""

import random

from evidencelake.llm import html_text


def test_quotes_and_common_phrases_stay_on_a_large_host(spark):
    rng = random.Random(12)
    menu = "Home News Sport Culture Weather Shop Jobs Contact About Imprint Privacy Terms Help"
    quote = " ".join(f"q{i}" for i in range(20))
    phrase = "on the other hand it is well known that"
    pages, want = [], {}
    for i in range(120):
        own = [" ".join(f"u{i}_{j}_{k}" for k in range(rng.randrange(15, 40))) for j in range(3)]
        own[0] += f" {phrase} " + own[1][:30]
        if i % 24 == 0:
            own[1] = quote.replace("q", "r")  # a block of its own on 5 of 120 pages
        if i % 5 == 0:
            own[2] += " " + quote  # inside a longer block on a fifth of the pages
            own[2] = " ".join(f"v{i}_{k}" for k in range(30)) + " " + own[2]
        pages.append((i, None if i % 2 else "http://h/x", "<body>" + "".join(f"<div>{b}</div>" for b in [menu, *own]) + "</body>"))
        want[i] = "\n".join(own)
    one_host = [(i, "http://h/x", h) for i, _, h in pages]
    for rows in (one_host, pages):
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert {i for i in want if got[i] != want[i]} == set()
