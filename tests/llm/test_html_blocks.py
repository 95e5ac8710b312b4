"""Every block of text goes through the host suffix array, and the markup checks what it proposes."""

import collections
import random

import numpy as np
import pyarrow as pa

from evidencelake.llm import html_text

MENU = "Home News Sport Culture Weather Shop Jobs Contact About Imprint Privacy Terms Help"
QUOTE = " ".join(f"q{i}" for i in range(20))


def test_articles_and_menus_go_through_the_suffix_array(spark):
    own = [" ".join(f"u{i}_{k}" for k in range(30)) for i in range(40)]
    pages = [(i, "http://h/x", f"<body><nav>{MENU}</nav><nav>only {own[i][:40]}</nav><article><p>{own[i]}</p><p>{QUOTE}</p></article><script>var a</script></body>") for i in range(40)]
    pages.append((40, "http://h/y", f"<body><div>{MENU}</div><div>open text of its own</div></body>"))
    pages.append((40, "http://h/y", pages[40][2]))
    got = collections.Counter((r["page_id"], r["text"], r["n_blocks"], r["n_repeated"], r["n_overruled"]) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect())
    # The menu and the quote are proposed; the quote stays and the menu of the page's own goes by the markup.
    want = collections.Counter((i, f"{own[i]}\n{QUOTE}", 4, 2, 2) for i in range(40))
    want[40, "open text of its own", 2, 1, 0] = 2
    assert got == want


def test_text_beside_a_dropped_inline_element_stays():
    blocks = html_text.page_blocks('<article>before <span class="share">Share<div>now</div></span> after</article>')
    assert blocks == [(html_text.KEPT, "before"), (html_text.DROPPED, "Share"), (html_text.DROPPED, "now"), (html_text.KEPT, "after")]


def test_the_sketch_loses_no_repeated_run():
    """Suffixes on enough pages are all dealt, with every place they have, against sets of runs."""
    rng = random.Random(5)
    shared = [[f"s{k}_{i}" for i in range(rng.randrange(9, 40))] for k in range(12)]
    streams = []
    for i in range(300):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))]
        for s in rng.sample(shared, 3):
            at = rng.randrange(len(words) + 1)
            words[at:at] = s
        streams.append(words if i % 10 else words[: rng.randrange(12)] if i % 20 else shared[0][:5])
    site, least = [i % 3 for i in range(300)], 10
    batch = pa.record_batch([pa.array(site, pa.int64()), pa.array(range(300), pa.int64()), pa.array([least] * 300, pa.int64()), pa.array(["2" + " ".join(w) if w else "" for w in streams])], ["site", "row", "least", "lines"])
    counts = np.zeros(1 << html_text.SKETCH_BITS, np.uint32)
    for part in html_text._count(iter([batch])):
        for chunk, packed in zip(*(c.to_pylist() for c in part.columns), strict=True):
            counts[chunk << html_text.CHUNK_BITS :][: 1 << html_text.CHUNK_BITS] += html_text._unpacked(packed).astype(np.uint32)
    dealt = pa.Table.from_batches(html_text._likely(counts)(iter([batch]))).to_pylist()
    pages, places = collections.defaultdict(int), collections.defaultdict(set)
    for r in dealt:
        pages[r["suffix"]] += r["first"]
        places[r["suffix"]].add((r["row"], r["at"]))
    got = {frozenset(places[h]) for h, n in pages.items() if n >= least}
    want = collections.defaultdict(set)
    for i, words in enumerate(streams):
        n = min(html_text.RUN, len(words))
        for at in range(len(words) - n + 1 if words else 0):
            want[site[i], tuple(words[at : at + n])].add((i, at))
    want = {frozenset(p) for p in want.values() if len({i for i, _ in p}) >= least}
    assert len(want) > 50 and got == want
    assert len(dealt) < sum(map(len, streams))
