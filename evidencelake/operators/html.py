"""HTML jobs: one Python pass makes a node table, the rest is Spark SQL over it. (The gate, the converter and the focused
text, which need no node table, are in page_pass.)

Nodes have preorder ids and end_id (the last id inside), so that ancestry is an interval. Text runs are rows of tag '#text';
they and paragraphs carry the path of their ancestors: dropping noise is a narrow filter, counting by container no join.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags, classes and selectors of the rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
LINE_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote")
NOISE_TAGS = ("script", "style", "noscript", "svg", "header", "footer", "nav", "aside", "form", "iframe")
STRIPPED_TAGS = ("script", "style", "noscript", "svg", "iframe", "form")
NOISE_CLASSES = ("footer", "header", "nav", "navbar", "sidebar", "share", "copyright", "login", "menu")
NOISE_IDS = ("footer", "header", "nav")
PRUNE_CLASS_PARTS = ("footer", "header", "nav", "sidebar", "share", "copyright", "menu", "comment", "recommend", "relate", "advertisement")
DENSITY_TAGS = ("nav", "ul", "ol", "menu", "aside", "div", "section")
CORE_WORDS = ("article", "content", "main", "body", "post", "detail", "zoom")
MAIN_SELECTORS = ("#js_content", "article", "main", "[role=main]", "#ContentBody", "#content", "#main-content", "#article-content", "#article_content", ".article-content", ".article-body", ".post-content", ".entry-content", ".detail-content", ".content-main", ".news-content", ".main_content")
WECHAT_ROOTS = ("#js_content", "#js_article")
ROOT_SELECTORS = (
    "#ContentBody", "#content", "#main-content", "#article-content", "#article_content", "#article", "#detail", "#zoom", "#js_content", "article", "main", "[role=main]", ".article-content",
    ".article-body", ".post-content", ".entry-content", ".detail-content", ".content-main", ".zw-content", ".zwinfos", ".txtinfos", ".news-content", ".story-content", ".artical-content", ".main_content", ".article",
)
NODE_SCHEMA = (
    "page_id long, node_id int, parent_id int, end_id int, depth int, tag string, dom_id string, classes array<string>, role string, attrs map<string,string>, text string, "
    "path array<struct<node_id:int,tag:string,dom_id:string,classes:array<string>>>"
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


class _Nodes(HTMLParser):
    def __init__(self, white: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.white = white
        self.rows: list[dict] = []
        self.open: list[dict] = []

    def add(self, tag: str, attrs: dict[str, str], text: str | None) -> dict:
        path = [n["node_id"] for n in self.open] if text is not None or tag == "p" else None
        row = {
            "node_id": len(self.rows), "parent_id": self.open[-1]["node_id"] if self.open else -1, "end_id": len(self.rows), "depth": len(self.open), "tag": tag, "dom_id": attrs.get("id"),
            "classes": (attrs.get("class") or "").split(), "role": attrs.get("role"), "attrs": attrs, "text": text, "path": path,
        }
        self.rows.append(row)
        return row

    def close_to(self, i: int) -> None:
        while len(self.open) > i:
            self.open.pop()["end_id"] = len(self.rows) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            for i in range(len(self.open) - 1, -1, -1):
                t = self.open[i]["tag"]
                if t == "p" or t in _CLOSES.get(tag, ()):
                    self.close_to(i)
                    break
                if t in BLOCK:
                    break
        row = self.add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID:
            self.open.append(row)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                self.close_to(i)
                return
            if tag not in BLOCK and self.open[i]["tag"] in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if data.strip(self.white):
            self.add("#text", {}, data)


def parse_nodes(html: str | None, white: str | None = None) -> list[dict]:
    """Node rows of a page. white: the characters of which a text run is blank (None: all white space of Unicode)."""
    p = _Nodes(white)
    p.feed(html or "")
    p.close()
    p.close_to(0)
    return p.rows


_FIELDS = {"node_id": pa.int32(), "parent_id": pa.int32(), "end_id": pa.int32(), "depth": pa.int32(), "tag": pa.string(), "dom_id": pa.string(), "classes": pa.list_(pa.string()), "role": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string()}


def _batch(rows: list[dict], owners: list[int], bases: list[int]) -> pa.RecordBatch:
    """Node rows of several pages as one batch. Paths are taken from the columns by index, so no node is written out twice in Python."""
    columns = {k: pa.array([list(r[k].items()) if k == "attrs" else r[k] for r in rows], t) for k, t in _FIELDS.items()}
    ends, places = [0], []
    for r, base in zip(rows, bases, strict=True):
        if r["path"]:
            places += [base + k for k in r["path"]]
        ends.append(len(places))
    at = pa.array(places, pa.int64())
    step = pa.StructArray.from_arrays([columns[k].take(at) for k in ("node_id", "tag", "dom_id", "classes")], ["node_id", "tag", "dom_id", "classes"])
    paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), step, mask=pa.array([r["path"] is None for r in rows]))
    return pa.record_batch([pa.array(owners, pa.int64()), *columns.values(), paths], ["page_id", *columns, "path"])


def whole_references(html: Column) -> Column:
    """html in which only character references that end with a semicolon are any; one that is cut off stays the text it is.

    HTML itself, and the parser here, read some names without it too: `AT&amp` is `AT&` to them and `AT&amp` after this.
    """
    return F.regexp_replace(html, r"&(?=#?[0-9A-Za-z]++(?!;))", "&amp;")


def html_nodes(pages: DataFrame, white: str | None = None) -> DataFrame:
    """Node rows of pages (page_id, html), clustered by page. white: as in parse_nodes."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            rows: list[dict] = []
            owners: list[int] = []
            bases: list[int] = []
            for page_id, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                got = parse_nodes(html, white)
                owners += [page_id] * len(got)
                bases += [len(rows)] * len(got)
                rows += got
                if len(rows) > 20_000:
                    yield _batch(rows, owners, bases)
                    rows, owners, bases = [], [], []
            if rows:
                yield _batch(rows, owners, bases)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(batches, NODE_SCHEMA).repartition("page_id")


def _stripped(text: Column) -> Column:
    """Without white space at both ends, that of Unicode too."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_noise(n: Column) -> Column:
    """Of a struct with tag, dom_id, classes: the gate's noise rule."""
    return n["tag"].isin(*NOISE_TAGS) | F.coalesce(n["dom_id"].isin(*NOISE_IDS), F.lit(False)) | F.arrays_overlap(n["classes"], F.array(*map(F.lit, NOISE_CLASSES)))


def is_pruned_name(n: Column) -> Column:
    """The converter's noise: tags, and parts of class names (case matters)."""
    part = F.exists(n["classes"], lambda c: c.rlike("|".join(PRUNE_CLASS_PARTS)))
    return n["tag"].isin(*NOISE_TAGS) | part | F.coalesce(n["dom_id"].isin("footer", "header", "sidebar", "nav", "fixMenuBar"), F.lit(False))


def drop_noise(nodes: DataFrame) -> DataFrame:
    """Nodes without the text runs and paragraphs that lie in noise or are noise."""
    noisy = F.exists("path", is_pruned_name) | is_pruned_name(F.struct("tag", "dom_id", "classes"))
    return nodes.where(~F.col("tag").isin("#text", "p") | ~noisy)


def visible_text_exact(nodes: DataFrame) -> DataFrame:
    """(page_id, text): the body's text outside noise, runs stripped and joined by a space."""
    t = nodes.where((F.col("tag") == "#text") & ~F.exists("path", is_noise) & F.exists("path", lambda p: p["tag"] == "body"))
    return t.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", _stripped(F.col("text")).alias("t")))), lambda x: x["t"]), " ").alias("text"))


def _link_above() -> Column:
    """The nearest link around a node; -1 where there is none."""
    return F.coalesce(F.array_max(F.transform(F.filter("path", lambda x: x["tag"] == "a"), lambda x: x["node_id"])), F.lit(-1))


def link_density(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, total, link): stripped characters in each container, and those of them in links inside it.

    Texts meet their containers by their own path, so there is one exchange at most, on page_id.
    """
    t = nodes.where("tag = '#text'").select("page_id", F.length(_stripped(F.col("text"))).alias("n"), _link_above().alias("a"), F.explode("path").alias("p"))
    t = t.where(F.col("p.tag").isin(*DENSITY_TAGS)).withColumn("in_link", F.col("a") > F.col("p.node_id"))
    return t.groupBy("page_id", F.col("p.node_id").alias("node_id"), F.col("p.tag").alias("tag"), F.col("p.dom_id").alias("dom_id"), F.col("p.classes").alias("classes")).agg(
        F.sum("n").cast("long").alias("total"), F.sum(F.when(F.col("in_link"), F.col("n")).otherwise(0)).cast("long").alias("link")
    )


def prune_link_density(nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Nodes without the text runs and paragraphs in containers that are mostly links; containers with a core word in id or class are safe."""
    d = link_density(nodes)
    core = F.lower(F.concat_ws(" ", F.coalesce("dom_id", F.lit("")), F.concat_ws(" ", "classes"))).rlike("|".join(CORE_WORDS))
    bad = d.where(~core & (F.col("total") >= 6) & (F.col("link") > 0) & (F.col("link") / F.col("total") >= threshold))
    doomed = bad.groupBy("page_id").agg(F.collect_set("node_id").alias("_doomed"))
    j = nodes.join(doomed, "page_id", "left")
    return j.where(~F.col("tag").isin("#text", "p") | F.col("_doomed").isNull() | ~F.arrays_overlap(F.transform("path", lambda p: p["node_id"]), F.col("_doomed"))).drop("_doomed")


def _selector_ranks(selectors: tuple[str, ...]) -> Column:
    """The numbers of all selectors that a node fits."""
    hits = []
    for i, s in enumerate(selectors):
        if s.startswith("#"):
            c = F.col("dom_id") == s[1:]
        elif s.startswith("."):
            c = F.array_contains("classes", s[1:])
        elif s.startswith("[role="):
            c = F.col("role") == s[6:-1]
        else:
            c = F.col("tag") == s
        hits.append(F.when(c, i))
    return F.array_compact(F.array(*hits))


def _text_lengths(nodes: DataFrame) -> DataFrame:
    t = nodes.where("tag = '#text'").select("page_id", F.length(_stripped(F.col("text"))).alias("n"), F.explode(F.transform("path", lambda p: p["node_id"])).alias("node_id"))
    return t.groupBy("page_id", "node_id").agg(F.sum("n").alias("chars"))


def content_root(nodes: DataFrame, selectors: tuple[str, ...] = ROOT_SELECTORS, least: int = 60) -> DataFrame:
    """(page_id, node_id, end_id): the first selector's first node whose text is long enough; pages without one fall back to body."""
    ranked = nodes.where("tag <> '#text'").select("page_id", "node_id", "end_id", "tag", F.explode_outer(_selector_ranks(selectors)).alias("rank")).where("rank is not null or tag = 'body'")
    first = Window.partitionBy("page_id", "rank").orderBy("node_id")
    ranked = ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1 or tag = 'body'")
    sized = ranked.join(_text_lengths(nodes), ["page_id", "node_id"], "left").where((F.coalesce("chars", F.lit(0)) >= least) & F.col("rank").isNotNull() | (F.col("tag") == "body"))
    best = sized.groupBy("page_id").agg(F.min_by(F.struct("node_id", "end_id"), F.struct(F.coalesce("rank", F.lit(999)), "node_id")).alias("r"))
    return best.select("page_id", "r.*")


def main_content(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, end_id, score): a known container of 120 characters or more, else the best-scored div or section, else nothing.

    Containers meet the texts, links and paragraphs inside them by those rows' own paths, in one aggregation.
    """
    known, box = _selector_ranks(MAIN_SELECTORS), F.col("tag").isin("div", "section")
    none = lambda kind: F.lit(None).cast(kind)
    containers = nodes.where(F.col("tag") != "#text").select("page_id", "node_id", "end_id", known.alias("ranks"), box.alias("box"), F.lit(0).alias("n"), F.lit(0).alias("link"), F.lit(0).alias("p")).where("size(ranks) > 0 or box")
    text = F.col("tag") == "#text"
    inside = nodes.where(F.col("tag").isin("#text", "p")).select("page_id", F.when(text, F.length(_stripped(F.col("text")))).otherwise(0).alias("n"), _link_above().alias("a"), (~text).cast("int").alias("p"), F.explode(F.transform("path", lambda x: x["node_id"])).alias("node_id"))
    inside = inside.select("page_id", "node_id", none("int").alias("end_id"), none("array<int>").alias("ranks"), none("boolean").alias("box"), "n", F.when(F.col("a") > F.col("node_id"), F.col("n")).otherwise(0).alias("link"), "p")
    sized = containers.unionByName(inside).groupBy("page_id", "node_id").agg(F.max("end_id").alias("end_id"), F.max("ranks").alias("ranks"), F.max("box").alias("box"), F.sum("n").alias("chars"), (F.sum("n") + 40 * F.sum("p") - 2 * F.sum("link")).alias("score")).where("end_id is not null")
    firsts = sized.select("page_id", "node_id", "end_id", "chars", F.explode("ranks").alias("rank")).groupBy("page_id", "rank").agg(F.min_by(F.struct("node_id", "end_id", "chars"), "node_id").alias("r")).where("r.chars >= 120")
    firsts = firsts.select("page_id", "r.node_id", "r.end_id", F.col("rank").alias("_k"), F.lit(0).cast("long").alias("score"))
    scored = sized.where("box and chars >= 100 and score > 0").select("page_id", "node_id", "end_id", F.lit(999).alias("_k"), "score")
    best = firsts.unionByName(scored).groupBy("page_id").agg(F.min_by(F.struct("node_id", "end_id", "score"), F.struct("_k", -F.col("score"), "node_id")).alias("r"))
    return best.select("page_id", "r.*")


def to_markdown(nodes: DataFrame, roots: DataFrame, titles: DataFrame | None = None, nested: str = "nearest") -> DataFrame:
    """(page_id, markdown) of the blocks below each page's root; each text run belongs to its nearest block.

    A line has the mark of its block, a paragraph that of the nearest heading, list item or quote around it. nested="repeat" gives a run to every block around it, as a parser would that prints nested blocks twice. Pages without any
    block keep their plain text. titles (page_id, title): put in front where no line begins with a heading.
    """
    t = nodes.where("tag = '#text'").join(roots.select("page_id", F.col("node_id").alias("_root"), F.col("end_id").alias("_end")), "page_id").where("node_id between _root and _end")
    blocks = F.filter("path", lambda p: p["tag"].isin(*LINE_TAGS) & (p["node_id"] >= F.col("_root")))
    owner = blocks if nested == "repeat" else F.slice(blocks, F.greatest(F.size(blocks), F.lit(1)), 1)
    marked = F.coalesce(F.try_element_at(F.filter(blocks, lambda p: p["tag"] != "p"), F.lit(-1))["tag"], F.lit("p"))
    run = t.select("page_id", "node_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("run"), F.explode_outer(owner).alias("b"), marked.alias("marked"))
    lines = run.groupBy("page_id", F.col("b.node_id").alias("block"), F.col("b.tag" if nested == "repeat" else "marked").alias("tag")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "run"))), lambda x: x["run"]).alias("runs"), F.min("node_id").alias("first"))
    lines = lines.withColumn("line", F.when(F.col("block").isNull(), F.array_join("runs", "\n")).otherwise(F.array_join("runs", " "))).drop("runs")
    mark = F.when(F.col("tag").rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "))).when(F.col("tag") == "li", "- ").when(F.col("tag") == "blockquote", "> ").otherwise("")
    has = F.max(F.col("block").isNotNull()).over(Window.partitionBy("page_id"))
    kept = lines.withColumn("_has", has).where("block is not null or not _has").withColumn("line", F.concat(mark, "line"))
    md = kept.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("block", "first").alias("at"), "line"))), lambda x: x["line"]), "\n\n").alias("markdown"))
    if titles is None:
        return md
    j = md.join(titles, "page_id", "left")
    return j.select("page_id", F.when(F.col("title").isNotNull() & ~F.col("markdown").startswith("# "), F.concat(F.lit("# "), "title", F.lit("\n\n"), "markdown")).otherwise(F.col("markdown")).alias("markdown"))


def image_urls(nodes: DataFrame) -> DataFrame:
    """(page_id, position, url): images below #js_article, data-src before src, absolute only, each once in first-seen order."""
    roots = nodes.where("dom_id = 'js_article'").groupBy("page_id").agg(F.min_by(F.struct("node_id", "end_id"), "node_id").alias("r"))
    src = F.coalesce(F.nullif(F.col("attrs")["data-src"], F.lit("")), F.col("attrs")["src"])
    i = nodes.where("tag = 'img'").join(roots, "page_id").where("node_id between r.node_id and r.end_id").select("page_id", "node_id", src.alias("url")).where(F.col("url").rlike("^https?://"))
    first = i.groupBy("page_id", "url").agg(F.min("node_id").alias("node_id"))
    return first.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")).alias("position"), "url")
