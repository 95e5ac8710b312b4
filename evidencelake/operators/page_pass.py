"""What the gate and the converter need of a page, from one parse of it: everything here is local to a page, so nothing is shuffled."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evidencelake.operators import html as H

#: Containers, labels and patterns in their order.
PUBLISHED = ("time", ".publish-time", ".time", ".date", ".info", ".post-date", ".article-time", "#publish_time", ".news-time", ".source-time", ".head-time", ".item", ".subtitle", "#source", ".article-info", ".detail-info")
AUTHOR = (".author", ".source", ".article-author", ".info", ".origin", ".copy-from", ".author-name", ".source-name")
DATE_LABELS = ("转自：", "转自:", "发布于", "发布时间", "时间：", "时间:")
NAME_LABELS = ("作者：", "作者:", "记者：", "记者:", "来源：", "来源:")
LABEL = re.compile(r"(?:来源|作者|文/|记者|本文来源|来源机构)[：:\s]+([^\s·|/]{2,30})")
SHORT_LABEL = re.compile(r"(?:作者|记者|来源)[：:\s]+([^\s·|/]{2,30})")
SPECIAL_HOST = "mp.weixin.qq.com"
PAGE_TITLE = "【页面标题】："

_PRUNED_IDS = ("footer", "header", "sidebar", "nav", "fixMenuBar")


def _inherited(rows: list[dict], own) -> list[bool]:  # noqa: ANN001
    """Per node whether it or an ancestor has the property; parents come before their children."""
    out: list[bool] = []
    for r in rows:
        out.append(r["parent_id"] >= 0 and out[r["parent_id"]] or r["text"] is None and own(r))
    return out


def _gate_noise(r: dict) -> bool:
    return r["tag"] in H.NOISE_TAGS or r["dom_id"] in H.NOISE_IDS or any(c in H.NOISE_CLASSES for c in r["classes"])


def _pruned(r: dict) -> bool:
    return r["tag"] in H.NOISE_TAGS or r["dom_id"] in _PRUNED_IDS or any(part in c for c in r["classes"] for part in H.PRUNE_CLASS_PARTS)


def visible(rows: list[dict], white: str | None = None) -> str:
    """The body's text outside the gate's noise (the page's, where there is no body): runs stripped of `white` and joined by a space."""
    gone = _inherited(rows, _gate_noise)
    body = next((r for r in rows if r["tag"] == "body" and not gone[r["node_id"]]), None)
    low, high = (body["node_id"], body["end_id"]) if body else (0, len(rows))
    return " ".join(r["text"].strip(white) for r in rows if r["text"] is not None and low <= r["node_id"] <= high and not gone[r["node_id"]])


def _inside(rows: list[dict], gone: list[bool], tags: tuple[str, ...]) -> dict[int, list[int]]:
    """Per element of these tags that holds anything: characters of what is left in it, those of them in links inside it, paragraphs."""
    found: dict[int, list[int]] = {}
    for r in rows:
        if r["path"] is None or gone[r["node_id"]]:
            continue
        n, paragraph, in_link = len((r["text"] or "").strip()), r["text"] is None, False
        for i in reversed(r["path"]):
            tag = rows[i]["tag"]
            if tag in tags:
                sums = found.setdefault(i, [0, 0, 0])
                sums[0] += n
                sums[1] += n * in_link
                sums[2] += paragraph
            in_link = in_link or tag == "a"
    return found


def _link_lists(rows: list[dict], gone: list[bool]) -> set[int]:
    """Containers that are half links or more, unless a core word protects them; measured before any of them is cut."""
    names = lambda r: f"{r['dom_id'] or ''} {' '.join(r['classes'])}".lower()
    return {i for i, (n, link, _) in _inside(rows, gone, H.DENSITY_TAGS).items() if n >= 6 and link > 0 and 2 * link >= n and not any(w in names(rows[i]) for w in H.CORE_WORDS)}


def _cut(rows: list[dict]) -> list[bool]:
    """Per node whether the converter's noise rule or the density of links takes it."""
    gone = _inherited(rows, _pruned)
    doomed = _link_lists(rows, gone)
    return _inherited(rows, lambda r: gone[r["node_id"]] or r["node_id"] in doomed)


def _fits(r: dict, selector: str) -> bool:
    if selector[0] == "#":
        return r["dom_id"] == selector[1:]
    if selector[0] == ".":
        return selector[1:] in r["classes"]
    return r["role"] == selector[6:-1] if selector.startswith("[role=") else r["tag"] == selector


def markdown(rows: list[dict], selectors: tuple[str, ...] = H.ROOT_SELECTORS, least: int = 60, to_body: bool = True) -> str:
    """Pruned, below the root: the first selector whose first node has at least `least` characters, else the body (to_body), else the page."""
    gone = _cut(rows)
    runs = [r for r in rows if r["text"] is not None and not gone[r["node_id"]]]
    held = [r for r in rows if r["text"] is None and not gone[r["node_id"]]]
    starts = [r["node_id"] for r in runs]

    def chars(r: dict) -> int:
        return sum(len(t["text"].strip()) for t in runs[bisect_right(starts, r["node_id"]) : bisect_right(starts, r["end_id"])])

    firsts = (next((r for r in held if _fits(r, s)), None) for s in selectors)
    root = next((r for r in firsts if r is not None and chars(r) >= least), None)
    if root is None and to_body:
        root = next((r for r in held if r["tag"] == "body"), None)
    low, high = (root["node_id"], root["end_id"]) if root else (-1, len(rows))
    lines: dict[int, list[str]] = {}
    marks: dict[int, str] = {}  # a paragraph has that of the nearest heading, list item or quote around it
    plain = []
    for t in runs:
        if low < t["node_id"] <= high:
            plain.append(t["text"].strip())
            blocks = [i for i in reversed(t["path"]) if i > low and rows[i]["tag"] in H.LINE_TAGS]
            if blocks:
                lines.setdefault(blocks[0], []).append(t["text"])
                marks[blocks[0]] = next((rows[i]["tag"] for i in blocks if rows[i]["tag"] != "p"), "p")
    out = []
    for i, parts in sorted(lines.items()):
        tag, line = marks[i], " ".join(" ".join(parts).split())
        out.append(("#" * int(tag[1]) + " " if tag[0] == "h" else "- " if tag == "li" else "> " if tag == "blockquote" else "") + line)
    return ("\n\n".join(out) or "\n".join(plain)).strip()


def _title(rows: list[dict]) -> str | None:
    """The first h1, else the first title, of two characters or more; what lies in stripped tags doesn't count."""
    cut = _inherited(rows, lambda r: r["tag"] in H.STRIPPED_TAGS)
    for tag in ("h1", "title"):
        head = next((r for r in rows if r["tag"] == tag and not cut[r["node_id"]]), None)
        if head is not None:
            text = _joined([t["text"] for t in rows[head["node_id"] : head["end_id"] + 1] if t["text"] is not None and not cut[t["node_id"]]])
            if len(text) >= 2:
                return text
    return None


def focused(rows: list[dict]) -> str:
    """A page for a model's prompt: pruned, the runs of its main content a line each, below a title that they lack.

    Main content is a known container of 120 characters or more (of each selector the first left), else the div or section of 100
    or more with the highest score (characters, 40 for a paragraph, minus 2 for a character in a link; above 0, ties to the outer
    or earlier one), else the body, else the page.
    """
    gone = _cut(rows)
    held = [r for r in rows if r["text"] is None and not gone[r["node_id"]]]
    runs = [r for r in rows if r["text"] is not None and not gone[r["node_id"]]]
    starts, ends = [r["node_id"] for r in runs], list(accumulate((len(r["text"].strip()) for r in runs), initial=0))

    def chars(r: dict) -> int:
        return ends[bisect_right(starts, r["end_id"])] - ends[bisect_right(starts, r["node_id"])]

    firsts = (next((r for r in held if _fits(r, s)), None) for s in H.MAIN_SELECTORS)
    root = next((r for r in firsts if r is not None and chars(r) >= 120), None)
    if root is None:
        boxes = [(n + 40 * p - 2 * link, -i) for i, (n, link, p) in _inside(rows, gone, ("div", "section")).items() if n >= 100]
        score, at = max(boxes, default=(0, 0))
        root = rows[-at] if score > 0 else next((r for r in held if r["tag"] == "body"), None)
    low, high = (root["node_id"], root["end_id"]) if root else (-1, len(rows))
    text = "\n".join(r["text"].strip() for r in runs if low < r["node_id"] <= high)
    title = _title(rows)
    return f"{PAGE_TITLE}{title}\n\n{text}" if title and title not in text else text


def focused_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of pages (page_id, html), as `focused` has it; null and empty pages have an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [focused(H.parse_nodes(h)) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(rows, "page_id long, text string")


def with_visible(pages: DataFrame, white: str | None = None) -> DataFrame:
    """pages with `visible`, the gate's text of html (string, null: empty). white: the characters that are white space (None: Unicode's)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible(H.parse_nodes(h, white), white) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "visible"])

    return pages.mapInArrow(rows, StructType([*pages.schema.fields, StructField("visible", StringType())]))


def converted(pages: DataFrame, special: str = "wechat_article") -> DataFrame:
    """pages (resource_type, html, ...) without html, with `visible` and `markdown`; pages of the special type have roots of their own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, md = [], []
            for kind, h in zip(batch.column("resource_type").to_pylist(), batch.column("html").to_pylist(), strict=True):
                nodes = H.parse_nodes(h)
                seen.append(visible(nodes))
                md.append(markdown(nodes, H.WECHAT_ROOTS, 0, False) if kind == special else markdown(nodes))
            rest = batch.drop_columns(["html"])
            yield pa.record_batch([*rest.columns, pa.array(seen, pa.string()), pa.array(md, pa.string())], [*rest.schema.names, "visible", "markdown"])

    kept = [f for f in pages.schema.fields if f.name != "html"]
    out = pages.withColumn("html", F.col("html").cast("string")).mapInArrow(rows, StructType([*kept, StructField("visible", StringType()), StructField("markdown", StringType())]))
    return out


def _elements(rows: list[dict], fits) -> Iterator[tuple[dict, list[str]]]:  # noqa: ANN001
    """The elements that fit, in page order, with the text runs inside."""
    runs = [r for r in rows if r["text"] is not None]
    starts = [r["node_id"] for r in runs]
    for r in rows:
        if r["text"] is None and fits(r):
            yield r, [t["text"] for t in runs[bisect_right(starts, r["node_id"]) : bisect_right(starts, r["end_id"])]]


def _joined(parts: list[str]) -> str:
    return "".join(p.strip() for p in parts)


def _short_texts(rows: list[dict], tags: tuple[str, ...], most: int) -> Iterator[str]:
    """The joined texts of the elements of these tags that have at most `most` characters; longer ones are left as soon as they are."""
    runs = [r for r in rows if r["text"] is not None]
    starts = [r["node_id"] for r in runs]
    for r in rows:
        if r["tag"] not in tags:
            continue
        parts, left = [], most
        for k in range(bisect_right(starts, r["node_id"]), len(runs)):
            if starts[k] > r["end_id"] or left < 0:
                break
            parts.append(runs[k]["text"].strip())
            left -= len(parts[-1])
        if left >= 0:
            yield "".join(parts)


def dates_of(rows: list[dict]) -> list[str]:
    """Texts that may hold the publication date, in the rules' order: the usual containers (five of each at most), then labelled short texts."""
    out = []
    for s in PUBLISHED:
        out += [r["attrs"].get("datetime") or "".join(t) for r, t in islice(_elements(rows, lambda r, s=s: _fits(r, s)), 5)]
    for text in _short_texts(rows, ("div", "span", "p", "time"), 60):
        if len(text) >= 6 and "星期" not in text and any(k in text for k in DATE_LABELS):
            out.append(text)
    return out


def author_of(rows: list[dict]) -> str | None:
    """The first name that a usual container, or else a short text, labels as author or source."""
    for s in AUTHOR:
        for _, t in islice(_elements(rows, lambda r, s=s: _fits(r, s)), 5):
            if m := LABEL.search(_joined(t)):
                return m.group(1).strip()
    for text in _short_texts(rows, ("p", "span", "div"), 50):
        if len(text) >= 3 and any(k in text for k in NAME_LABELS) and (m := SHORT_LABEL.search(text)):
            return m.group(1).strip()
    return None


def account_of(rows: list[dict], url: str | None) -> str | None:
    """The account's or author's own node on the two sites that have one."""
    if url and SPECIAL_HOST in url:
        mine = lambda r: r["dom_id"] in ("js_name", "profileBt") or "profile_nickname" in r["classes"] or r["tag"] == "strong" and "account_nickname" in r["classes"]
    elif url and "zhihu.com" in url:
        inside = _inherited(rows, lambda r: r["attrs"].get("itemprop") == "author")
        mine = lambda r: "AuthorInfo-name" in r["classes"] or r["tag"] == "meta" and r["attrs"].get("itemprop") == "name" and r["parent_id"] >= 0 and inside[r["parent_id"]]
    else:
        return None
    r, t = next(_elements(rows, mine), (None, []))
    text = (r["attrs"].get("content") if r and "zhihu.com" in url else None) or _joined(t)
    return text.strip() or None


def with_facts(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with _dates (array<string>), _author and _account: what their elements say."""
    added = StructType.fromDDL("_dates array<string>, _author string, _account string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for url, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                nodes = H.parse_nodes(h)
                got.append((dates_of(nodes), author_of(nodes), account_of(nodes, url)))
            columns = [pa.array([g[0] for g in got], pa.list_(pa.string())), *(pa.array([g[i] for g in got], pa.string()) for i in (1, 2))]
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, *added.names])

    return pages.mapInArrow(rows, StructType([*pages.schema.fields, *added.fields]))
