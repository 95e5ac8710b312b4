"""Article metadata and identifiers: native cascades over the html, and one parse of the page for what only its elements say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import text as X
from evidencelake.functions import urls as U
from evidencelake.operators import page_pass

#: Names in their order.
PUBLISHED_NAMES = ("article:published_time", "pubdate", "publishdate", "date", "citation_publication_date", "citation_date", "og:release_date", "sailthru.date")
AUTHOR_NAMES = ("author", "article:author", "citation_author", "dc.creator", "byl")
TITLE_SEPARATORS = (" - ", " | ", "_微信公众平台", "—", "_")
PLATFORM_SEPARATORS = (" - ", " | ", "_", "——", "·")


def decoded(c: Column) -> Column:
    """The common character references."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plain(fragment: Column) -> Column:
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(fragment, r"(?s)<[^>]*>", "")), r"\s+", " "))


def meta_content(html: Column, name: str) -> Column:
    """content of the first meta tag with that property or name; null where there is none, empty where it has no content."""
    n = name.replace(".", r"\.")
    tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*?\b(?:property|name)\s*=\s*["']{n}["'][^>]*>""", 0)
    return F.when(tag != "", decoded(F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)))


def element_text(html: Column, tag: str) -> Column:
    """Text of the first such element; empty where there is none."""
    return plain(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def title(html: Column, md: Column | None = None, fallback: Column | None = None) -> Column:
    """A branch that is entered but gives nothing ends the html part: later branches are not tried."""
    special = plain(F.regexp_extract(html, r"""(?is)<(\w+)\b[^>]*\b(?:id=["']activity-name["']|class=["'][^"']*\brich_media_title\b)[^>]*>(.*?)</\1\s*>""", 2))
    og = F.coalesce(meta_content(html, "og:title"), meta_content(html, "twitter:title"))
    h1, page = element_text(html, "h1"), element_text(html, "title")
    cut = page
    for s in TITLE_SEPARATORS:
        cut = F.trim(F.substring_index(cut, s, 1))
    got = F.when(special != "", special).when(og.isNotNull(), F.trim(og)).when(html.rlike(r"(?i)<h1\b"), F.when(F.length(h1) <= 150, h1)).when(page != "", cut)
    got = F.nullif(got, F.lit(""))
    return got if md is None else F.coalesce(got, X.md_title(md, fallback if fallback is not None else F.lit("")))


#: Script variables of the special host.
STAMP = r"""(?:var\s+createTimestamp|createTimestamp|ori_create_time|var\s+ct)\s*[:=]\s*['"]?(\d{10})['"]?"""
STAMP_DATE = r"""(?:var\s+createTime|createTime)\s*=\s*['"]([0-9]{4}-[0-9]{2}-[0-9]{2}\s+[0-9]{2}:[0-9]{2}(?::[0-9]{2})?)['"]"""
NICKNAME, ANY_NICKNAME = r"""var\s+nickname\s*=\s*(?:htmlDecode\()?['"]([^'"]+)['"]""", r"""nickname\s*[:=]\s*(?:htmlDecode\()?['"]([^'"]+)['"]"""


def published_at(html: Column, url: Column, dates: Column | None = None) -> Column:
    """Meta names in order, script variables of the special host, the last itemprop of zhihu, the texts of `dates` (page_pass), then the URL.

    Without dates, time elements with a datetime stand for them.
    """
    metas = [X.parse_datetime(meta_content(html, n)) for n in PUBLISHED_NAMES]
    script = lambda p: X.parse_datetime(F.nullif(F.regexp_extract(html, p, 1), F.lit("")))
    stamp = F.when(url.contains(U.SPECIAL_HOST), F.coalesce(script(STAMP), script(STAMP_DATE)))
    props = F.regexp_extract_all(html, F.lit(r"""(?is)<[^>]*itemprop=["']date(?:Created|Published)["'][^>]*content=["']([^"']*)["']"""), F.lit(1))
    zhihu = F.when(url.contains("zhihu.com") & (F.size(props) > 0), X.parse_datetime(F.try_element_at(props, F.lit(-1))))
    if dates is None:
        dates = F.slice(F.regexp_extract_all(html, F.lit(r"""(?is)<time\b[^>]*datetime=["']([^"']*)["']"""), F.lit(1)), 1, 5)
    seen = F.get(F.filter(F.transform(dates, lambda x: X.parse_datetime(x)), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(*metas, stamp, zhihu, seen, U.date_from_url(url))


def platform(url: Column, html: Column, configured: Column | None = None) -> Column:
    """Configured name, og:site_name, the last part of the title, else the authority of the URL."""
    host = F.substring_index(F.substring_index(url, "://", -1), "/", 1)
    page = element_text(html, "title")
    parts = None
    for s in reversed(PLATFORM_SEPARATORS):
        here = F.trim(F.substring_index(page, s, -1))
        parts = F.when(page.contains(s), here) if parts is None else F.when(page.contains(s), here).otherwise(parts)
    site = meta_content(html, "og:site_name")
    named = F.when(site.isNotNull(), F.trim(site)).when(html.rlike(r"(?i)<title\b"), parts)
    named = F.coalesce(F.nullif(named, F.lit("")), F.when(url.contains("://"), F.nullif(host, F.lit(""))))
    return named if configured is None else F.coalesce(configured, named)


def author(html: Column, url: Column, account: Column | None = None, named: Column | None = None) -> Column:
    """The account's own node, script variables of the special host, meta names in order, then what the page's elements label (named)."""
    nick = lambda p: F.trim(F.regexp_extract(html, p, 1))
    own, other = nick(NICKNAME), nick(ANY_NICKNAME)
    special = F.when(url.contains(U.SPECIAL_HOST), F.when(own != "", own).when(other != "未命名账号", F.nullif(other, F.lit(""))))
    metas = [F.when((F.length(meta_content(html, n)) > 0) & (F.length(meta_content(html, n)) <= 50), F.trim(meta_content(html, n))) for n in AUTHOR_NAMES]
    return F.coalesce(*(c for c in (account, special, *metas, named) if c is not None))


def article_metadata(pages: DataFrame, platforms: DataFrame | None = None, parse: bool = True) -> DataFrame:
    """pages (page_id, url, html) with title, published_at, platform, author. platforms: (domain, platform), on the exact host.

    With parse, dates and names are looked for in the pages' elements too: one Arrow pass, nothing is shuffled.
    """
    p = page_pass.with_facts(pages) if parse else pages
    dates, named, account = (F.col(c) if parse else None for c in ("_dates", "_author", "_account"))
    configured = F.lit(None).cast("string")
    if platforms is not None:
        p = p.withColumn("_host", F.lower(F.substring_index(F.substring_index("url", "://", -1), "/", 1))).join(platforms.select(F.col("domain").alias("_host"), F.col("platform").alias("_platform")), "_host", "left")
        configured = F.col("_platform")
    h, u = F.col("html"), F.col("url")
    return p.select(*pages.columns, title(h).alias("title"), published_at(h, u, dates).alias("published_at"), platform(u, h, configured).alias("platform"), author(h, u, account, named).alias("author"))


def extract_identifiers(df: DataFrame, key: str, text: str, enabled: DataFrame | None = None) -> DataFrame:
    """(key, position, type, value): each identifier of a row once, in the order of types and first places.

    All is local to the row: hits are sorted by what they name, the first of each kept and put back in their order. No shuffle.
    """
    kinds = tuple(X.IDENTIFIERS)
    if enabled is not None:
        on = {r[0] for r in enabled.where("enabled").where(F.col("type").isin(*kinds)).select("type").distinct().collect()}  # as many as there are types
        kinds = tuple(k for k in kinds if k in on)
    if not kinds:
        return df.select(key, F.lit(None).cast("int").alias("position"), F.lit("").alias("type"), F.lit("").alias("value")).where("false")
    named = F.array_sort(F.transform(X.identifiers(F.col(text), kinds), lambda x, i: F.struct(x["type"].alias("type"), x["key"].alias("key"), i.alias("at"), x["value"].alias("value"))))

    def first(sorted_: Column) -> Column:
        kept = F.filter(sorted_, lambda x, i: (i == 0) | (F.get(sorted_, i - 1)["type"] != x["type"]) | (F.get(sorted_, i - 1)["key"] != x["key"]))
        return F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["type"].alias("type"), x["value"].alias("value"))))

    once = F.get(F.transform(F.array(named), first), F.lit(0))  # bound to a variable, so that it is made once
    return df.select(key, F.posexplode(once).alias("pos", "i")).select(key, (F.col("pos") + 1).alias("position"), "i.type", "i.value")


def build_evidence_meta(df: DataFrame) -> DataFrame:
    """evidence_id and meta (nested struct, version 2) from columns of one row per evidence."""
    return df.select(
        "evidence_id",
        F.struct(
            F.lit(2).alias("schema_version"),
            F.struct("source_key", "resource_type", "platform", "url").alias("source"),
            F.struct("fetched_at", "published_at").alias("time"),
            F.struct("title", "author", F.length("markdown").alias("chars")).alias("document"),
            F.struct("raw_sha256", "version_no").alias("raw"),
            F.struct("provider", "converter", "pipeline_fingerprint").alias("conversion"),
            F.struct(X.quality_warnings(F.col("markdown")).alias("warnings")).alias("quality"),
        ).alias("meta"),
    )


def render_meta(meta: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The nested metadata as simple YAML: scalars as JSON, two levels."""
    scalar = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)
    lines = [F.concat(F.lit("schema_version: "), scalar(meta["schema_version"]))]
    for g, fields in groups.items():
        lines.append(F.lit(f"{g}:"))
        lines += [F.concat(F.lit(f"  {f}: "), scalar(meta[g][f])) for f in fields]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))
