"""Gates on captured pages: ordered rules over native columns and the page's visible text, which one parse gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions.urls import domain_candidates
from evidencelake.operators.page_pass import with_visible

#: Fixed values.
NOISE_WORDS = ("Copyright", "ICP备", "公网安备", "许可证号", "扫码登录", "验证码登录", "举报电话", "有害信息举报", "用户协议", "隐私政策")
GENERIC_MARKERS = ("登录后查看完整", "登录后可见", "登录后可阅读全文", "需要登录后可", "此内容需要登录", "开通会员后查看", "继续阅读需登录")
DELETED = ("内容已被发布者删除", "该内容已被发布者删除", "此内容因违规无法查看")
BLOCKED = ("环境异常", "访问过于频繁", "安全验证")


def any_of(c: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | c.contains(m)
    return out


def raw_marks(html: Column) -> Column:
    """Struct of what the rules look for in the raw html: the first early rule that it breaks, and the first of those for short pages."""
    early = (
        F.when(html.contains("DOI Not Found"), "DOI_NOT_FOUND")
        .when(html.contains("Documents Download Module") & html.contains("being prepared for download"), "DOWNLOAD_INTERMEDIATE_PAGE")
        .when(html.contains("cf-browser-verification") | (html.contains("Just a moment...") & html.contains("Cloudflare")), "CLOUDFLARE_BLOCKED")
        .when(html.contains("NaN-NaN-NaN"), "SPA_UNRENDERED_SKELETON")
        .when(any_of(html, ("{{title}}", "{{brTitle}}")), "SPA_TEMPLATE_UNRENDERED")
    )
    short = (
        F.when(any_of(html, ("Loading...", "Loading …")), "SPA_SKELETON_NOT_RENDERED")
        .when(any_of(html, ("JavaScript is disabled", "Please enable JavaScript", "Enable JavaScript")), "JAVASCRIPT_DISABLED_OR_BLOCKED")
        .when(any_of(html, ("404 Not Found", "Page Not Found")), "PAGE_NOT_FOUND")
    )
    return F.struct(early.alias("early"), short.alias("short"))


def quality_tag(marks: Column, visible: Column) -> Column:
    """null for a page that passes; else the first rule that it breaks. marks: raw_marks of its html."""
    n = F.length(visible)
    left = visible
    for w in NOISE_WORDS:
        left = F.replace(left, F.lit(w), F.lit(""))
    return (
        F.when(marks["early"].isNotNull(), marks["early"])
        .when(n == 0, "CONTENT_EMPTY")
        .when(n >= 300, F.lit(None).cast("string"))
        .when(marks["short"].isNotNull(), marks["short"])
        .when(any_of(visible, NOISE_WORDS) & (F.length(F.regexp_replace(left, r"\s", "")) < 30), "NO_MEANINGFUL_CONTENT")
        .otherwise("CONTENT_TOO_SHORT")
    )


def quality_gate(pages: DataFrame, white: str | None = None) -> DataFrame:
    """pages (with html) plus visible_chars, is_valid, tag. Null html is empty. white: as in with_visible."""
    p = with_visible(pages.withColumn("html", F.coalesce("html", F.lit(""))), white)
    p = p.withColumn("tag", quality_tag(raw_marks(F.col("html")), F.col("visible"))).withColumn("visible_chars", F.length("visible").cast("long"))
    return p.withColumn("is_valid", F.col("tag").isNull()).select(*pages.columns, "visible_chars", "is_valid", "tag")


def wechat_gate(html: Column) -> Column:
    """VALID, DELETED, BLOCKED or INVALID."""
    node = lambda i: html.rlike(rf"""<[^>]+\bid=["']{i}["']""")
    return F.when(any_of(html, DELETED), "DELETED").when(any_of(html, BLOCKED), "BLOCKED").when(node("js_article") & (node("js_content") | html.contains("cgiDataNew")), "VALID").otherwise("INVALID")


def detect_truncation(pages: DataFrame, markers: DataFrame) -> DataFrame:
    """(page_id, marker, scope, domain) of the pages (page_id, url, html) that are cut off behind a login.

    markers: (domain, rank, marker). The most specific domain's first marker wins, a domain's marker before a generic one.
    Pages meet markers by the domains of their URL, an equi-join that carries the page's id; the html is tested in place.
    """
    p = pages.select("page_id", "html", F.posexplode_outer(domain_candidates(F.col("url"))).alias("level", "domain"))
    hit = p.join(markers, "domain").where(F.col("html").contains(F.col("marker"))).groupBy("page_id").agg(F.min_by(F.struct("marker", "domain"), F.struct("level", "rank")).alias("h"))
    own = pages.select("page_id", F.coalesce(F.get(domain_candidates(F.col("url")), F.lit(0)), F.lit("")).alias("_d"), F.coalesce(*(F.when(F.col("html").contains(m), m) for m in GENERIC_MARKERS)).alias("_g"))
    j = own.join(hit, "page_id", "left").where("h is not null or _g is not null")
    return j.select("page_id", F.coalesce("h.marker", "_g").alias("marker"), F.when(F.col("h").isNotNull(), "domain").otherwise("generic").alias("scope"), F.coalesce("h.domain", "_d").alias("domain"))
