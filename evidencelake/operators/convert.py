"""Conversion of captures to Markdown evidence; failures are rows, never failed jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import identity as I
from evidencelake.functions import text as X
from evidencelake.operators import gates, metadata, page_pass

Converter = Callable[[DataFrame], DataFrame]
_OUT = ["page_id", "markdown", "converter", "error_code"]


def convert_text(rows: DataFrame) -> DataFrame:
    md = X.normalize_newlines(F.col("html"))
    return rows.select("page_id", md.alias("markdown"), F.lit("text_local").alias("converter"), F.lit(None).cast("string").alias("error_code"))


def convert_pages(rows: DataFrame) -> DataFrame:
    """Web pages and special articles: one parse gives the gate's text and the Markdown; the title stands in front where no heading does.

    No row leaves its task. rows: page_id, resource_type, html.
    """
    h = F.coalesce("html", F.lit(""))
    p = page_pass.converted(rows.select("page_id", "resource_type", h.alias("html"), gates.raw_marks(h).alias("marks"), metadata.title(h).alias("title")))
    tag = gates.quality_tag(F.col("marks"), F.col("visible"))
    p = p.select("page_id", "resource_type", "title", "markdown", tag.alias("tag"))
    headed = F.when(F.col("title").isNotNull() & ~F.col("markdown").startswith("# "), F.concat(F.lit("# "), "title", F.lit("\n\n"), "markdown")).otherwise(F.col("markdown"))
    p = p.withColumn("md", headed).withColumn("error_code", F.coalesce("tag", F.when(F.length("md") < 10, "MARKDOWN_TOO_SHORT")))
    return p.select("page_id", F.when(F.col("error_code").isNull(), F.concat("md", F.lit("\n"))).alias("markdown"), F.concat("resource_type", F.lit("_local")).alias("converter"), "error_code")


#: Converters by resource type; a plug-in is another entry, whose name goes into the fingerprint.
CONVERTERS: dict[str, Converter] = {"text": convert_text, "web_page": convert_pages, "wechat_article": convert_pages}


def convert(captures: DataFrame, converters: dict[str, Converter] | None = None) -> DataFrame:
    """(page_id, markdown, converter, error_code) of captures (page_id, resource_type, html); unsupported types are rejected rows."""
    table = converters or CONVERTERS
    by_function: dict[Converter, list[str]] = {}
    for kind, f in table.items():
        by_function.setdefault(f, []).append(kind)
    out = captures.where(~F.col("resource_type").isin(*table)).select("page_id", F.lit(None).cast("string").alias("markdown"), F.lit("none").alias("converter"), F.lit("UNSUPPORTED_TYPE").alias("error_code"))
    for f, kinds in by_function.items():
        out = out.unionByName(f(captures.where(F.col("resource_type").isin(*kinds))).select(_OUT))
    return out


def fingerprint(resource_type: Column, converters: dict[str, Converter] | None = None, options: list[Column] | None = None) -> Column:
    """Pipeline fingerprint of a row: its converter's identity (module and name) with the options, so that another plug-in rebuilds."""
    who = F.lit(None).cast("string")
    for kind, f in (converters or CONVERTERS).items():
        who = F.when(resource_type == kind, f"{f.__module__}.{f.__qualname__}").otherwise(who)
    return I.pipeline_fingerprint([who.alias("converter"), *(options or [])])


def ocr_candidates(images: DataFrame, least: int = 5120, most: int = 6) -> DataFrame:
    """The first images of an asset that are large enough, numbered. images: (asset_id, position, size_bytes)."""
    w = Window.partitionBy("asset_id").orderBy("position")
    return images.where(F.col("size_bytes") >= least).withColumn("number", F.row_number().over(w)).where(F.col("number") <= most)


def append_ocr(docs: DataFrame, ocr: DataFrame) -> DataFrame:
    """docs (id, markdown) with the texts of their images, in image order, below one heading. ocr: (id, number, text)."""
    section = F.concat(F.lit("### 📷 [附图/海报文字识别: assets/img-"), F.lpad(F.col("number").cast("string"), 3, "0"), F.lit("]\n\n"), "text")
    parts = ocr.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("parts"))
    j = docs.join(parts, "id", "left")
    return j.withColumn("markdown", F.when(F.col("parts").isNotNull(), F.concat("markdown", F.lit("\n\n---\n## 📋 附图与海报文字提取\n\n"), "parts")).otherwise(F.col("markdown"))).drop("parts")


def attach_precomputed(docs: DataFrame, outputs: DataFrame, wanted: Column, allowed: Column) -> DataFrame:
    """docs (id, markdown) with a supplied extraction where it is accepted; fallback_status says why not. outputs: (id, output, failed)."""
    j = docs.join(outputs, "id", "left")
    clean = X.clean_model_output(F.col("output"))
    status = F.when(~wanted, "not_requested").when(~allowed, "policy_denied").when(F.coalesce("failed", F.lit(False)), "llm_error").when(clean.isNotNull(), "not_needed").otherwise("llm_failed")
    use = wanted & allowed & ~F.coalesce("failed", F.lit(False)) & clean.isNotNull()
    return j.select("id", F.when(use, clean).otherwise(F.col("markdown")).alias("markdown"), status.alias("fallback_status"))
