"""Keys, roles, routes, status codes and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
MIME_EXTENSIONS = {
    "text/html": ".html", "text/plain": ".txt", "text/markdown": ".md", "application/yaml": ".yaml", "application/pdf": ".pdf", "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif",
    "image/svg+xml": ".svg", "audio/mpeg": ".mp3", "audio/mp4": ".m4a", "audio/wav": ".wav", "video/mp4": ".mp4", "video/quicktime": ".mov", "application/x-mimearchive": ".mhtml",
}
PATH_MIME = {
    ".md": "text/markdown; charset=utf-8", ".yaml": "application/yaml; charset=utf-8", ".json": "application/json", ".zip": "application/zip",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp",
}
HINTS = {"video": "media_transcription", "podcast": "media_transcription", "pdf": "document_text_extraction", "word": "document_text_extraction", "text": "text_normalization"}
#: Remote states as stored; anything else is an error.
REMOTE_STATES = {"waiting-file": "uploading", "pending": "submitted", "running": "polling", "converting": "polling", "done": "done", "failed": "failed"}
PIPELINE_VERSION = "1.1.0"


def lookup(c: Column, table: dict[str, str]) -> Column:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.try_element_at(m, c)


def route_provider(resource_type: Column, kind: Column) -> Column:
    return F.when(kind.isin("file", "text"), "local_input").when(resource_type == "wechat_article", "wechat_article").when(resource_type == "web_page", "crawl4ai").otherwise("direct_download")


def ingestion_hint(resource_type: Column) -> Column:
    return F.coalesce(lookup(resource_type, HINTS), F.lit("html_ingestion"))


def resource_key(resource_type: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", resource_type, key), 256)


def blob_ref(body: Column) -> Column:
    sha = F.sha2(body, 256)
    return F.struct(F.concat(F.lit("sha256:"), sha).alias("blob_id"), sha.alias("sha256"), F.octet_length(body).cast("long").alias("size_bytes"))


def extension_for(mime: Column, role: Column, resource_type: Column) -> Column:
    bare = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    return F.coalesce(
        lookup(bare, MIME_EXTENSIONS),
        F.when(role.isin("primary_html", "raw_http_body", "rendered_html"), ".html").when(role == "screenshot", ".png").when(resource_type == "pdf", ".pdf").when(resource_type == "word", ".docx").when(resource_type == "text", ".txt").otherwise(".bin"),
    )


def mime_for_path(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.coalesce(lookup(suffix, PATH_MIME), F.lit("application/octet-stream"))


def http_error(status: Column) -> Column:
    code = F.when(status == 403, "HTTP_403").when(status == 404, "HTTP_404").when(status == 429, "HTTP_429").when(status >= 500, "HTTP_5XX").otherwise("HTTP_ERROR")
    return F.struct(code.alias("code"), ((status == 403) | (status == 429) | (status >= 500)).alias("retryable"))


def attempt_status(success: Column, retryable: Column, validation: Column) -> Column:
    return F.when(success, "success").when(retryable, "retryable_failure").when(validation == "blocked", "blocked").otherwise("permanent_failure")


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(4.0)).cast("long")


def remote_state(state: Column) -> Column:
    """The stored state; null for an unknown one, which is never a success."""
    return lookup(state, REMOTE_STATES)


def evidence_id(asset: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("ev-"), asset, F.lit("-"), F.substring(fingerprint, 1, 12))


def pipeline_fingerprint(options: list[Column], version: str = PIPELINE_VERSION) -> Column:
    """Of the options in the order of their names; policy flags are not among them."""
    return F.sha2(F.concat(F.lit(version + ":"), F.to_json(F.struct(*options), {"ignoreNullFields": "false"})), 256)


def pipeline_variant(resource_type: Column, external_allowed: Column, model_wanted: Column) -> Column:
    return F.when(resource_type.isin("pdf", "word"), "document").when(resource_type.isin("web_page", "wechat_article") & model_wanted & external_allowed, "llm").otherwise("local")


def egress_policy(allowed: Column, sensitive: Column) -> Column:
    ok = ~sensitive & allowed
    reason = F.when(sensitive, "sensitive source").when(~allowed, "external processing not allowed")
    return F.struct(ok.alias("allowed"), reason.alias("reason"))


def input_error(kind: Column, url: Column, text: Column, size: Column) -> Column:
    """Why an input is invalid, or null."""
    return (
        F.when(~kind.isin("url", "file", "text"), "unknown kind")
        .when((kind == "url") & (F.coalesce(url, F.lit("")) == ""), "url missing")
        .when((kind == "text") & (F.trim(F.coalesce(text, F.lit(""))) == ""), "text missing")
        .when((kind == "file") & (F.coalesce(size, F.lit(0)) <= 0), "file missing")
    )
