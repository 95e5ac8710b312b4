"""Text rules: dates, titles, warnings, redaction, folding, snippets, model output, identifiers, charsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidencelake.functions.charsets import guess

#: Fixed values.
TEMPLATE_MARKERS = ("{{title}}", "{{brTitle}}", "NaN-NaN-NaN", "{{name}}")
TITLE_STOP = ("微信公众号文章", "未命名", "网页", "文档")
SENSITIVE_KEYS = ("authorization", "token", "api_token", "upload_url", "file_url", "full_zip_url", "result_url", "callback_seed", "seed")
NO_TEXT = "无文字内容"
MAX_BODY_BYTES, MAX_PROMPT_CHARS, MIN_PROMPT_CHARS = 1_000_000, 30_000, 40
IDENTIFIERS = {
    "DOI": r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)\b",
    "PMID": r"(?i)\b(?:PMID|PubMed(?:\s*ID)?)[ \t:]*(\d{6,9})\b",
    "PMCID": r"(?i)\b(PMC\d{6,8})\b",
    "NCT": r"(?i)\b(NCT\d{8})\b",
    "ChiCTR": r"(?i)\b(ChiCTR(?:-[A-Za-z0-9]+)?\d{6,10})\b",
    "ORCID": r"(?i)\b(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\b",
}


def normalize_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def fold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def body_prefix(c: Column) -> Column:
    """The first MAX_BODY_BYTES bytes; a cut character becomes a replacement character."""
    return F.when(F.octet_length(c) <= MAX_BODY_BYTES, c).otherwise(F.make_valid_utf8(F.substring(c.cast("binary"), 1, MAX_BODY_BYTES).cast("string")))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def snippet(text: Column, position: Column, radius: int = 60) -> Column:
    """Window around a 0-based position, white space collapsed, with an ellipsis on each side that is cut."""
    start = F.greatest(F.lit(0), position - radius)
    end = F.least(F.length(text), position + radius)
    return F.concat(F.when(start > 0, "…").otherwise(""), collapse(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), "…").otherwise(""))


def quality_warnings(md: Column) -> Column:
    template = F.lit(False)
    for m in TEMPLATE_MARKERS:
        template = template | md.contains(m)
    return F.array_compact(F.array(F.when(F.length(F.regexp_replace(md, r"^\s+|\s+$", "")) < 200, "CONTENT_TOO_SHORT"), F.when(template, "UNRENDERED_TEMPLATE")))


def md_title(md: Column, fallback: Column) -> Column:
    lines = F.transform(F.split(md, "\n"), lambda x: F.trim(x))
    headings = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("# ") & ~x.startswith("##")), lambda x: F.trim(F.substring(x, 3, 1_000_000))), lambda x: F.length(x) > 2)
    plain = F.transform(F.slice(lines, 1, 5), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "^#+", ""), r"^\*+|\*+$", "")))
    usable = F.filter(plain, lambda x: F.length(x).between(3, 120) & ~x.startswith("http") & ~x.startswith("![") & ~x.startswith(">"))
    last = F.when(~fallback.isin(*TITLE_STOP) & ~fallback.startswith("http"), F.trim(fallback))
    return F.coalesce(F.get(headings, F.lit(0)), F.get(usable, F.lit(0)), F.nullif(last, F.lit("")))


def display_title(meta_title: Column, md: Column) -> Column:
    t = F.regexp_replace(F.trim(meta_title), "^[\"']+|[\"']+$", "")
    return F.coalesce(F.when((t != "") & (t != "null"), t), F.nullif(F.trim(F.regexp_extract(md, r"(?m)^#\s+(.{2,150})$", 1)), F.lit("")))


def redact_message(c: Column) -> Column:
    once = F.regexp_replace(c, r"(?i)(authorization|token|seed)\s*[:=]\s*[^\s,;]+", "$1=[redacted]")
    return F.substring(F.regexp_replace(once, r"(https://[^\s?]+)\?[^\s]+", "$1?[redacted]"), 1, 1000)


def safe_options(options: Column) -> Column:
    """A flat map without keys that can hold secrets."""
    return F.map_filter(options, lambda k, _: ~is_sensitive_key(k))


def is_sensitive_key(k: Column) -> Column:
    k = F.lower(k)
    return k.isin(*SENSITIVE_KEYS) | k.endswith("_token") | k.endswith("_url")


def safe_option_rows(path: Column) -> Column:
    """For nested options kept as (path, value) rows: whether no part of the dotted path is a key that can hold a secret."""
    return ~F.exists(F.split(path, r"\."), is_sensitive_key)


def rewrite_image_paths(md: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(md, r"(\]\()images/", "$1assets/"), r"(?i)(<img\s+[^>]*src=[\"'])images/", "$1assets/")


def clean_tag(c: Column) -> Column:
    """Trimmed, without leading #, at most 64 characters; null for nothing."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.trim(c), "^#+", "")), 1, 64), F.lit(""))


def _unfence(c: Column) -> Column:
    return F.when(c.startswith("```markdown"), F.trim(F.regexp_replace(F.substring(c, 12, 100_000_000), "```$", ""))).when(c.startswith("```"), F.trim(F.regexp_replace(F.substring(c, 4, 100_000_000), "```$", ""))).otherwise(c)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_model_output(c: Column) -> Column:
    """Markdown with a newline at its end, or null where fewer than 50 characters are left."""
    t = _strip(_unfence(_strip(F.regexp_replace(_strip(c), "(?s)<think>.*?</think>", ""))))
    return F.when(F.length(t) >= 50, F.concat(t, F.lit("\n")))


def clean_ocr_output(c: Column) -> Column:
    t = _strip(c)
    return F.when(~t.contains(NO_TEXT) & (F.length(t) >= 10), _strip(_unfence(t)))


def build_prompt(template: str, content: Column) -> Column:
    """The template with {content} filled in; null for contents that are too short to ask about."""
    return F.when(F.length(_strip(content)) >= MIN_PROMPT_CHARS, F.replace(F.lit(template), F.lit("{content}"), F.substring(content, 1, MAX_PROMPT_CHARS)))


def parse_datetime(c: Column, tz_hours: int = 8) -> Column:
    """`yyyy-MM-dd HH:mm:ss` in the offset's wall time, or null. Rules in order; see the survey's list of exact semantics."""
    v = F.trim(c)
    number = v.try_cast("decimal(20,0)")
    seconds = F.when(number > 100_000_000_000, number / 1000).otherwise(number)
    zone = f"+{tz_hours:02d}:00"
    wall = lambda ts: F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), "yyyy-MM-dd HH:mm:ss")
    epoch = F.when(v.rlike(r"^\d+$") & (seconds < 253402300800), wall(F.timestamp_seconds(seconds.cast("double")).cast("timestamp_ntz")))
    offset = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(Z|[+-]\d{2}:\d{2})$"
    shifted = F.when(v.rlike(offset), wall(v.try_cast("timestamp").cast("timestamp_ntz")))
    iso = r"(20\d{2})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])[T\s](\d{1,2}:\d{2}(?::\d{2})?)"
    loose = r"(20\d{2})[-/年](0?[1-9]|1[0-2])[-/月](0?[1-9]|[12]\d|3[01])[日\s]*(\d{1,2}:\d{2}(?::\d{2})?)?"

    def date(pattern: str) -> Column:
        return F.concat_ws("-", F.regexp_extract(v, pattern, 1), F.lpad(F.regexp_extract(v, pattern, 2), 2, "0"), F.lpad(F.regexp_extract(v, pattern, 3), 2, "0"))

    def time(pattern: str) -> Column:
        t = F.regexp_extract(v, pattern, 4)
        return F.when(t == "", "00:00:00").when(F.length(t) == 5, F.concat(t, F.lit(":00"))).otherwise(t)

    dated = lambda p: F.when(v.rlike(p), F.concat(date(p), F.lit(" "), time(p)))
    return F.when(v != "", F.coalesce(epoch, shifted, dated(iso), dated(loose)))


def identifiers(text: Column, enabled: tuple[str, ...] = tuple(IDENTIFIERS)) -> Column:
    """array<struct<type, pos, value, key>> of all hits, in the order of types and then of places; repeats are still in it."""
    def hits(kind: str) -> Column:
        value = {"DOI": lambda x: F.regexp_replace(x, r"[.,;)>\]]+$", ""), "PMCID": F.upper, "NCT": F.upper}.get(kind, lambda x: x)
        key = {"DOI": F.lower, "ChiCTR": F.upper}.get(kind, lambda x: x)
        found = F.regexp_extract_all(text, F.lit(IDENTIFIERS[kind]), F.lit(1))
        return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("type"), i.alias("pos"), value(x).alias("value"), key(value(x)).alias("key")))

    parts = [hits(kind) for kind in IDENTIFIERS if kind in enabled]
    return F.concat(*parts)


def declared_charset(body: Column, content_type: Column) -> Column:
    """Charset of the header, else of a meta tag in the first 8192 bytes; lower case, null where none is declared."""
    head = F.decode(F.substring(body, 1, 8192), "ISO-8859-1")
    found = F.coalesce(
        F.nullif(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1), F.lit("")),
    )
    return F.lower(found)


@F.pandas_udf(StringType())
def _guess_charset(bodies: pd.Series) -> pd.Series:
    return bodies.map(guess)


@F.pandas_udf(StringType())
def _decode_other(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    import codecs

    def one(b: bytes | None, c: str | None) -> str | None:
        if b is None:
            return None
        try:
            name = codecs.lookup(c or "utf-8").name
        except LookupError:
            name = "utf-8"
        return b.decode("utf-8-sig" if name == "utf-8" else name, "replace")

    return pd.Series([one(b, c) for b, c in zip(bodies, charsets, strict=True)])


def detect_charset(body: Column, content_type: Column) -> Column:
    """The declared charset, else one guessed from the whole bytes. Valid UTF-8 is seen in the JVM; only other bytes go to Python."""
    declared, text = declared_charset(body, content_type), F.make_valid_utf8(body.cast("string"))
    valid = F.encode(text, "UTF-8") == body
    plain = F.when(valid, F.when(F.length(text) == F.length(body), "ascii").otherwise("utf_8"))
    return F.coalesce(declared, F.when(F.length(body) > 0, plain), _guess_charset(F.when(declared.isNull() & ~valid, body)))


def decode_html(body: Column, charset: Column) -> Column:
    """Text of the bytes, bad ones replaced, a byte-order mark dropped. UTF-8 stays in the JVM; other charsets go to Arrow."""
    utf8 = F.regexp_replace(F.make_valid_utf8(body.cast("string")), "^﻿", "")
    plain = F.coalesce(charset, F.lit("utf-8")).isin("utf-8", "utf8", "ascii", "us-ascii")
    return F.when(plain, utf8).otherwise(_decode_other(F.when(~plain, body), charset))
