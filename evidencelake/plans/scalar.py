"""Queries of the scalar operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import identity as I
from evidencelake.functions import text as X
from evidencelake.functions import urls as U
from evidencelake.plans.registry import Tables, query

#: Adapters: text that both engines read.
URLS = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat('  ', replace(replace(url, 'https://', 'HTTPS://'), 'http://', 'HTTP://'), ' ') WHEN 1 THEN replace(replace(url, '.example.', '.EXAMPLE.'), '://', '://') WHEN 2 THEN concat('javascript:', url)
 WHEN 3 THEN regexp_replace(url, '^(https?)://([^/]*)', 'https://\\2:443') WHEN 4 THEN regexp_replace(url, '^(https?)://([^/]*)', 'http://\\2:8080') WHEN 5 THEN regexp_replace(url, '^(https?)://', 'http://user:pass@') ELSE url END AS u FROM {pages}"""
TYPED = "SELECT page_id, url, concat(regexp_extract(url, '^([^?#]*)', 1), CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MP4' WHEN 2 THEN '.mp3' WHEN 3 THEN '.docx' ELSE '' END, CASE WHEN page_id % 2 = 0 THEN '?a=1' ELSE '' END) AS u FROM {pages}"
_STRIP = "regexp_replace(u, '^\\s+|\\s+$', '', 'g')"
_SCHEME = f"lower(regexp_extract({_STRIP}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_AUTH = f"regexp_extract({_STRIP}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_HOST = f"lower(regexp_extract({_AUTH}, '^(?:.*@)?([^:]*)', 1))"
_PATH = f"regexp_extract({_STRIP}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PORT = f"regexp_extract({_AUTH}, ':(\\d+)$', 1)"
_NORMAL = f"""CASE WHEN {_SCHEME} IN ('http','https') AND {_HOST} <> '' THEN {_SCHEME} || '://' || {_HOST}
 || CASE WHEN {_PORT} = '' OR ({_SCHEME} = 'https' AND {_PORT} = '443') OR ({_SCHEME} = 'http' AND {_PORT} = '80') THEN '' ELSE ':' || {_PORT} END
 || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || regexp_extract({_STRIP}, '^[^?#]*(\\?[^#]+)', 1) END"""
_CLASS = f"""CASE WHEN {_HOST} = 'mp.weixin.qq.com' THEN 'wechat_article' WHEN lower({_PATH}) LIKE '%.pdf' THEN 'pdf'
 WHEN regexp_matches(lower({_PATH}), '\\.(mp4|mov|mkv|webm|m4v)$') THEN 'video' WHEN regexp_matches(lower({_PATH}), '\\.(mp3|m4a|aac|wav|flac|ogg|opus)$') THEN 'podcast'
 WHEN regexp_matches(lower({_PATH}), '\\.(doc|docx|odt)$') THEN 'word' ELSE 'web_page' END"""
_PLAIN_URLS = "SELECT page_id, url AS u FROM pages"


def _urls(t: Tables) -> DataFrame:
    return t.spark.sql(URLS.replace("\\\\2", "$2").replace("\\2", "$2"), pages=t.pages)


@query(f"SELECT page_id, {_NORMAL} AS normalized FROM ({URLS})")
def e1_normalize_url(t: Tables) -> DataFrame:
    return _urls(t).select("page_id", U.normalize_url(F.col("u")).alias("normalized"))


@query(f"""SELECT page_id, CASE WHEN {_STRIP} = '' THEN 'blank' WHEN {_SCHEME} NOT IN ('http','https') THEN 'unsupported_scheme' WHEN {_HOST} = '' THEN 'no_host' WHEN contains({_AUTH}, '@') THEN 'embedded_credentials' END AS reason FROM ({URLS})""")
def e2_url_reject_reason(t: Tables) -> DataFrame:
    return _urls(t).select("page_id", U.url_reject_reason(F.col("u")).alias("reason"))


@query(f"SELECT page_id, {_CLASS} AS resource_type FROM ({TYPED})")
def e3_classify_url(t: Tables) -> DataFrame:
    return t.sql(TYPED).select("page_id", U.classify_url(F.col("u")).alias("resource_type"))


UPLOADS = "SELECT doc_id, concat('file', CAST(doc_id AS STRING), CASE doc_id % 8 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.mov' WHEN 3 THEN '.ogg' WHEN 4 THEN '.md' ELSE '' END) AS name, CASE doc_id % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/msword' WHEN 2 THEN 'audio/wav' WHEN 3 THEN 'video/mp4; x=1' ELSE NULL END AS mime FROM {documents}"


@query(f"""SELECT doc_id, CASE WHEN n LIKE '%.pdf' OR m = 'application/pdf' THEN 'pdf' WHEN regexp_matches(n, '\\.(doc|docx|odt)$') OR contains(m, 'wordprocessingml') OR m = 'application/msword' THEN 'word'
 WHEN m LIKE 'video/%' OR regexp_matches(n, '\\.(mp4|mov|mkv|webm|m4v)$') THEN 'video' WHEN m LIKE 'audio/%' OR regexp_matches(n, '\\.(mp3|m4a|aac|wav|flac|ogg|opus)$') THEN 'podcast'
 WHEN m LIKE 'text/%' OR regexp_matches(n, '\\.(txt|md)$') THEN 'text' ELSE 'binary_file' END AS resource_type FROM (SELECT doc_id, lower(name) AS n, coalesce(lower(mime), '') AS m FROM ({UPLOADS}))""")
def e4_classify_upload(t: Tables) -> DataFrame:
    return t.sql(UPLOADS).select("doc_id", U.classify_upload(F.col("name"), F.col("mime")).alias("resource_type"))


@query(f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'local_input' WHEN c = 'wechat_article' THEN c WHEN c = 'web_page' THEN 'crawl4ai' ELSE 'direct_download' END AS provider FROM (SELECT page_id, {_CLASS} AS c FROM ({TYPED}))")
def e5_route_provider(t: Tables) -> DataFrame:
    kind = F.when(F.col("page_id") % 4 == 0, "text").otherwise("url")
    return t.sql(TYPED).select("page_id", I.route_provider(U.classify_url(F.col("u")), kind).alias("provider"))


@query(f"SELECT page_id, CASE WHEN c IN ('video','podcast') THEN 'media_transcription' WHEN c IN ('pdf','word') THEN 'document_text_extraction' WHEN c = 'text' THEN 'text_normalization' ELSE 'html_ingestion' END AS hint FROM (SELECT page_id, {_CLASS} AS c FROM ({TYPED}))")
def e6_ingestion_hint(t: Tables) -> DataFrame:
    return t.sql(TYPED).select("page_id", I.ingestion_hint(U.classify_url(F.col("u"))).alias("hint"))


@query("SELECT doc_id, sha256('text:' || source) AS resource_key FROM documents")
def e7_resource_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", I.resource_key(F.lit("text"), F.col("source")).alias("resource_key"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS blob_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def e8_blob_ref(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", I.blob_ref(F.col("text").cast("binary")).alias("b")).select("doc_id", "b.*")


BLOBS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' IMAGE/PNG ' WHEN 2 THEN 'application/x-unknown' WHEN 3 THEN NULL WHEN 4 THEN 'application/pdf' ELSE 'video/quicktime' END AS mime, CASE page_id % 4 WHEN 0 THEN 'primary_html' WHEN 1 THEN 'screenshot' ELSE 'attachment' END AS role, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'word' WHEN 2 THEN 'text' ELSE 'web_page' END AS rt FROM {pages}"


@query(f"""SELECT page_id, CASE m WHEN 'text/html' THEN '.html' WHEN 'image/png' THEN '.png' WHEN 'application/pdf' THEN '.pdf' WHEN 'video/quicktime' THEN '.mov' ELSE
 CASE WHEN role = 'primary_html' THEN '.html' WHEN role = 'screenshot' THEN '.png' WHEN rt = 'pdf' THEN '.pdf' WHEN rt = 'word' THEN '.docx' WHEN rt = 'text' THEN '.txt' ELSE '.bin' END END AS extension
 FROM (SELECT *, lower(trim(split_part(coalesce(mime, ''), ';', 1))) AS m FROM ({BLOBS}))""")
def e9_extension_for(t: Tables) -> DataFrame:
    return t.sql(BLOBS).select("page_id", I.extension_for(F.col("mime"), F.col("role"), F.col("rt")).alias("extension"))


PATHS = "SELECT page_id, concat('assets/img-', CAST(page_id AS STRING), CASE page_id % 7 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.md' WHEN 3 THEN '.json' WHEN 4 THEN '' WHEN 5 THEN '.webp' ELSE '.tar' END) AS path FROM {pages}"


@query(f"""SELECT page_id, CASE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) WHEN '.png' THEN 'image/png' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.md' THEN 'text/markdown; charset=utf-8' WHEN '.json' THEN 'application/json' WHEN '.webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS mime FROM ({PATHS})""")
def e10_mime_for_path(t: Tables) -> DataFrame:
    return t.sql(PATHS).select("page_id", I.mime_for_path(F.col("path")).alias("mime"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE 'utf-8' END AS charset, html AS text, length(html)::BIGINT AS n_chars FROM pages")
def e12_decode_html(t: Tables) -> DataFrame:
    bom = F.when(F.col("page_id") % 3 == 1, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    kind = F.when(F.col("page_id") % 3 == 2, F.lit(None).cast("string")).otherwise(F.lit("utf-8"))
    p = t.pages.select("page_id", F.concat(bom, F.col("html").cast("binary")).alias("body"), kind.alias("charset"))
    return p.select("page_id", "charset", X.decode_html(F.col("body"), F.col("charset")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


@query(f"""WITH h AS (SELECT page_id, string_split({_HOST}, '.') AS l FROM ({_PLAIN_URLS})), r AS (SELECT page_id, l, unnest(range(1, len(l))) AS rank FROM h)
 SELECT page_id, rank::INTEGER AS rank, array_to_string(l[rank:], '.') AS domain FROM r""")
def e13_domain_candidates(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.posexplode(U.domain_candidates(F.col("url"))).alias("pos", "domain")).select("page_id", (F.col("pos") + 1).alias("rank"), "domain")


ATTEMPTS = "SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 403 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 ELSE 503 END AS http_status FROM {events}"


@query(f"SELECT event_id, CASE WHEN http_status IN (403,404,429) THEN 'HTTP_' || http_status WHEN http_status >= 500 THEN 'HTTP_5XX' ELSE 'HTTP_ERROR' END AS code, http_status IN (403,429) OR http_status >= 500 AS retryable FROM ({ATTEMPTS})")
def e14_http_error(t: Tables) -> DataFrame:
    return t.sql(ATTEMPTS).select("event_id", I.http_error(F.col("http_status")).alias("e")).select("event_id", "e.code", "e.retryable")


@query(f"SELECT event_id, CASE WHEN http_status = 200 THEN 'success' WHEN http_status IN (403,429) OR http_status >= 500 THEN 'retryable_failure' WHEN event_id % 2 = 0 THEN 'blocked' ELSE 'permanent_failure' END AS status FROM ({ATTEMPTS})")
def e15_attempt_status(t: Tables) -> DataFrame:
    a = t.sql(ATTEMPTS)
    return a.select("event_id", I.attempt_status(F.col("http_status") == 200, I.http_error(F.col("http_status"))["retryable"], F.when(F.col("event_id") % 2 == 0, "blocked").otherwise("valid")).alias("status"))


@query("SELECT event_id, least(pow(2, event_id % 6), 4)::BIGINT AS seconds FROM events")
def e16_backoff_seconds(t: Tables) -> DataFrame:
    return t.events.select("event_id", I.backoff_seconds(F.col("event_id") % 6 + 1).alias("seconds"))


STATES = "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'waiting-file' WHEN 1 THEN 'pending' WHEN 2 THEN 'running' WHEN 3 THEN 'converting' WHEN 4 THEN 'done' WHEN 5 THEN 'failed' ELSE 'mystery' END AS remote FROM {orders}"


@query(f"SELECT o_orderkey, CASE remote WHEN 'waiting-file' THEN 'uploading' WHEN 'pending' THEN 'submitted' WHEN 'running' THEN 'polling' WHEN 'converting' THEN 'polling' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' END AS state, remote = 'mystery' AS rejected FROM ({STATES})")
def e17_remote_state(t: Tables) -> DataFrame:
    s = t.sql(STATES).select("o_orderkey", I.remote_state(F.col("remote")).alias("state"))
    return s.withColumn("rejected", F.col("state").isNull())


DATES = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(1700000000 + event_id AS STRING) WHEN 1 THEN CAST(1700000000000 + event_id * 1000 AS STRING) WHEN 2 THEN concat('2024-0', CAST(1 + event_id % 9 AS STRING), '-15T08:30:00') WHEN 3 THEN concat('2023年', CAST(1 + event_id % 12 AS STRING), '月', CAST(1 + event_id % 28 AS STRING), '日 13:51')
 WHEN 4 THEN concat('2022/', CAST(1 + event_id % 12 AS STRING), '/', CAST(1 + event_id % 28 AS STRING)) WHEN 5 THEN '2024-3-5 8:30' WHEN 6 THEN 'yesterday' ELSE '' END AS v FROM {events}"""
_DAY = "(20\\d{2})[-/年](0?[1-9]|1[0-2])[-/月](0?[1-9]|[12]\\d|3[01])"
_D1, _D2 = _DAY + "[T\\s](\\d{1,2}:\\d{2}(?::\\d{2})?)", _DAY + "[日\\s]*(\\d{1,2}:\\d{2}(?::\\d{2})?)?"
_DATED = " ".join(
    f"WHEN regexp_matches(v, '{p}') THEN regexp_extract(v, '{p}', 1) || '-' || lpad(regexp_extract(v, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract(v, '{p}', 3), 2, '0') || ' ' || CASE length(regexp_extract(v, '{p}', 4)) WHEN 0 THEN '00:00:00' WHEN 5 THEN regexp_extract(v, '{p}', 4) || ':00' ELSE regexp_extract(v, '{p}', 4) END"
    for p in (_D1, _D2)
)


@query(f"""SELECT event_id, CASE WHEN regexp_full_match(v, '\\d+') THEN strftime(make_timestamp(CAST((CASE WHEN v::BIGINT > 100000000000 THEN v::BIGINT / 1000 ELSE v::BIGINT END + 8 * 3600) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') {_DATED} END AS parsed FROM ({DATES})""")
def e18_parse_datetime(t: Tables) -> DataFrame:
    return t.sql(DATES).select("event_id", X.parse_datetime(F.col("v")).alias("parsed"))


DATED_URLS = "SELECT page_id, concat(url, CASE page_id % 4 WHEN 0 THEN '/2024-3-07/x' WHEN 1 THEN '/2023/11/5' WHEN 2 THEN '/20220131/' ELSE '' END) AS u FROM {pages}"
_L, _C = "/(20\\d{2})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\\d|3[01])", "/(20\\d{2})(0[1-9]|1[0-2])([0-3]\\d)/"


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(u, '{p}') THEN regexp_extract(u, '{p}', 1) || '-' || lpad(regexp_extract(u, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract(u, '{p}', 3), 2, '0') || ' 00:00:00'" for p in (_L, _C)) + f" END AS published FROM ({DATED_URLS})")
def e19_date_from_url(t: Tables) -> DataFrame:
    return t.sql(DATED_URLS).select("page_id", U.date_from_url(F.col("u")).alias("published"))


@query("SELECT doc_id, replace(replace(replace(replace(text, chr(10), chr(13) || chr(10)), '. ', '.' || chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def e20_normalize_newlines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalize_newlines(F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit(". "), F.lit(".\r"))).alias("text"))


MARKED = "SELECT doc_id, text, concat(CASE WHEN doc_id % 4 = 0 THEN substring(text, 1, 150) ELSE text END, CASE doc_id % 3 WHEN 0 THEN ' {{{{name}}}}' WHEN 1 THEN ' NaN-NaN-NaN' ELSE '' END) AS md FROM {documents}".replace("{{{{name}}}}", "{{name}}")
_MARKED_SPARK = MARKED.replace("{{name}}", "{{{{name}}}}")


@query(f"SELECT doc_id, concat_ws(',', CASE WHEN length(regexp_replace(md, '^\\s+|\\s+$', '', 'g')) < 200 THEN 'CONTENT_TOO_SHORT' END, CASE WHEN contains(md, '{{{{name}}}}') OR contains(md, 'NaN-NaN-NaN') THEN 'UNRENDERED_TEMPLATE' END) AS warnings FROM ({MARKED})")
def e21_quality_warnings(t: Tables) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, " {{name}}").when(F.col("doc_id") % 3 == 1, " NaN-NaN-NaN").otherwise("")
    d = t.documents.select("doc_id", F.concat(F.when(F.col("doc_id") % 4 == 0, F.substring("text", 1, 150)).otherwise(F.col("text")), tail).alias("md"))
    return d.select("doc_id", F.array_join(X.quality_warnings(F.col("md")), ",").alias("warnings"))


HEADED = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('# ', substring(split_part(text, chr(10), 1), 1, 80), chr(10), text) WHEN 1 THEN concat('http://x', chr(10), '## Second ', CAST(doc_id AS STRING), chr(10), text) ELSE '> q' END AS md, CASE WHEN doc_id % 2 = 0 THEN '网页' ELSE concat(' name ', CAST(doc_id AS STRING)) END AS fallback FROM {documents}"


@query(f"""WITH l AS (SELECT doc_id, fallback, list_transform(string_split(md, chr(10)), lambda x: trim(x)) AS lines FROM ({HEADED})), h AS (
 SELECT doc_id, fallback, list_filter(list_transform(list_filter(lines, lambda x: x LIKE '# %'), lambda x: trim(x[3:])), lambda x: length(x) > 2) AS h,
 list_filter(list_transform(lines[1:5], lambda x: trim(regexp_replace(regexp_replace(x, '^#+', ''), '^\\*+|\\*+$', '', 'g'))), lambda x: length(x) BETWEEN 3 AND 120 AND x NOT LIKE 'http%' AND x NOT LIKE '![%' AND x NOT LIKE '>%') AS p FROM l)
 SELECT doc_id, coalesce(h[1], p[1], CASE WHEN fallback <> '网页' THEN trim(fallback) END) AS title FROM h""")
def e22_md_title(t: Tables) -> DataFrame:
    return t.sql(HEADED).select("doc_id", X.md_title(F.col("md"), F.col("fallback")).alias("title"))


@query(f"""SELECT doc_id, coalesce(CASE doc_id % 4 WHEN 0 THEN 'Quoted ' || doc_id END, nullif(trim(regexp_extract(md, '(?m)^#\\s+(.{{2,150}})$', 1)), '')) AS title FROM ({HEADED.replace('{documents}', 'documents')})""")
def e23_display_title(t: Tables) -> DataFrame:
    meta = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('"Quoted '), F.col("doc_id"), F.lit('"'))).when(F.col("doc_id") % 4 == 1, "null")
    return t.sql(HEADED).select("doc_id", X.display_title(meta, F.col("md")).alias("title"))


@query("SELECT doc_id, 'ev-' || sha256(text) || '-' || substring(sha256(source), 1, 12) AS evidence_id FROM documents")
def e24_evidence_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", I.evidence_id(F.sha2("text", 256), F.sha2("source", 256)).alias("evidence_id"))


@query("SELECT doc_id, sha256('1.1.0:{\"is_ocr\":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || ',\"language\":\"' || lang || '\",\"variant\":\"local\"}') AS fingerprint FROM documents")
def e25_pipeline_fingerprint(t: Tables) -> DataFrame:
    options = [(F.col("doc_id") % 2 == 0).alias("is_ocr"), F.col("lang").alias("language"), F.lit("local").alias("variant")]
    return t.documents.select("doc_id", I.pipeline_fingerprint(options).alias("fingerprint"))


@query(f"SELECT page_id, CASE WHEN c IN ('pdf','word') THEN 'document' WHEN c = 'web_page' AND page_id % 2 = 0 AND page_id % 3 = 0 THEN 'llm' ELSE 'local' END AS variant FROM (SELECT page_id, {_CLASS} AS c FROM ({TYPED}))")
def e26_pipeline_variant(t: Tables) -> DataFrame:
    return t.sql(TYPED).select("page_id", I.pipeline_variant(U.classify_url(F.col("u")), F.col("page_id") % 3 == 0, F.col("page_id") % 2 == 0).alias("variant"))


@query("SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 3 = 0 AS allowed, CASE WHEN doc_id % 5 = 0 THEN 'sensitive source' WHEN doc_id % 3 <> 0 THEN 'external processing not allowed' END AS reason FROM documents")
def e27_egress_policy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", I.egress_policy(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0).alias("p")).select("doc_id", "p.*")


@query("SELECT doc_id, substring(regexp_replace(regexp_replace(text, '(?i)(authorization|token|seed)\\s*[:=]\\s*[^\\s,;]+', '\\1=[redacted]', 'g'), '(https://[^\\s?]+)\\?[^\\s]+', '\\1?[redacted]', 'g'), 1, 1000) AS message FROM documents")
def e28_redact_message(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.redact_message(F.col("text")).alias("message"))


@query("SELECT doc_id, 'language=' || lang || ',page_ranges=' || source AS kept FROM documents")
def e29_safe_options(t: Tables) -> DataFrame:
    names = ("API_TOKEN", "language", "my_token", "page_ranges", "Result_URL", "other_url", "seed")
    values = (F.col("text"), F.col("lang"), F.col("text"), F.col("source"), F.col("text"), F.col("text"), F.col("text"))
    options = F.create_map(*(x for n, v in zip(names, values, strict=True) for x in (F.lit(n), v)))
    kept = X.safe_options(options)
    return t.documents.select("doc_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


OPTION_PATHS = "SELECT doc_id, concat('a.', CASE doc_id % 5 WHEN 0 THEN 'Token' WHEN 1 THEN 'x_url.b' WHEN 2 THEN 'language' WHEN 3 THEN 'tokens.seed' ELSE 'pages' END) AS path, lang AS value FROM {documents}"


@query(f"SELECT doc_id, path, value FROM ({OPTION_PATHS}) WHERE path IN ('a.language', 'a.pages')")
def e29_safe_option_rows(t: Tables) -> DataFrame:
    return t.sql(OPTION_PATHS).where(X.safe_option_rows(F.col("path")))


IMAGED = "SELECT doc_id, concat('![a](images/', CAST(doc_id AS STRING), '.png) <IMG alt=\"x\" src=\"images/b.png\"> ', text) AS md FROM {documents}"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(md, '(\\]\\()images/', '\\1assets/', 'g'), '(<img\\s+[^>]*src=[\"''])images/', '\\1assets/', 'gi') AS md FROM ({IMAGED})")
def e30_rewrite_image_paths(t: Tables) -> DataFrame:
    return t.sql(IMAGED).select("doc_id", X.rewrite_image_paths(F.col("md")).alias("md"))


@query("SELECT doc_id, nullif(substring(trim(regexp_replace(trim('  ##' || lang || ' ' || substring(text, 1, 90) || ' '), '^#+', '')), 1, 64), '') AS tag FROM documents")
def e32_clean_tag(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("  ##"), F.col("lang"), F.lit(" "), F.substring("text", 1, 90), F.lit(" "))
    return t.documents.select("doc_id", X.clean_tag(raw).alias("tag"))


@query("SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents")
def e33_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.fold(F.col("text")).alias("folded"))


@query("""SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || trim(regexp_replace(substring(text, s + 1, e - s), '\\s+', ' ', 'g')) || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet
 FROM (SELECT doc_id, text, greatest(0, p - 60) AS s, least(length(text), p + 60) AS e FROM (SELECT doc_id, text, least(length(text), doc_id % 700) AS p FROM documents))""")
def e34_snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.snippet(F.col("text"), F.least(F.length("text"), F.col("doc_id") % 700).cast("int")).alias("snippet"))


ANSWERS = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('<think>', substring(text, 1, 30), chr(10), '</think> ', text) WHEN 1 THEN concat('```markdown', chr(10), text, chr(10), '```') WHEN 2 THEN concat('```', chr(10), text, '```') ELSE substring(text, 1, 30) END AS answer FROM {conversations} WHERE role = 'assistant'"
_CLEANED = "regexp_replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), '(?s)<think>.*?</think>', '', 'g')"


@query(f"""WITH a AS (SELECT conv_id, turn, regexp_replace({_CLEANED}, '^\\s+|\\s+$', '', 'g') AS t FROM ({ANSWERS})), b AS (SELECT conv_id, turn, regexp_replace(CASE WHEN t LIKE '```markdown%' THEN regexp_replace(t[12:], '```$', '') WHEN t LIKE '```%' THEN regexp_replace(t[4:], '```$', '') ELSE t END, '^\\s+|\\s+$', '', 'g') AS t FROM a)
 SELECT conv_id, turn, CASE WHEN length(t) >= 50 THEN t || chr(10) END AS markdown FROM b""")
def e35_clean_model_output(t: Tables) -> DataFrame:
    return t.sql(ANSWERS).select("conv_id", "turn", X.clean_model_output(F.col("answer")).alias("markdown"))


OCR = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat('```', chr(10), text, '```') WHEN 1 THEN '图中无文字内容。' ELSE substring(text, 1, 9 + conv_id % 3) END AS answer FROM {conversations}"


@query(f"""SELECT conv_id, turn, CASE WHEN NOT contains(a, '无文字内容') AND length(a) >= 10 THEN regexp_replace(CASE WHEN a LIKE '```%' THEN regexp_replace(a[4:], '```$', '') ELSE a END, '^\\s+|\\s+$', '', 'g') END AS text FROM (SELECT conv_id, turn, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS a FROM ({OCR}))""")
def e36_clean_ocr_output(t: Tables) -> DataFrame:
    return t.sql(OCR).select("conv_id", "turn", X.clean_ocr_output(F.col("answer")).alias("text"))


TEMPLATE = "Return the text. {other} Text:\n{content}\nEnd."


@query(f"SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 40 THEN replace('{TEMPLATE}', '{{content}}', substring(text, 1, 30000)) END AS prompt FROM documents")
def e37_build_prompts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.build_prompt(TEMPLATE, F.col("text")).alias("prompt"))


_ADDRESS = "regexp_extract(text, '\\b(\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3})\\b', 1)"
_NUM = "list_sum(list_transform(string_split(ip, '.'), lambda x, i: x::BIGINT << (8 * (4 - i))))"


@query(f"""WITH a AS (SELECT doc_id, {_ADDRESS} AS ip FROM documents UNION ALL SELECT doc_id, concat_ws('.', doc_id % 256, doc_id * 7 % 256, doc_id % 3, 1) FROM documents), b AS (SELECT doc_id, ip FROM a WHERE ip <> ''),
 r(lo, hi) AS (VALUES {", ".join(f"('{a}','{b}')" for a, b in U.RESERVED)}), n AS (SELECT doc_id, ip, CASE WHEN list_max(list_transform(string_split(ip, '.'), lambda x: x::INT)) <= 255 AND NOT regexp_matches(ip, '(^|\\.)0\\d') THEN {_NUM} END AS n FROM b),
 x AS (SELECT {_NUM.replace('ip', 'lo')} AS lo, {_NUM.replace('ip', 'hi')} AS hi FROM r)
 SELECT doc_id, ip, n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM x WHERE n BETWEEN lo AND hi) AS is_public FROM n""")
def e38_is_public_ipv4(t: Tables) -> DataFrame:
    found = t.documents.select("doc_id", F.regexp_extract("text", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", 1).alias("ip"))
    d = F.col("doc_id")
    made = t.documents.select("doc_id", F.concat_ws(".", d % 256, d * 7 % 256, d % 3, F.lit(1)).alias("ip"))
    return found.unionAll(made).where("ip <> ''").select("doc_id", "ip", U.is_public_ipv4(F.col("ip")).alias("is_public"))


@query(f"SELECT page_id, u AS url FROM ({_PLAIN_URLS}) WHERE {_SCHEME} = 'https' AND ({_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' OR {_HOST} LIKE '%.theron.example.net' OR {_HOST} = 'theron.example.net')")
def e39_host_allowed(t: Tables) -> DataFrame:
    allow = t.spark.createDataFrame([("example.org",), ("theron.example.net",)], "domain string")
    return U.allowed_hosts(t.pages.select("page_id", "url"), "url", allow)


INPUTS = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'text' WHEN 2 THEN 'file' ELSE 'other' END AS kind, CASE WHEN page_id % 8 = 0 THEN url END AS u, CASE WHEN page_id % 3 = 0 THEN '  ' ELSE url END AS txt, page_id % 3 AS size FROM {pages}"


@query(f"SELECT page_id, CASE WHEN kind = 'other' THEN 'unknown kind' WHEN kind = 'url' AND coalesce(u, '') = '' THEN 'url missing' WHEN kind = 'text' AND trim(coalesce(txt, '')) = '' THEN 'text missing' WHEN kind = 'file' AND size <= 0 THEN 'file missing' END AS error FROM ({INPUTS})")
def e40_input_valid(t: Tables) -> DataFrame:
    return t.sql(INPUTS).select("page_id", I.input_error(F.col("kind"), F.col("u"), F.col("txt"), F.col("size")).alias("error"))


@query(f"SELECT page_id, 'url' AS kind, {_NORMAL} AS source_key, {_CLASS} AS resource_type, sha256({_CLASS} || ':' || {_NORMAL}) AS resource_key FROM ({_PLAIN_URLS})")
def s1_read_captures(t: Tables) -> DataFrame:
    from evidencelake.sources.readers import captures

    return captures(t.pages).select("page_id", "kind", "source_key", "resource_type", "resource_key")


@query("SELECT doc_id, 'text' AS kind, source AS source_key, 'text' AS resource_type, 'pasted_text' AS role, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes FROM documents WHERE trim(text) <> ''")
def s2_read_pasted(t: Tables) -> DataFrame:
    from evidencelake.sources.readers import pasted

    return pasted(t.documents.withColumnRenamed("source", "source_key")).select("doc_id", "kind", "source_key", "resource_type", "role", "sha256", "size_bytes")


@query("SELECT line_no, trim(line) AS url FROM (SELECT page_id AS line_no, CASE WHEN page_id % 5 = 0 THEN '   ' ELSE ' ' || url || ' ' END AS line FROM pages) WHERE trim(line) <> ''")
def s4_read_url_list(t: Tables) -> DataFrame:
    from evidencelake.sources.readers import url_lines

    lines = t.pages.select(F.col("page_id").alias("line_no"), F.when(F.col("page_id") % 5 == 0, "   ").otherwise(F.concat(F.lit(" "), "url", F.lit(" "))).alias("line"))
    return url_lines(lines)
