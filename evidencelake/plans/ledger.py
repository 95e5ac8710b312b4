"""Queries of the ledger operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import identity as I
from evidencelake.operators import ledger as L
from evidencelake.plans.registry import Tables, query
from evidencelake.plans.scalar import _AUTH, _HOST, _NORMAL, _SCHEME, ATTEMPTS

BATCH = """SELECT page_id AS position, url FROM {pages} UNION ALL SELECT 1000000 + page_id, replace(replace(url, 'https://', 'HTTPS://'), 'http://', 'HTTP://') FROM {pages} WHERE page_id % 5 = 0
 UNION ALL SELECT 2000000 + page_id, concat('javascript:', url) FROM {pages} WHERE page_id % 7 = 0 UNION ALL SELECT 3000000 + page_id, '  ' FROM {pages} WHERE page_id % 11 = 0"""


@query(f"""WITH b AS (SELECT position, url AS u FROM ({BATCH})), c AS (SELECT position, u, CASE WHEN {_SCHEME} NOT IN ('http','https') THEN 'unsupported_scheme' WHEN {_HOST} = '' THEN 'no_host' WHEN contains({_AUTH}, '@') THEN 'embedded_credentials' END AS r, {_NORMAL} AS n FROM b WHERE trim(u) <> '')
 SELECT position, u AS url, CASE WHEN r IS NULL THEN n END AS normalized, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY r, n ORDER BY position) > 1 THEN 'duplicate_in_batch' END) AS reason FROM c""")
def l1_dedupe_batch(t: Tables) -> DataFrame:
    return L.dedupe_batch(t.sql(BATCH))


NEW = "SELECT doc_id, concat('k', CAST(doc_id % 200 AS STRING)) AS resource_key, doc_id % 9 = 0 AS force_refetch FROM {documents}"
HAVE = "SELECT concat('k', CAST(doc_id % 150 AS STRING)) AS resource_key, CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'partial' END AS status FROM {documents} WHERE doc_id % 4 = 0"


@query(f"SELECT doc_id, resource_key, force_refetch FROM ({NEW}) n WHERE force_refetch OR NOT EXISTS (SELECT 1 FROM ({HAVE}) h WHERE h.resource_key = n.resource_key AND status IN ('success','partial'))")
def l2_skip_existing(t: Tables) -> DataFrame:
    return L.skip_existing(t.sql(NEW), t.sql(HAVE))


ASSETS = "SELECT CAST(doc_id AS STRING) AS asset_id, source AS resource_key, sha256(text) AS sha256, doc_id * 60 AS fetched_at FROM {documents}"
ASSETS_SPARK = ASSETS.replace("sha256(text)", "sha2(text, 256)")
VERSIONS = f"""SELECT *, row_number() OVER w::INTEGER AS version_no, lag(asset_id) OVER w AS previous_asset_id, sha256 <> lag(sha256) OVER w AS changed_from_previous FROM ({ASSETS}) WINDOW w AS (PARTITION BY resource_key ORDER BY fetched_at, asset_id)"""
VERSIONS = VERSIONS.replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER")


def _versions(t: Tables) -> DataFrame:
    return L.assign_versions(t.sql(ASSETS_SPARK))


@query(VERSIONS)
def l3_assign_versions(t: Tables) -> DataFrame:
    return _versions(t)


@query(VERSIONS)
def l3_assign_versions_in_two_loads(t: Tables) -> DataFrame:
    """The same chains when the second half arrives later and only the latest rows are known."""
    new = t.sql(ASSETS_SPARK)
    middle = new.agg(F.floor(F.median("fetched_at")).alias("middle"))
    first = L.assign_versions(new.join(F.broadcast(middle), F.col("fetched_at") <= F.col("middle")).drop("middle"))  # one row
    second = L.assign_versions(new.join(F.broadcast(middle), F.col("fetched_at") > F.col("middle")).drop("middle"), L.latest_assets(first))
    return first.unionByName(second)


@query(f"SELECT * FROM ({VERSIONS}) QUALIFY row_number() OVER (PARTITION BY resource_key ORDER BY version_no DESC) = 1")
def l4_latest_asset(t: Tables) -> DataFrame:
    return L.latest_assets(_versions(t))


@query(f"SELECT *, (row_number() OVER (PARTITION BY resource_key ORDER BY version_no DESC) - 1)::INTEGER AS versions_after FROM ({VERSIONS}) WHERE resource_key IN ('src1', 'src3')")
def l5_version_history(t: Tables) -> DataFrame:
    return L.version_history(_versions(t), t.spark.createDataFrame([("src1",), ("src3",)], "resource_key string"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 3) THEN 'partial' ELSE 'success' END AS status FROM documents")
def l6_asset_status(t: Tables) -> DataFrame:
    d = F.col("doc_id") % 4
    warnings = F.when(d == 0, F.array()).when(d == 1, F.array(F.lit("child_image_failed"))).when(d == 2, F.array(F.lit("slow"))).otherwise(F.array(F.lit("slow"), F.lit("x_child_y")))
    return t.documents.select("doc_id", L.asset_status(warnings).alias("status"))


LOG = "SELECT user_id AS run_id, event_id AS seq, event_type AS state, event_id % 17 AS poll_count, CASE WHEN event_id % 3 = 0 THEN concat('r', CAST(event_id AS STRING)) END AS result_id FROM {events}"


@query(f"SELECT run_id, max(seq) AS seq, arg_max(state, seq) AS state, max(poll_count) AS poll_count, arg_max(result_id, CASE WHEN result_id IS NOT NULL THEN seq END) AS result_id FROM ({LOG}) GROUP BY run_id")
def l7_upsert_latest(t: Tables) -> DataFrame:
    return L.upsert_latest(t.sql(LOG), "run_id", "seq", ("poll_count",), ("result_id",))


RUNS = "SELECT o_orderkey AS run_id, o_custkey AS asset_id, concat('f', CAST(o_orderkey % 3 AS STRING)) AS pipeline_fingerprint, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'running' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'llm' ELSE 'local' END AS provider, CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at FROM {orders}"


@query(f"""WITH r AS (SELECT run_id, asset_id, pipeline_fingerprint, status FROM ({RUNS})), e AS (SELECT * FROM r WHERE run_id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY asset_id, pipeline_fingerprint ORDER BY run_id) = 1),
 n AS (SELECT * FROM r WHERE run_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY asset_id, pipeline_fingerprint ORDER BY run_id) = 1) SELECT * FROM e UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.asset_id = n.asset_id AND e.pipeline_fingerprint = n.pipeline_fingerprint)""")
def l8_insert_if_absent(t: Tables) -> DataFrame:
    r = t.sql(RUNS).select("run_id", "asset_id", "pipeline_fingerprint", "status")
    key = ["asset_id", "pipeline_fingerprint"]
    existing = L.insert_if_absent(r.where("run_id % 10 = 0"), r.where("false"), key, "run_id")
    return L.insert_if_absent(r.where("run_id % 10 <> 0"), existing, key, "run_id")


@query("SELECT doc_id AS asset_id, sha256(source) AS pipeline_fingerprint FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def l9_pending_ingestion(t: Tables) -> DataFrame:
    assets = t.documents.select(F.col("doc_id").alias("asset_id"), "source")
    evidence = t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("asset_id"), F.when(F.col("doc_id") % 2 == 1, F.sha2("source", 256)).otherwise("old").alias("pipeline_fingerprint"))
    return L.pending_ingestion(assets, evidence, F.sha2("source", 256)).select("asset_id", "pipeline_fingerprint")


TASKS = "SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' ELSE 'running' END AS status FROM {orders}"
TASK_ASSETS = "SELECT o_orderkey AS task_id, concat('a', CAST(o_orderkey AS STRING)) AS asset_id, CASE WHEN o_orderkey % 2 = 0 THEN 'partial' ELSE 'success' END AS acquisition_status FROM {orders} WHERE o_orderkey % 3 = 0"


@query(f"SELECT t.task_id, CASE WHEN t.status <> 'success' AND a.asset_id IS NOT NULL THEN a.acquisition_status ELSE t.status END AS status, CASE WHEN t.status <> 'success' THEN a.asset_id END AS asset_id FROM ({TASKS}) t LEFT JOIN ({TASK_ASSETS}) a ON t.task_id = a.task_id")
def l10_repair_tasks(t: Tables) -> DataFrame:
    return L.repair_tasks(t.sql(TASKS), t.sql(TASK_ASSETS))


CURRENT = "SELECT o_custkey AS asset_id, concat('f', CAST(o_custkey % 3 AS STRING)) AS pipeline_fingerprint FROM {orders} GROUP BY o_custkey"


@query(f"""SELECT r.run_id, r.asset_id, r.pipeline_fingerprint, r.provider, CASE WHEN d THEN 'failed' ELSE r.status END AS status, CASE WHEN d THEN 'PIPELINE_VARIANT_UNAVAILABLE' END AS error_code
 FROM (SELECT r.*, r.status IN ('pending','running') AND r.provider = 'llm' AND r.pipeline_fingerprint IS DISTINCT FROM c.pipeline_fingerprint AS d FROM ({RUNS}) r LEFT JOIN ({CURRENT}) c ON r.asset_id = c.asset_id) r""")
def l11_fail_drifted_runs(t: Tables) -> DataFrame:
    return L.fail_drifted_runs(t.sql(RUNS).drop("priority", "created_at"), t.sql(CURRENT)).select("run_id", "asset_id", "pipeline_fingerprint", "provider", "status", "error_code")


@query(f"SELECT run_id, status, priority FROM ({RUNS}) WHERE status <> 'success'")
def l12_recoverable(t: Tables) -> DataFrame:
    return L.recoverable(t.sql(RUNS), ("success", "failed"), [F.desc("priority"), F.col("created_at"), F.col("run_id")]).select("run_id", "status", "priority")


_OUT = f"SELECT event_id, user_id AS task_id, ts, http_status, http_status = 200 AS success, http_status IN (403,429) OR http_status >= 500 AS retryable, CASE WHEN http_status IN (403,404,429) THEN 'HTTP_' || http_status WHEN http_status >= 500 THEN 'HTTP_5XX' ELSE 'HTTP_ERROR' END AS code FROM ({ATTEMPTS})"


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS n FROM ({_OUT})), b AS (SELECT *, coalesce(max((success OR NOT retryable)::INT) OVER (PARTITION BY task_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM a WHERE n <= 3),
 c AS (SELECT task_id, count(*) AS attempts, arg_max(success, n) AS s, arg_max(code, n) AS code FROM b WHERE ended = 0 GROUP BY task_id) SELECT task_id, attempts, CASE WHEN s THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT s THEN code END AS error_code FROM c""")
def l13_attempt_outcome(t: Tables) -> DataFrame:
    e = I.http_error(F.col("http_status"))
    a = t.sql(ATTEMPTS).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("attempt_id"), F.col("ts").alias("attempt_at"), (F.col("http_status") == 200).alias("success"), e["retryable"].alias("retryable"), e["code"].alias("code"))
    return L.attempt_outcome(a)


@query("SELECT c.c_custkey AS task_id, string_agg(e.event_id || ':' || e.event_type, ',' ORDER BY e.ts, e.event_id) AS attempts FROM customer c LEFT JOIN events e ON e.user_id = c.c_custkey GROUP BY c.c_custkey")
def l14_attempts_of(t: Tables) -> DataFrame:
    attempts = t.events.select(F.col("user_id").alias("task_id"), F.col("ts").alias("attempt_at"), F.col("event_id").alias("attempt_id"), F.col("event_type").alias("status"))
    nested = L.attempts_of(t.customer.select(F.col("c_custkey").alias("task_id")), attempts)
    return nested.select("task_id", F.array_join(F.transform("attempts", lambda x: F.concat(x["attempt_id"].cast("string"), F.lit(":"), x["status"])), ",").alias("attempts"))


CAPTURES = "SELECT url AS resource_key, 0 AS tier, true AS success, page_id % 3 = 0 AS truncated FROM {pages} UNION ALL SELECT url, 1, page_id % 2 = 0, page_id % 12 = 0 FROM {pages} UNION ALL SELECT url, 2, page_id % 5 <> 0, false FROM {pages}"


@query(f"""WITH c AS ({CAPTURES}), n AS (SELECT resource_key FROM c WHERE tier = 0 AND truncated), t AS (SELECT * FROM c WHERE tier > 0 AND resource_key IN (SELECT resource_key FROM n)), b AS (SELECT resource_key, min(tier) AS best FROM t WHERE success AND NOT truncated GROUP BY ALL),
 w AS (SELECT t.resource_key, string_agg('upgrade_failed_tier_' || tier, ',' ORDER BY tier) AS warnings FROM t LEFT JOIN b USING (resource_key) WHERE (NOT success OR truncated) AND tier < coalesce(best, 9) GROUP BY ALL)
 SELECT c.*, coalesce(w.warnings, '') AS warnings, 1 AS version_no FROM c LEFT JOIN w USING (resource_key) WHERE tier = 0 UNION ALL SELECT t.*, '', 2 FROM t JOIN b ON t.resource_key = b.resource_key AND t.tier = b.best""")
def l15_select_upgrade(t: Tables) -> DataFrame:
    return L.select_upgrade(t.sql(CAPTURES))


@query("""WITH a AS (SELECT doc_id AS asset_id, doc_id AS fetched_at, unnest([sha256(text), sha256(source), sha256(lang)]) AS blob_id FROM documents) SELECT blob_id, max(asset_id) AS asset_id FROM a GROUP BY blob_id""")
def l16_find_blob(t: Tables) -> DataFrame:
    a = t.documents.select(F.col("doc_id").alias("asset_id"), F.col("doc_id").alias("fetched_at"), F.sha2("text", 256).alias("primary_blob"), F.array(F.sha2("text", 256), F.sha2("source", 256)).alias("blobs"), F.array(F.sha2("lang", 256)).alias("children"))
    return L.find_blobs(a)


@query("SELECT sha256, count(*) AS refs, min(doc_id) AS first_ref, max(size_bytes) AS size_bytes, ((count(*) - 1) * max(size_bytes))::BIGINT AS saved_bytes FROM (SELECT sha256(text) AS sha256, doc_id, octet_length(encode(text))::BIGINT AS size_bytes FROM documents) GROUP BY sha256")
def l17_blob_dedup(t: Tables) -> DataFrame:
    return L.blob_dedup(t.documents.select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("ref"), F.octet_length("text").cast("long").alias("size_bytes")))


ARTIFACTS = "SELECT concat('ev', CAST(doc_id AS STRING)) AS evidence_id, doc_id AS asset_id, 'content.md' AS logical_path, concat('m', CAST(doc_id AS STRING)) AS blob_id, CAST(NULL AS STRING) AS parent_blob_id FROM {documents} UNION ALL SELECT concat('ev', CAST(doc_id AS STRING)), doc_id, 'assets/img-001.png', concat('i', CAST(doc_id AS STRING)), concat('m', CAST(doc_id AS STRING)) FROM {documents} WHERE doc_id % 2 = 0"


@query(f"SELECT a.evidence_id, a.logical_path, a.blob_id, p.logical_path AS parent_path, CASE WHEN a.asset_id % 5 <> 0 THEN 'raw' || a.asset_id END AS raw_blob_id FROM ({ARTIFACTS}) a LEFT JOIN ({ARTIFACTS}) p ON a.evidence_id = p.evidence_id AND a.parent_blob_id = p.blob_id")
def l18_artifact_lineage(t: Tables) -> DataFrame:
    assets = t.documents.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("asset_id"), F.concat(F.lit("raw"), F.col("doc_id").cast("string")).alias("blob_id"))
    return L.artifact_lineage(t.sql(ARTIFACTS), assets)


_ARTS = "SELECT doc_id AS evidence_id, 0 AS pos, 'image' AS role, 'p' || doc_id % 3 AS path, sha256(text) AS sha256 FROM documents UNION ALL SELECT doc_id, 1, 'image', 'p' || doc_id % 2, sha256(source) FROM documents UNION ALL SELECT doc_id, 2, 'markdown', 'content.md', sha256(lang) FROM documents"


def _arts(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    one = lambda role, path, sha: F.struct(F.lit(role).alias("role"), path.alias("path"), sha.alias("sha256"))
    return t.documents.select(d.alias("evidence_id"), F.array(one("image", F.concat(F.lit("p"), (d % 3).cast("string")), F.sha2("text", 256)), one("image", F.concat(F.lit("p"), (d % 2).cast("string")), F.sha2("source", 256)), one("markdown", F.lit("content.md"), F.sha2("lang", 256))).alias("artifacts"))


@query(f"SELECT evidence_id, role, path, arg_max(sha256, pos) AS sha256 FROM ({_ARTS}) GROUP BY ALL")
def l19_explode_artifacts(t: Tables) -> DataFrame:
    return L.explode_artifacts(_arts(t))


@query(f"SELECT evidence_id, path, count(DISTINCT sha256) AS versions FROM ({_ARTS}) GROUP BY ALL HAVING count(DISTINCT sha256) > 1")
def l20_image_collisions(t: Tables) -> DataFrame:
    return L.image_collisions(_arts(t).select("evidence_id", F.inline("artifacts")))


@query("SELECT doc_id AS asset_id, CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id END AS url, doc_id % 3 = 0 AS force_refetch, CASE WHEN doc_id % 3 <> 0 THEN 'only URL assets can be fetched again' END AS reason FROM documents")
def l21_refetch_list(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    tasks = t.documents.select(d.alias("task_id"), F.when(d % 3 == 0, "url").otherwise("text").alias("kind"), F.concat(F.lit("u"), d.cast("string")).alias("url"))
    return L.refetch_list(t.documents.select(d.alias("asset_id"), d.alias("task_id")), tasks)


@query("SELECT doc_id AS archive_id, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'a/full.md' ELSE 'full.md' END END AS path FROM documents")
def l22_document_markdown(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    paths = F.array(F.when(d % 4 == 0, "notfull.md").when(d % 2 == 0, "a/full.md").otherwise("full.md"), F.lit("images/fig-1.png"), F.when(d % 4 == 0, "x.json").otherwise("z/full.md"))
    return L.document_markdown(t.documents.select(d.alias("archive_id"), F.explode(paths).alias("path")))


@query("SELECT sha256('raw_asset.created:' || doc_id) AS event_id, 'raw_asset.created' AS event_type, doc_id AS aggregate_id FROM documents")
def s10_emit_outbox(t: Tables) -> DataFrame:
    from evidencelake.sources.sinks import outbox_events

    return outbox_events(t.documents, "raw_asset.created", "doc_id")


@query("""SELECT page_id AS asset_id, 'original.html' AS path, 'h' || page_id AS blob_id FROM pages UNION ALL SELECT page_id, 'attachments/001-screenshot.png', 's' || page_id FROM pages
 UNION ALL SELECT page_id, 'images/image-' || lpad((i + 1)::VARCHAR, 3, '0') || '.jpg', 'i' || i FROM (SELECT page_id, unnest(range(page_id % 4)) AS i FROM pages)""")
def s11_asset_view_manifest(t: Tables) -> DataFrame:
    from evidencelake.sources.sinks import asset_view_manifest

    p = F.col("page_id").cast("string")
    blob = lambda role, mime, b: F.struct(F.lit(role).alias("role"), F.lit(mime).alias("mime_type"), F.concat(F.lit(b), p).alias("blob_id"))
    children = F.when(F.col("page_id") % 4 > 0, F.transform(F.sequence(F.lit(0), (F.col("page_id") % 4 - 1).cast("int")), lambda i: F.struct(F.lit("image/jpeg").alias("mime_type"), F.concat(F.lit("i"), i.cast("string")).alias("blob_id"))))
    return asset_view_manifest(t.pages.select(F.col("page_id").alias("asset_id"), F.lit("web_page").alias("resource_type"), F.array(blob("primary_html", "text/html", "h"), blob("screenshot", "image/png", "s")).alias("blobs"), children.alias("children")))


@query("SELECT doc_id AS evidence_id, CASE WHEN doc_id % 2 = 0 THEN 'assets/a.png,content.md' ELSE 'content.md' END AS paths FROM documents")
def s12_package_manifest(t: Tables) -> DataFrame:
    from evidencelake.sources.sinks import package_manifest

    d = F.col("doc_id")
    one = lambda role, path: F.struct(F.lit(role).alias("role"), F.lit(path).alias("logical_path"))
    rows = F.array_compact(F.array(one("markdown", "content.md"), one("diagnostic_archive", "raw.zip"), F.when(d % 2 == 0, one("image", "assets/a.png"))))
    return package_manifest(t.documents.select(d.alias("evidence_id"), F.inline(rows))).select("evidence_id", F.array_join("paths", ",").alias("paths"))
