"""Queries of search and tags, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.operators import gram_index as G
from evidencelake.operators import search as S
from evidencelake.plans.registry import Tables, query
from evidencelake.tables import new_path

EVIDENCE = "SELECT concat('ev', CAST(doc_id AS STRING)) AS evidence_id, doc_id AS created_at, CASE WHEN doc_id % 3 = 0 THEN concat('# Title ', CAST(doc_id AS STRING), chr(10), text) ELSE text END AS markdown, CAST(NULL AS STRING) AS meta_title, CASE WHEN doc_id % 7 = 0 THEN 'partial' ELSE 'success' END AS status FROM {documents}"
TAGS = "SELECT concat('ev', CAST(l.doc_id AS STRING)) AS evidence_id, 'quality' AS tag FROM {labels} l WHERE quality = 1 UNION ALL SELECT concat('ev', CAST(l.doc_id AS STRING)), 'toxic' FROM {labels} l WHERE toxic = 1 UNION ALL SELECT concat('ev', CAST(l.doc_id AS STRING)), d.lang FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"
_TITLE = "coalesce(nullif(trim(regexp_extract(markdown, '(?m)^#\\s+(.{2,150})$', 1)), ''), evidence_id)"


def _snip(token: str) -> str:
    p = f"(strpos(f, {token}) - 1)"
    s, e = f"greatest(0, {p} - 60)", f"least(length(markdown), {p} + 60)"
    return f"CASE WHEN {s} > 0 THEN '…' ELSE '' END || trim(regexp_replace(substring(markdown, {s} + 1, {e} - {s}), '\\s+', ' ', 'g')) || CASE WHEN {e} < length(markdown) THEN '…' ELSE '' END"


_FOLDED = f"SELECT *, replace(lower(markdown), 'ß', 'ss') AS f FROM ({EVIDENCE})"


@query(f"SELECT evidence_id, {_TITLE} AS title, {_snip(chr(39) + 'the' + chr(39))} AS snippet, created_at FROM ({_FOLDED}) WHERE contains(f, 'the') AND contains(f, 'ing') ORDER BY created_at DESC LIMIT 30")
def t1_search(t: Tables) -> DataFrame:
    return S.search(t.sql(EVIDENCE), "The ING")


@query(f"SELECT evidence_id, {_TITLE} AS title, {_snip(chr(39) + 'the' + chr(39))} AS snippet, created_at FROM ({_FOLDED}) WHERE contains(f, 'the') AND contains(f, 'ing') ORDER BY created_at DESC LIMIT 30")
def t1_search_indexed(t: Tables) -> DataFrame:
    """T1 by the n-gram index, made of two batches."""
    root, e = new_path(t.spark, "gram-index"), t.sql(EVIDENCE)
    for batch in (0, 1):
        G.append(e.where(F.col("created_at") % 2 == batch), root, batch)
    return G.search(t.spark, root, "The ING")


_EVERY = "SELECT DISTINCT lower(substring(text, 1 + doc_id % 40, 5 + doc_id % 3)) AS a, lower(substring(text, 61, 3)) AS b, doc_id FROM {documents}"


@query(f"""WITH q AS (SELECT doc_id AS query_id, list_distinct(list_filter(regexp_split_to_array(replace(a || ' ' || b, 'ß', 'ss'), '\\s+'), lambda x: x <> '')) AS asked FROM ({_EVERY})),
 h AS (SELECT query_id, evidence_id, created_at FROM q, ({_FOLDED}) e WHERE len(asked) > 0 AND len(list_filter(asked, lambda x: NOT contains(e.f, x))) = 0)
 SELECT query_id, evidence_id, created_at, (row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC))::INTEGER AS rank FROM h QUALIFY rank <= 5""")
def t2_saved_searches(t: Tables) -> DataFrame:
    """A saved search for every document, of pieces of its text, over all documents."""
    asked = t.sql(_EVERY).select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", "a", "b").alias("query"))
    return S.saved_searches(t.sql(EVIDENCE), asked, 5).select("query_id", "evidence_id", "created_at", "rank")


_Q = {1: ["the", "ing"], 2: ["der", "sch"], 3: ["licensed", "apache"], 4: ["strasse"]}


@query(" UNION ALL ".join(f"(SELECT {i} AS query_id, evidence_id, {_TITLE} AS title, {_snip(repr(q[0]))} AS snippet, created_at, (row_number() OVER (ORDER BY created_at DESC))::INTEGER AS rank FROM ({_FOLDED}) WHERE {' AND '.join(f'contains(f, {x!r})' for x in q)} QUALIFY rank <= 25)" for i, q in _Q.items()))
def t2_search_many(t: Tables) -> DataFrame:
    return S.search_many(t.sql(EVIDENCE), [(i, " ".join(q)) for i, q in _Q.items()], 25)


@query(f"SELECT evidence_id, {_TITLE} AS title, NULL::VARCHAR AS snippet, created_at FROM ({EVIDENCE}) WHERE evidence_id IN (SELECT evidence_id FROM ({TAGS}) WHERE tag = 'toxic') ORDER BY created_at DESC LIMIT 100")
def t3_browse_by_tag(t: Tables) -> DataFrame:
    return S.search(t.sql(EVIDENCE), "", t.sql(TAGS).where("tag = 'toxic'"), 100)


@query(f"""WITH h AS (SELECT evidence_id, created_at, status FROM ({_FOLDED}) WHERE contains(f, 'the') ORDER BY created_at DESC LIMIT 30)
 SELECT h.evidence_id, h.created_at, h.status, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags FROM h LEFT JOIN ({TAGS}) g ON g.evidence_id = h.evidence_id GROUP BY ALL""")
def t4_search_enriched(t: Tables) -> DataFrame:
    e = t.sql(EVIDENCE)
    return S.with_tags(S.search(e, "the"), t.sql(TAGS), e).select("evidence_id", "created_at", "status", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH u AS (SELECT evidence_id, substring(evidence_id, 3)::BIGINT AS n FROM ({EVIDENCE}) WHERE substring(evidence_id, 3)::BIGINT % 4 = 0)
 SELECT evidence_id, tag FROM ({TAGS}) WHERE evidence_id NOT IN (SELECT evidence_id FROM u) UNION ALL SELECT evidence_id, 'new tag' FROM u WHERE n % 8 <> 0 UNION ALL SELECT evidence_id, 'n' || n % 5 FROM u WHERE n % 8 <> 0""")
def t5_set_tags(t: Tables) -> DataFrame:
    n = F.substring("evidence_id", 3, 20).cast("long")
    u = t.sql(EVIDENCE).where(n % 4 == 0).select("evidence_id", F.when(n % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" new tag "), F.lit("#new tag"), F.concat(F.lit("##n"), (n % 5).cast("string")), F.lit(" # "))).alias("tags"))
    return S.set_tags(t.sql(TAGS), u)


@query(f"SELECT DISTINCT tag FROM ({TAGS}) WHERE tag <> 'toxic'")
def t6_prune_tags(t: Tables) -> DataFrame:
    return S.tag_names(t.sql(TAGS).where("tag <> 'toxic'"))


@query(f"SELECT tag, count(*) AS n FROM ({TAGS}) GROUP BY tag ORDER BY n DESC, tag LIMIT 4")
def t7_tag_counts(t: Tables) -> DataFrame:
    return S.tag_counts(t.sql(TAGS), 4)


@query(f"SELECT evidence_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM ({TAGS}) GROUP BY evidence_id")
def t8_tags_for(t: Tables) -> DataFrame:
    return S.tags_for(t.sql(TAGS)).select("evidence_id", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH e AS (SELECT * FROM ({EVIDENCE}) ORDER BY created_at DESC LIMIT 100) SELECT e.evidence_id, created_at, nullif(trim(regexp_extract(markdown, '(?m)^#\\s+(.{{2,150}})$', 1)), '') AS title, coalesce(string_agg(DISTINCT tag, ',' ORDER BY tag), '') AS tags FROM e LEFT JOIN ({TAGS}) g ON g.evidence_id = e.evidence_id GROUP BY e.evidence_id, created_at, markdown""")
def t9_list_evidence(t: Tables) -> DataFrame:
    return S.list_evidence(t.sql(EVIDENCE), t.sql(TAGS)).select("evidence_id", "created_at", "title", F.array_join("tags", ",").alias("tags"))


@query("SELECT page_id, page_id % 4 IN (1, 2) AS hidden FROM pages")
def t10_hidden_filter(t: Tables) -> DataFrame:
    p = F.col("page_id") % 4
    path = F.concat(F.lit("2024/01/"), F.when(p == 0, "x/content.md").when(p == 1, ".git/x").when(p == 2, "Staging/y").otherwise("staging2/y"))
    return t.pages.select("page_id", S.hidden(path).alias("hidden"))
