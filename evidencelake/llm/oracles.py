"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from evidencelake.llm.url_filter import FRACTION_TERMS, MOST_EVIDENCE, RULES, SUFFIXES, SURE

#: Exact near-duplicate classes: all shingle sets, all pairs that share a shingle, reachability by recursion.
OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w
), c AS (
  SELECT list_sort(s) AS s, min(doc_id) AS id, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)
), e AS (SELECT id, n, unnest(s) AS g FROM c
), p AS (
  SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id
), l AS (SELECT a, b FROM p WHERE 100 * common >= 85 * (na + nb - common)
), edge AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r(id, x) AS (SELECT id, id FROM c UNION SELECT r.id, edge.b FROM r JOIN edge ON r.x = edge.a
), k AS (SELECT id, min(x) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, coalesce(k.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s AND len(s.s) > 0 LEFT JOIN k ON c.id = k.id
"""

#: The pages of the tables have one article each, so its blocks can be cut out by expressions.
OP4 = r"""
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (
  SELECT page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(replace(replace(regexp_replace(b, '(?s)<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text
  FROM pages)
"""


def _level(name: str, children: str, parent: str, prior: str) -> str:
    return f"""{name}_base AS (SELECT c.*, p.alpha / (p.alpha + p.beta) AS mean, p.alpha + p.beta AS surety FROM {children} c JOIN {prior} p USING ({parent})),
{name}_spread AS (SELECT sum((bad - n * mean) ** 2 / (n * mean * (1 - mean))) AS chi, count(*) AS k, sum(n - 1) AS extra FROM {name}_base WHERE n > 0),
{name}_rho AS (SELECT CASE WHEN coalesce(extra, 0) = 0 THEN 0.5::DOUBLE ELSE least(0.5::DOUBLE, greatest(0.001::DOUBLE, (chi - k) / extra)) END AS rho FROM {name}_spread),
{name} AS (SELECT b.* EXCLUDE (mean, surety), least(1 / rho - 1, surety) * mean + bad AS alpha, least(1 / rho - 1, surety) * (1 - mean) + n - bad AS beta FROM {name}_base b, {name}_rho)"""


OP6 = f"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, q, v) AS (VALUES {", ".join(str(x) for x in RULES)}),
j AS (SELECT p.*, h || q AS rule, v FROM p LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST) = 1),
js AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', '') AS site FROM j),
o AS (SELECT site AS host, count(rule) AS n, count(*) FILTER (WHERE v = 'block') AS bad FROM js GROUP BY site),
hx AS (SELECT *, string_split(host, '.') AS part FROM o),
hp AS (SELECT *, CASE WHEN len(part) > 2 AND array_to_string(part[-2:], '.') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) THEN 2 ELSE 1 END AS k FROM hx),
h AS (SELECT host, n, bad, array_to_string(part[-k:], '.') AS suffix, array_to_string(part[-k - 1:], '.') AS domain FROM hp),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, 0 AS root, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY ALL),
top AS (SELECT 0 AS root, sum(bad) + 0.5 AS alpha, sum(n) - sum(bad) + 0.5 AS beta FROM s),
{_level("sl", "s", "root", "top")}, {_level("dl", "d", "suffix", "sl")}, {_level("hl", "h", "domain", "dl")},
c AS (SELECT host, alpha * least(1, {MOST_EVIDENCE} / (alpha + beta)) AS al, beta * least(1, {MOST_EVIDENCE} / (alpha + beta)) AS be FROM hl),
f AS (SELECT host, al, be, 0.5 > (al + 1) / (al + be + 2) AS flip, CASE WHEN flip THEN be ELSE al END AS a, CASE WHEN flip THEN al ELSE be END AS b FROM c),
t AS (SELECT *, exp((a + b) * ln(0.5) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({FRACTION_TERMS}, 0, -1), lambda i: i::DOUBLE)),
  lambda r, i: 1 + (CASE WHEN i % 2 = 0 THEN floor(i / 2) * (b - floor(i / 2)) * 0.5 / ((a + i - 1) * (a + i))
    ELSE -(a + floor(i / 2)) * (a + b + floor(i / 2)) * 0.5 / ((a + i - 1) * (a + i)) END) / r) AS tail FROM f),
u AS (SELECT host AS site, CASE WHEN flip THEN tail ELSE 1 - tail END AS chance FROM t)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN chance >= {SURE} THEN 'block' ELSE 'allow' END) AS verdict FROM js LEFT JOIN u USING (site)
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of ASCII characters, bit by bit."""
    characters = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substring({text}, i, 1))::BIGINT)"
    byte = "list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)), xor(c, x))"
    return f"xor(list_reduce({characters}, lambda c, x: {byte}, 4294967295::BIGINT), 4294967295)"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


#: Every run of words of every document that is as long as some window, against all windows.
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_words("text")} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS win FROM (SELECT *, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS win FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM v))),
f AS (SELECT x.*, item_id FROM x JOIN v USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM f) GROUP BY r),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)
"""

#: Every level of every tree, and every leaf's walk to the root, by recursion.
OP12 = f"""
WITH RECURSIVE k AS (SELECT *, doc_id::VARCHAR AS t FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM
  (SELECT doc_id, lang, {_leaf("n_chars")} AS h, CASE WHEN {_crc32("t")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS r FROM k)),
t AS (SELECT lang, 0 AS lvl, idx, h, count(*) OVER (PARTITION BY lang) AS n FROM l
  UNION ALL SELECT lang, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, idx // 2, n),
s AS (SELECT lang, lvl, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, idx, h, count(*) OVER () AS n FROM s
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, idx // 2, n),
w AS (SELECT doc_id, lang, h AS leaf, 0 AS lvl, idx, r AS cur, '' AS proof FROM l
  UNION ALL SELECT w.doc_id, w.lang, leaf, w.lvl + 1, w.idx // 2, sha256(CASE WHEN t.h IS NULL THEN cur WHEN w.idx % 2 = 0 THEN cur || t.h ELSE t.h || cur END), proof || coalesce(t.h, '')
  FROM w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang AND w.lvl < s.lvl LEFT JOIN t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND t.idx = xor(w.idx, 1)),
v AS (SELECT w.doc_id, leaf, s.h AS subroot, 0 AS lvl, s.idx, cur, proof FROM w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl
  UNION ALL SELECT doc_id, leaf, subroot, v.lvl + 1, v.idx // 2, sha256(CASE WHEN u.h IS NULL THEN cur WHEN v.idx % 2 = 0 THEN cur || u.h ELSE u.h || cur END), proof || coalesce(u.h, '')
  FROM v LEFT JOIN u ON u.lvl = v.lvl AND u.idx = xor(v.idx, 1) WHERE v.lvl < (SELECT max(lvl) FROM u))
SELECT doc_id, leaf, subroot, u.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = u.h AS verified FROM v JOIN u ON u.n = 1 AND v.lvl = u.lvl
"""

#: All prefixes as lists of turns, each met with all that begin with it.
OP13 = f"""
WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
k AS (SELECT conv_id, {_crc32("t")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS t FROM c)),
o AS (SELECT k.conv_id, 0 AS part, b.place, b.role, b.text FROM k JOIN c b ON b.conv_id = k.base AND b.place <= k.h
  UNION ALL SELECT k.conv_id, 1, c.place, c.role, c.text FROM k JOIN c USING (conv_id) WHERE c.place > k.h),
r AS (SELECT k.conv_id, coalesce(list({{'r': o.role, 't': o.text}} ORDER BY o.part, o.place) FILTER (o.conv_id IS NOT NULL), []) AS s FROM k LEFT JOIN o USING (conv_id) GROUP BY k.conv_id),
e AS (SELECT s AS key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM r GROUP BY s),
p AS (SELECT conv_id, d AS depth, s[1:d] AS key FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  CASE WHEN depth > 0 THEN len(list_filter(regexp_split_to_array(key[depth].t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) ELSE 0 END AS w FROM p GROUP BY key, depth),
h AS (SELECT key[1:depth - 1] AS key, count(*) AS children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN h USING (key)),
b AS (SELECT key[1:a] AS key, count(*) FILTER (children = 0) AS leaves, sum((n_convs - 1) * w)::BIGINT AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM m) GROUP BY key[1:a])
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.children AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN b USING (key) LEFT JOIN e USING (key) LEFT JOIN m q ON m.depth > 0 AND q.key = m.key[1:m.depth - 1]
"""

ORACLES = {"op1_minhash_near_dedup": OP1, "op4_html_extraction": OP4, "op6_url_filter": OP6, "op11_decontamination": OP11, "op12_merkle_manifest": OP12, "op13_prefix_trie": OP13}
