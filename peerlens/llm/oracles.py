"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER
from .license_rules import CLASSES
from .license_rules import RULES as LICENSE_RULES
from .quality import BITS, LEAST, POLICIES, RATIO, RULES, TOXIC
from .url_filter import RULES as URL_RULES

_SPACES = r"[\x20\x09-\x0D]+"


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({_lower(f"coalesce({x}, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


OP1 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
pos AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS s FROM d) CROSS JOIN (SELECT DISTINCT n FROM win) WHERE s + n - 1 <= len(w)),
hit AS (SELECT p.doc_id, p.s, p.n, win.item_id FROM pos p JOIN win ON p.n = win.n AND p.g = win.g),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(len(it.items), 0) AS n_items,
  sha256(coalesce(array_to_string(it.items, ','), '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

OP2 = f"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, {_lower("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(s.first_doc <> k.doc_id, false) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_RULE_SQL = " + ".join(f"(CASE WHEN {r.failed} THEN {1 << r.bit} ELSE 0 END)" for r in [*RULES, TOXIC])
OP4 = rf"""
WITH pw AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
ld AS (SELECT l.toxic = 1 AS toxic, list_distinct(ws) AS ws FROM pw JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL),
sz AS (SELECT count(*) FILTER (WHERE toxic) AS all_t, count(*) FILTER (WHERE NOT toxic) AS all_c FROM ld),
ew AS (SELECT w, count(*) FILTER (WHERE toxic) AS t, count(*) FILTER (WHERE NOT toxic) AS c FROM (SELECT toxic, unnest(ws) AS w FROM ld) GROUP BY w),
lex AS (SELECT w FROM ew CROSS JOIN sz WHERE t >= {LEAST} AND t * (all_c + 1) >= {RATIO} * (c + 0.5) * (all_t + 1)),
px AS (SELECT doc_id, count(*) AS n_plain, count(lex.w) AS n_toxic FROM (SELECT doc_id, unnest(ws) AS w FROM pw) x LEFT JOIN lex ON x.w = lex.w GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS s FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM (
    SELECT g.doc_id, unnest(range(g.s, g.s + 5)) AS x FROM g JOIN (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1) r ON g.doc_id = r.doc_id AND g.g = r.g)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '!!')) AS n_bangs,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(lines) AS n_lines, coalesce(px.n_plain, 0) AS n_plain, coalesce(px.n_toxic, 0) AS n_toxic
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN px ON d.doc_id = px.doc_id),
f AS (SELECT *, ({_RULE_SQL})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {POLICIES['base', 1].mask}) <> 0 AS base_failed,
  (failures & {POLICIES['clean', 3].mask}) = 0 AS kept, failures, n_bangs, n_upper, n_lines, n_plain, n_toxic FROM f
"""

_CLEAN = POLICIES["clean", 3]
_RULE_BITS = ", ".join(f"('{r}', {1 << BITS[r]}::BIGINT)" for r in _CLEAN.rules)
ABLATIONS = f"""
WITH led AS ({OP4}), r(rule, bit) AS (VALUES {_RULE_BITS}), m AS (SELECT failures & {_CLEAN.mask} AS m FROM led)
SELECT rule, count(*) FILTER (WHERE m & bit <> 0) AS n_failed, count(*) FILTER (WHERE m = bit) AS n_only, count(*) FILTER (WHERE m & ~bit = 0) AS n_kept_without, count(*) AS n_docs
FROM m CROSS JOIN r GROUP BY rule
"""

_URL_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP9 = f"""
WITH r(rhost, rpath, rverdict) AS (VALUES {_URL_RULES}),
u AS (
  SELECT page_id, coalesce({_lower("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (
  SELECT u.page_id, u.host, u.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM u LEFT JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM f
"""

_LICENSE_RULES = ", ".join(f"({r.order}, '{r.label}', {r.priority}, {CLASSES[r.kind]}::DOUBLE, '{r.gate}', '{r.spaced}')" for r in LICENSE_RULES)
#: Every word stands between two spaces of its own, so a text's pieces between matches consist of whole words, and half of their spaces is their number.
OP11 = f"""
WITH r(ord, label, prio, sure, gate, pat) AS (VALUES {_LICENSE_RULES}),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
c AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d),
gates AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(w) AS word FROM d) WHERE word IN (SELECT gate FROM r)),
g AS (
  SELECT c.doc_id, r.*, string_split_regex(t, pat) AS ps, regexp_extract_all(t, pat) AS ms
  FROM gates JOIN r ON gates.word = r.gate JOIN c ON c.doc_id = gates.doc_id),
e AS (SELECT doc_id, ord, label, prio, sure, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i FROM g WHERE len(ms) > 0),
n AS (SELECT *, (length(m) - length(replace(m, ' ', ''))) // 2 AS nm, (length(p) - length(replace(p, ' ', ''))) // 2 AS np FROM e),
h AS (SELECT *, (sum(np + nm) OVER (PARTITION BY doc_id, ord ORDER BY i))::BIGINT - nm AS a, (sum(np + nm) OVER (PARTITION BY doc_id, ord ORDER BY i))::BIGINT - 1 AS b FROM n),
s AS (
  SELECT h.* FROM h WHERE prio = 0 OR NOT EXISTS (
    SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.a <= h.a AND o.b >= h.b
      AND (o.prio < h.prio OR o.prio = h.prio AND (o.b - o.a > h.b - h.a OR o.b - o.a = h.b - h.a AND o.ord < h.ord)))),
x AS (
  SELECT doc_id, count(*) FILTER (WHERE prio = 0) AS n_base, min(a) FILTER (WHERE prio = 0) AS first_word, max(a) FILTER (WHERE prio = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE prio = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(sure) AS score, count(*) AS n_detections
  FROM s GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_detections, 0) AS n_detections
FROM d LEFT JOIN x ON d.doc_id = x.doc_id
"""



def _centroid_round(r: int) -> str:
    """One round: nearest centroid of each vector, then the floor of the means."""
    return f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, x, c AS cluster, d FROM (
    SELECT v.vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{r})
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(m.p, c{r}.p) AS p FROM c{r} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS p FROM (
      SELECT cluster, i, sum(e) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY cluster) m ON m.cluster = c{r}.c)"""


OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: coalesce(isfinite(e), false))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x AS p FROM v ORDER BY c LIMIT 8),
{", ".join(_centroid_round(r) for r in range(11))}
SELECT vec_id, cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c10.p, lambda e: e::VARCHAR), ',')) AS centroid_sha256
FROM a10 JOIN c10 ON a10.cluster = c10.c
"""

ORACLE = {"op1_decontaminate": OP1, "op2_line_dedup": OP2, "op4_quality_rules": OP4, "op9_url_filter": OP9, "quality_ablations": ABLATIONS, "op11_license_scan": OP11, "op13_centroids": OP13}
