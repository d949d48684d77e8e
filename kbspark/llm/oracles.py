"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from kbspark.llm.fingerprints import BELOW, HASH_DIGITS, SHINGLE_WORDS
from kbspark.llm.rules import BASE, RULES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 5"""


def secret_scan() -> str:
    parts, names = [], []
    for i, r in enumerate(RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        sums = "coalesce(list_sum(list_transform(p[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)"
        parts.append(f"""m{i} AS (SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {r.group}) AS g, string_split_regex(t, {pattern}) AS p FROM d WHERE regexp_matches(t, {pattern})),
s{i} AS (SELECT doc_id, {i} AS place, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {sums})) AS a, unnest(list_transform(m, lambda y: length(y))) AS n, unnest(list_transform(g, lambda y: length(y))) AS k FROM m{i})""")
        names.append(f"SELECT * FROM s{i} WHERE k >= {r.least}")
    line = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT)"
    agg = f"""SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, string_agg({line}, ',' ORDER BY a, place) FILTER (place < {len(BASE)}) AS base, string_agg({line}, ',' ORDER BY a, place) AS spans FROM ({" UNION ALL ".join(names)}) GROUP BY doc_id"""
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)}, x AS ({agg}) SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x ON x.doc_id = d.doc_id"


FINGERPRINTS = f"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS nx FROM documents),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 2) || substr(nx, 1, length(t) // 2) AS ed FROM n),
u AS (SELECT doc_id, 't' AS k, t AS x FROM e UNION ALL SELECT doc_id, 'e', ed FROM e UNION ALL SELECT doc_id, 'n', nx FROM e),
w AS (SELECT doc_id, k, list_filter(string_split_regex(translate(x, '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS w FROM u),
h AS (SELECT doc_id, k, CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1) + 1), lambda i: substr(md5(array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' ')), 1, {HASH_DIGITS})) END AS h FROM w),
f AS (SELECT doc_id, k, list_sort(list_distinct(list_filter(h, lambda y: y < '{BELOW}'))) AS b, list_min(h) AS least FROM h),
s AS (SELECT doc_id, k, CASE WHEN len(b) > 0 THEN b WHEN least IS NULL THEN [] ELSE [least] END AS s FROM f),
j AS (SELECT a.doc_id, a.s AS ts, b.s AS es, c.s AS ns FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.k = 'e' JOIN s c ON a.doc_id = c.doc_id AND c.k = 'n' WHERE a.k = 't')
SELECT e.doc_id, length(t) AS n_chars, sha256(ed) AS edited_sha256, array_to_string(ts, ',') AS fingerprint, array_to_string(es, ',') AS edited_fingerprint,
 CASE WHEN ts = es THEN 1.0 WHEN len(ts) = 0 OR len(es) = 0 THEN 0.0 ELSE len(list_intersect(ts, es)) / least(len(ts), len(es)) END AS near_edited,
 CASE WHEN ts = ns THEN 1.0 WHEN len(ts) = 0 OR len(ns) = 0 THEN 0.0 ELSE len(list_intersect(ts, ns)) / least(len(ts), len(ns)) END AS near_next FROM e JOIN j ON j.doc_id = e.doc_id"""

MIX = """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
r AS (SELECT *, md5('{"seed":7' || coalesce(',"doc_id":' || doc_id, '') || ',"size":' || size || '}') AS h, CAST(floor(16 * log2(size + 1.0::DOUBLE) + 1e-9::DOUBLE) AS INTEGER) AS class, greatest(64, count(*) OVER () // 320000) AS salts FROM d),
w AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
l AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM w WINDOW b AS (ORDER BY source_size * 2.0::DOUBLE / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(max(level) OVER () * weight, cap) AS target FROM l),
k AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, (('0x' || substr(md5('7:offset' || coalesce(':' || r.source, '')), 1, 8))::BIGINT % 1024) / 1024.0::DOUBLE AS shift,
 row_number() OVER (PARTITION BY r.source ORDER BY class, ('0x' || substr(h, 1, 8))::BIGINT % salts, h, doc_id, size) AS n FROM r JOIN t ON t.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, least(floor(n * rate + shift) - floor((n - 1) * rate + shift), 2) AS copies FROM k)
SELECT doc_id, source, size, source_size, target, CAST(copies AS INTEGER) AS copies, CAST(copies * size AS BIGINT) AS taken FROM c"""

FILTER_AUDIT = """WITH f AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY ALL),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
 || (CASE WHEN 100 * len(regexp_extract_all(d.t, '[A-Z]')) > 5 * length(d.t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > first THEN 'E' ELSE '' END) AS x
 FROM d JOIN f ON d.t = f.t LEFT JOIN lab ON lab.doc_id = d.doc_id),
c AS (SELECT part, x, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM fails GROUP BY part, x),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS l, filter_order[1:step - 1] AS before FROM o, range(1, 6) AS r(step)),
y AS (SELECT part, filter_order, step, l, n, g, b, contains(x, l) AS f, len(before) > 0 AND len(list_intersect(string_split(x, ''), string_split(before, ''))) > 0 AS gone, x = l AS alone FROM c, s),
r AS (SELECT part, filter_order, step, l, sum(n) FILTER (NOT f AND NOT gone) AS kept, sum(n) FILTER (f AND NOT gone) AS removed, sum(n) FILTER (f AND gone) AS redundant, sum(n) FILTER (alone) AS unique_fails,
 sum(g) FILTER (f AND NOT gone) AS good_lost, sum(b) FILTER (f AND NOT gone) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
 CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, l), 0) AS BIGINT) AS shapley FROM r"""

DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
m AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (m.total + 2 * v.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS BIGINT) AS q
 FROM m JOIN v ON v.lang = m.lang JOIN k ON k.lang = m.lang LEFT JOIN c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM y) WHERE part = 'pair' OR rank <= 10"""

ORACLE_SQL = {"op1_top_k": TOP_K, "op2_secret_scan": secret_scan(), "op4_mix_sources": MIX, "op8_fingerprints": FINGERPRINTS, "op11_filter_audit": FILTER_AUDIT, "op13_divergence": DIVERGENCE}
