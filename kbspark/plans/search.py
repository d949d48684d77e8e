"""Queries on retrieval: keyword and dense search, fusion, facts, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.operators import chunking, dense, evaluate, evidence, facts, fusion, impacts, ivf, lexical, models, segment, vectors
from kbspark.plans import tables as t
from kbspark.plans.config import RetrievalConfig
from kbspark.plans.registry import query
from kbspark.sources import store

K = 10
CHUNKS = RetrievalConfig(context_expand_neighbors=1)
TOKENS = """tok AS (SELECT d.doc_id AS id, lower(w.term) AS term FROM documents d, unnest(regexp_extract_all(d.text, '[A-Za-z0-9_]+')) AS w(term)),
lens AS (SELECT d.doc_id AS id, len(regexp_extract_all(d.text, '[A-Za-z0-9_]+')) AS length FROM documents d),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
stats AS (SELECT count(*) AS n, sum(length) / count(*) AS avgdl FROM lens),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM stats) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS r FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN r < 0 THEN (SELECT avg(r) * 0.25::DOUBLE FROM raw) ELSE r END AS idf FROM raw)"""
ASKED = "asked AS (SELECT b.item_id AS query_id, lower(w.term) AS term, count(*) AS qtf FROM benchmark b, unnest(regexp_extract_all(b.text, '[A-Za-z0-9_]+')) AS w(term) GROUP BY ALL)"


def bm25_cte(k: int, name: str = "bm25") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, tf.id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))), 9) AS score
  FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN lens ON lens.id = tf.id, stats GROUP BY query_id, tf.id) WHERE score > 0) WHERE rank <= {k})"""


def tf_cte(k: int, name: str = "tfs") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, tf.id, CAST(sum(tf) AS DOUBLE) AS score FROM asked JOIN tf USING (term) GROUP BY query_id, tf.id)) WHERE rank <= {k})"""


def postings(spark, sf_dir):
    """The documents' index, written once for what the table holds and then read by all queries of an application."""
    return lexical.Postings.read(spark, store.kept(spark, "postings", t.given(spark, sf_dir, "documents"), lambda path: lexical.build_postings(t.corpus(spark, sf_dir), "id", "text").write(path)))


def _bm25(spark, sf_dir, k=20):
    return lexical.bm25_topk(t.questions(spark, sf_dir), postings(spark, sf_dir), k)


def _tf(spark, sf_dir, k=20):
    return lexical.bm25_topk(t.questions(spark, sf_dir), postings(spark, sf_dir), k, "tf")


@query("SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS repo_id, count(DISTINCT doc_id) AS docs, count(*) AS tokens, count(DISTINCT lower(w.term)) AS terms FROM documents, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w(term) GROUP BY 1")
def tokenize_stats(spark, sf_dir):
    rows = t.given(spark, sf_dir, "documents").select(t.repo_of().alias("repo_id"), "doc_id", F.explode(X.tokens(F.col("text"))).alias("term"))
    counts = rows.groupBy("repo_id", "term").agg(F.count("*").alias("n"))
    docs = rows.groupBy("repo_id", "doc_id").agg(F.lit(1).alias("one")).groupBy("repo_id").agg(F.count("*").alias("docs"))
    return counts.groupBy("repo_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("terms")).join(docs, "repo_id")


@query(f"WITH {TOKENS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(any_value(idf), 6) AS idf FROM tf JOIN idf USING (term) GROUP BY term")
def bm25_postings(spark, sf_dir):
    p = postings(spark, sf_dir)
    total = p.tf.groupBy("term").agg(F.sum("tf").alias("cf"))
    return p.terms.join(total, "term").join(lexical.term_weights(p), ["repo_id", "term"]).select("term", "df", "cf", F.round("idf", 6).alias("idf"))


@query(f"WITH {TOKENS}, {ASKED}, {bm25_cte(20)} SELECT query_id, id AS doc_id, rank, round(score, 6) AS score FROM bm25")
def bm25_search(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def impact_index(spark, sf_dir):
    return impacts.Impacts.read(spark, store.kept(spark, "impacts", t.given(spark, sf_dir, "documents"), lambda path: impacts.build_impacts(postings(spark, sf_dir), path)))


@query(f"WITH {TOKENS}, {ASKED}, {bm25_cte(20)} SELECT query_id, id AS doc_id, rank, round(score, 6) AS score FROM bm25")
def bm25_blocks(spark, sf_dir):
    return impacts.block_topk(t.questions(spark, sf_dir), impact_index(spark, sf_dir), 20).select("query_id", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query()
def bm25_blocks_read(spark, sf_dir):
    return impacts.reads(t.questions(spark, sf_dir), impact_index(spark, sf_dir), 20).select("query_id", "blocks", "blocks_read", (1 - F.col("blocks_read") / F.col("blocks")).alias("skipped"))


@query(f"WITH {TOKENS}, {ASKED}, {tf_cte(20)} SELECT query_id, id AS doc_id, rank, score FROM tfs")
def tf_search(spark, sf_dir):
    return _tf(spark, sf_dir).select("query_id", F.col("id").alias("doc_id"), "rank", "score")


@query()
def segment_words(spark, sf_dir):
    """By repository: how well the words of texts without blanks are found, by a lexicon learned from all of them."""
    rows = t.cjk(spark, sf_dir)
    found = segment.segment(rows, segment.learn(rows), words_col="found")
    return segment.boundaries(found, "words", "found", "repo_id")


def _vectors(spark, sf_dir):
    return t.given(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("repo_id"), F.col("vec_id").alias("id"), F.col("label").alias("file"), "embedding")


def _dense(spark, sf_dir, k, **more):
    rows = _vectors(spark, sf_dir)
    asked = rows.filter("id % 20 = 0").select("repo_id", F.col("id").alias("query_id"), "embedding")
    return dense.dense_topk(asked, rows, k, exclude_self=True, **more)


def dense_cte(wide: int) -> str:
    return f"""cosine AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label AS file, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
wide AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM cosine) WHERE r <= {wide})"""


@query(f"WITH {dense_cte(K)} SELECT query_id, id AS vec_id, r AS rank, round(score, 6) AS score FROM wide")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, K).select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def vector_index(spark, sf_dir):
    """The vectors' inverted file, written once for what the table holds."""
    return ivf.Ivf.read(spark, store.kept(spark, "ivf", t.given(spark, sf_dir, "embeddings"), lambda path: ivf.build_ivf(_vectors(spark, sf_dir), path)))


@query(f"WITH {dense_cte(K)} SELECT query_id, id AS vec_id, r AS rank, round(score, 6) AS score FROM wide")
def dense_topk_ivf(spark, sf_dir):
    asked = _vectors(spark, sf_dir).filter("id % 20 = 0").select("repo_id", F.col("id").alias("query_id"), "embedding")
    hits = ivf.ivf_topk(asked, vector_index(spark, sf_dir), K, exact=True, exclude_self=True)
    return hits.select("query_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query()
def ivf_recall(spark, sf_dir):
    """Of each query's 10 nearest vectors those that the approximate search finds, and how much is read for them.

    The number of cells to read is fitted on the vectors that come after each query's, and measured on the queries.
    """
    index, rows = vector_index(spark, sf_dir), _vectors(spark, sf_dir)
    as_queries = lambda which: rows.filter(which).select("repo_id", F.col("id").alias("query_id"), "embedding")
    probes = ivf.probes_for(as_queries("id % 20 = 1"), index, K, exclude_self=True)
    asked = as_queries("id % 20 = 0")
    found = ivf.recall(ivf.ivf_topk(asked, index, K, probes=probes, exclude_self=True), _dense(spark, sf_dir, K))
    return found.join(ivf.cells_read(asked, index, probes), ["repo_id", "query_id"]).select("query_id", "n", "found", (F.col("found") / F.col("n")).alias("recall"), "cells", "vectors")


@query(f"""WITH {dense_cte(36)}, capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, id) AS n FROM wide WHERE score >= 0.2)
SELECT * FROM (SELECT query_id, id AS vec_id, file AS label, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM capped WHERE n <= 2) WHERE rank <= 12""")
def dense_threshold_cap(spark, sf_dir):
    hits = _dense(spark, sf_dir, 12, threshold=0.2, per_file=2, oversample=3)
    return hits.select("query_id", F.col("id").alias("vec_id"), F.col("file").alias("label"), "rank")


TWINS = """v AS (SELECT vec_id % 3 AS repo_id, vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
 UNION ALL SELECT (vec_id + 1) % 3, vec_id + 1000000, CAST(list_transform(embedding, lambda x, i: CASE WHEN i % 16 = vec_id % 16 THEN x * 0.5::DOUBLE ELSE x END) AS FLOAT[])::DOUBLE[] FROM embeddings WHERE vec_id % 4 <> 0
 UNION ALL SELECT (vec_id + 2) % 3, vec_id + 2000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 10 = 1)"""


@query(f"""WITH RECURSIVE {TWINS}, l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a AS id, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id), c AS (SELECT r.id, v.repo_id, w.repo_id AS group_repo, r.m FROM r JOIN v ON v.id = r.id JOIN v w ON w.id = r.m),
g AS (SELECT id, repo_id, first(group_repo ORDER BY group_repo, m) AS group_repo, first(m ORDER BY group_repo, m) AS group_id, count(*) AS members FROM c GROUP BY ALL)
SELECT repo_id, id, group_repo, group_id, members FROM g""")
def near_vectors(spark, sf_dir):
    """Entities of several repositories by their vectors: each given one, a blurred copy of most and a plain copy of some."""
    rows = t.given(spark, sf_dir, "embeddings")
    blurred = F.transform("embedding", lambda x, i: F.when((i + 1) % 16 == F.col("vec_id") % 16, x * 0.5).otherwise(x)).cast("array<float>")
    copy = lambda which, n, v: rows.filter(which).select(((F.col("vec_id") + n) % 3).alias("repo_id"), (F.col("vec_id") + n * 1_000_000).alias("id"), v.alias("embedding"))
    every = copy("true", 0, F.col("embedding")).union(copy("vec_id % 4 != 0", 1, blurred)).union(copy("vec_id % 10 = 1", 2, F.col("embedding")))
    return vectors.near_vectors(every, 0.9)


FUSED = f"""{TOKENS}, {ASKED}, {bm25_cte(20)}, {tf_cte(20)},
duo AS (SELECT query_id, id, 0 AS c, rank, score, 'bm25' AS ch FROM bm25 UNION ALL SELECT query_id, id, 1, rank, score, 'tf' FROM tfs),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS fused, string_agg(ch, ',' ORDER BY ch) AS sources, min(c * 1000 + rank) AS first,
  coalesce(max(CASE WHEN ch = 'bm25' THEN score END), 0) AS bm25_score, coalesce(max(CASE WHEN ch = 'tf' THEN score END), 0) AS tf_score FROM duo GROUP BY query_id, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first, id) AS rank FROM fused)"""


def _fused(spark, sf_dir):
    p, asked = postings(spark, sf_dir), t.questions(spark, sf_dir)
    hits = {"bm25": lexical.bm25_topk(asked, p, 20), "tf": lexical.bm25_topk(asked, p, 20, "tf")}
    return fusion.ranked(fusion.rrf_fuse(hits), "id")


@query(f"WITH {FUSED} SELECT query_id, id AS doc_id, rank, round(fused, 9) AS fused, sources, round(bm25_score, 6) AS bm25_score, tf_score FROM ranked")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", F.col("id").alias("doc_id"), "rank", F.round("fused", 9).alias("fused"), F.array_join("sources", ",").alias("sources"), F.round("bm25_score", 6).alias("bm25_score"), "tf_score")


PLACED = "placed AS (SELECT doc_id AS id, source AS filename, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS position FROM documents)"
CAPPED = f"""{FUSED}, {PLACED}, capped AS (SELECT * FROM (SELECT query_id, id, filename, position, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM
 (SELECT r.*, filename, position, row_number() OVER (PARTITION BY query_id, filename ORDER BY rank) AS n FROM ranked r JOIN placed USING (id)) WHERE n <= 2) WHERE rank <= 12)"""


def _placed(spark, sf_dir):
    """Documents as chunks of their source: (repo_id, id, filename, position)."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return t.given(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("repo_id"), F.col("doc_id").alias("id"), F.col("source").alias("filename"), place.alias("position"))


def _capped(spark, sf_dir):
    return fusion.cap_per_file(_fused(spark, sf_dir).join(_placed(spark, sf_dir), ["repo_id", "id"]), 2, 12)


@query(f"WITH {CAPPED} SELECT query_id, id AS doc_id, filename, rank FROM capped")
def per_file_cap(spark, sf_dir):
    return _capped(spark, sf_dir).select("query_id", F.col("id").alias("doc_id"), "filename", "rank")


@query(f"""WITH {CAPPED}, near AS (SELECT query_id, c.filename, c.position + d AS position, c.rank AS r, o, CASE WHEN d <> 0 THEN c.filename || '#' || c.position END AS neighbor_of
 FROM capped c, (VALUES (0, 0), (1, -1), (2, 1)) AS x(o, d) WHERE EXISTS (SELECT 1 FROM placed p WHERE p.filename = c.filename AND p.position = c.position + d)),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, filename, position ORDER BY r, o) AS n FROM near)
SELECT query_id, filename, CAST(position AS INTEGER) AS position, row_number() OVER (PARTITION BY query_id ORDER BY r, o) AS rank, neighbor_of FROM once WHERE n = 1""")
def neighbor_expand(spark, sf_dir):
    return fusion.expand_neighbors(_capped(spark, sf_dir), _placed(spark, sf_dir), 1).drop("repo_id")


@query(f"SELECT mode, CASE mode WHEN 'fact' THEN 6 WHEN 'narrative' THEN 14 ELSE 12 END AS chunk_k, CASE mode WHEN 'fact' THEN 18 WHEN 'narrative' THEN 6 ELSE 12 END AS fact_k, count(*) AS n FROM ({t.MODES}) GROUP BY ALL")
def topk_by_mode(spark, sf_dir):
    rows = t.given(spark, sf_dir, "conversations").withColumn("mode", X.query_mode(F.col("text"), *t.MODE_WORDS))
    chunk_k, fact_k = fusion.topk_by_mode(F.col("mode"))
    return rows.select("mode", chunk_k.alias("chunk_k"), fact_k.alias("fact_k")).groupBy("mode", "chunk_k", "fact_k").agg(F.count("*").alias("n"))


@query(f"""WITH {TOKENS}, {ASKED}, {bm25_cte(20)}, {tf_cte(20)}, subs AS (SELECT query_id // 2 AS query_id, id, score AS bm25, 0.0 AS tf FROM bm25 UNION ALL SELECT query_id // 2, id, 0.0, score FROM tfs),
 best AS (SELECT query_id, id, max(coalesce(nullif(bm25, 0), nullif(tf, 0), 0)) AS merged FROM subs GROUP BY ALL)
SELECT * FROM (SELECT query_id, id AS doc_id, round(merged, 6) AS merged, row_number() OVER (PARTITION BY query_id ORDER BY round(merged, 6) DESC, id) AS rank FROM best) WHERE rank <= 24""")
def multi_query_merge(spark, sf_dir):
    p, asked = postings(spark, sf_dir), t.questions(spark, sf_dir)
    part = lambda df, a, b: df.select("repo_id", F.floor(F.col("query_id") / 2).alias("query_id"), "id", a.alias("bm25"), b.alias("tf"))
    score = F.round("score", 6)
    hits = part(lexical.bm25_topk(asked, p, 20), score, F.lit(0.0)).union(part(lexical.bm25_topk(asked, p, 20, "tf"), F.lit(0.0), score))
    return fusion.merge_hits(hits, "id", ["bm25", "tf"], 24).select("query_id", F.col("id").alias("doc_id"), "merged", "rank")


# -- facts

SHEET = """cells AS (SELECT 'customers-' || c_nationkey || '-' || (c_custkey // 5000) || '.csv' AS source_file, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 5000 ORDER BY c_custkey) AS row_index, c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS again FROM customer)"""


@query(f"""WITH {SHEET} SELECT source_file, 'csv:' || row_index AS record_id, CAST(row_index AS INTEGER) AS row_index, c_mktsegment AS segment,
 '来源=' || source_file || '; 表=CSV; 行=' || row_index || '; key=' || c_custkey || '; name=' || c_name || '; col_3=' || c_mktsegment || CASE WHEN again IS NULL THEN '' ELSE '; name_2=' || again END AS fact_text FROM cells""")
def fact_records(spark, sf_dir):
    rows = facts.sheets_to_facts(t.customer_sheets(spark, sf_dir))
    return facts.indexable(rows).select("source_file", "record_id", "row_index", F.element_at("fields", "col_3").alias("segment"), "fact_text")


@query(f"""WITH {SHEET} SELECT source_file, '| key | name | col_3 | name_2 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
 string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' | ' || coalesce(again, '') || ' |', chr(10) ORDER BY c_custkey) AS markdown FROM cells GROUP BY source_file""")
def fact_markdown(spark, sf_dir):
    return facts.sheets_to_markdown(t.customer_sheets(spark, sf_dir)).select("source_file", "markdown")


SEARCH_TEXT = f"""{t.PART_FACTS}, st AS (SELECT *, substr('parts.csv' || chr(10) || 'parts.md' || chr(10) || 'part' || chr(10) || 'row_index=' || row_index || chr(10) || '行=' || row_index || chr(10) ||
 'name=' || p_name || chr(10) || 'name ' || p_name || chr(10) || 'brand=' || p_brand || chr(10) || 'brand ' || p_brand || chr(10) || 'type=' || p_type || chr(10) || 'type ' || p_type || chr(10) || 'size=' || p_size || chr(10) || 'size ' || p_size || chr(10) || fact_text, 1, 2000) AS fact_search_text FROM part_facts)"""


@query(f"WITH {SEARCH_TEXT} SELECT id, record_id, fact_search_text FROM st")
def fact_search_text(spark, sf_dir):
    return facts.search_text(t.part_facts(spark, sf_dir)).select("id", "record_id", "fact_search_text")


FACT_BM25 = f"""{SEARCH_TEXT}, {t.PART_QUESTIONS},
ftok AS (SELECT id, lower(w.term) AS term FROM st, unnest(regexp_extract_all(fact_search_text, '[A-Za-z0-9_]+')) AS w(term)),
cjk AS (SELECT id, array_to_string(regexp_extract_all(fact_search_text, '[\\x{{4e00}}-\\x{{9fff}}]'), '') AS c FROM st),
gram AS (SELECT id, substr(c, i, 2) AS term FROM cjk, unnest(range(1, greatest(length(c), 2))) AS r(i) WHERE length(c) > 0),
ftoks AS (SELECT * FROM ftok UNION ALL SELECT * FROM gram),
flen AS (SELECT id, count(*) AS length FROM ftoks GROUP BY id), ftf AS (SELECT id, term, count(*) AS tf FROM ftoks GROUP BY ALL),
fstats AS (SELECT count(*) AS n, sum(length) / count(*) AS avgdl FROM flen),
fraw AS (SELECT term, ln((SELECT n FROM fstats) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS r FROM ftf GROUP BY term),
fidf AS (SELECT term, CASE WHEN r < 0 THEN (SELECT avg(r) * 0.25::DOUBLE FROM fraw) ELSE r END AS idf FROM fraw),
fasked AS (SELECT query_id, lower(w.term) AS term, count(*) AS qtf FROM part_questions, unnest(regexp_extract_all(question, '[A-Za-z0-9_]+')) AS w(term) GROUP BY ALL),
fbm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM (SELECT query_id, ftf.id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) AS score
  FROM fasked JOIN ftf USING (term) JOIN fidf USING (term) JOIN flen ON flen.id = ftf.id, fstats GROUP BY query_id, ftf.id) WHERE score > 0) WHERE rank <= 20)"""


def _fact_bm25(spark, sf_dir):
    build = lambda path: lexical.build_postings(facts.search_text(t.part_facts(spark, sf_dir)), "id", "fact_search_text").write(path)
    p = lexical.Postings.read(spark, store.kept(spark, "fact_postings", t.given(spark, sf_dir, "part"), build))
    return lexical.bm25_topk(t.part_questions(spark, sf_dir), p, 20, collapse=True)


@query(f"WITH {FACT_BM25} SELECT query_id, id, rank, round(score, 6) AS score FROM fbm25")
def fact_bm25(spark, sf_dir):
    return _fact_bm25(spark, sf_dir).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


EXACT = """norm AS (SELECT query_id, regexp_replace(lower(question), '\\s+', '', 'g') AS q FROM part_questions),
parts_n AS (SELECT id, regexp_replace(lower(p_name), '\\s+', '', 'g') AS n, lower(p_brand) AS b, lower(p_type) AS t, CAST(p_size AS VARCHAR) AS s FROM part_facts),
ex AS (SELECT query_id, id, (contains(q, n))::INT AS vn, contains(q, b)::INT AS vb, contains(q, t)::INT AS vt, contains(q, s)::INT AS vs, contains(q, 'name')::INT AS kn, contains(q, 'brand')::INT AS kb, contains(q, 'type')::INT AS kt, contains(q, 'size')::INT AS ks,
  contains(q, 'parts.csv')::INT + contains(q, 'parts.md')::INT + contains(q, 'part')::INT AS o FROM norm, parts_n),
exact AS (SELECT query_id, id, (vn + vb + vt + vs) * 1.0::DOUBLE + (vn * kn + vb * kb + vt * kt + vs * ks) * 0.8::DOUBLE + o * 0.3::DOUBLE + least(kn + kb + kt + ks, 3) * 0.2::DOUBLE AS score FROM ex WHERE vn + vb + vt + vs + o > 0)"""


@query(f"WITH {t.PART_FACTS}, {t.PART_QUESTIONS}, {EXACT} SELECT query_id, id, round(score, 6) AS score FROM exact")
def fact_exact_score(spark, sf_dir):
    return fusion.exact_fact_scores(t.part_questions(spark, sf_dir), t.part_facts(spark, sf_dir), digits=6).select("query_id", "id", "score")


@query(f"""WITH {FACT_BM25}, {EXACT}, extop AS (SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM exact) WHERE rank <= 20),
u AS (SELECT query_id, id, 0 AS c, rank, score, false AS e FROM fbm25 UNION ALL SELECT query_id, id, 1, rank, score, true FROM extop),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank) + CASE WHEN e THEN score ELSE 0 END), 6) AS fused, min(c * 1000 + rank) AS first FROM u GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first, id) AS rank FROM f) WHERE rank <= 12""")
def fact_fusion(spark, sf_dir):
    asked, rows = t.part_questions(spark, sf_dir), t.part_facts(spark, sf_dir)
    exact = fusion.exact_fact_topk(asked, rows, 20, 6)
    fused = fusion.rrf_fuse({"bm25": _fact_bm25(spark, sf_dir), "exact": exact}, add_score=("exact",))
    return fusion.ranked(fused.withColumn("fused", F.round("fused", 6)), "id", 12).select("query_id", "id", "fused", "rank")


@query(f"""WITH {FACT_BM25}, {EXACT}, extop AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM exact) WHERE rank <= 20),
u AS (SELECT query_id, id, 0 AS c FROM fbm25 UNION SELECT query_id, id, 1 FROM extop), k AS (SELECT query_id, id, min(c) AS c, count(*) AS both_c FROM u GROUP BY ALL)
SELECT query_id, k.id, CASE WHEN k.c = 1 OR both_c = 2 THEN record_id WHEN k.id % 2 = 0 THEN record_id END AS record_id, CASE WHEN k.c = 0 THEN row_index ELSE NULL END AS row_index FROM k JOIN part_facts p ON p.id = k.id""")
def fact_merge(spark, sf_dir):
    """Attributes that one channel's hits lack come from the other's."""
    asked, rows = t.part_questions(spark, sf_dir), t.part_facts(spark, sf_dir)
    known = rows.select("repo_id", "id", "record_id", "row_index")
    words = _fact_bm25(spark, sf_dir).join(known, ["repo_id", "id"]).withColumn("record_id", F.when(F.col("id") % 2 == 0, F.col("record_id")).otherwise(""))
    exact = fusion.exact_fact_topk(asked, rows, 20, 6).join(known, ["repo_id", "id"]).withColumn("row_index", F.lit(0))
    return fusion.merge_attributes({"bm25": words, "exact": exact}, ["record_id", "row_index"]).drop("repo_id")


PAGES_READ = f"{t.WIKI}, documents AS (SELECT filename AS doc_id, title || chr(10) || substr(trim(regexp_replace(CASE WHEN doc_id % 11 = 0 THEN content ELSE regexp_replace(content, '(?s)^---\\n.*?\\n---\\n*', '') END, '\\s+', ' ', 'g')), 1, 400) AS text FROM wiki)"


@query(f"WITH {PAGES_READ}, {TOKENS}, {ASKED}, {bm25_cte(8)} SELECT query_id, id AS filename, round(score, 6) AS score FROM bm25")
def page_select(spark, sf_dir):
    """Pages that fit a question by title and beginning."""
    pages = t.wiki(spark, sf_dir).withColumn("repo_id", F.lit(0).cast("long"))
    return lexical.select_pages(t.questions(spark, sf_dir), pages).select("query_id", F.col("id").alias("filename"), F.round("score", 6).alias("score"))


# -- evaluation

GOLD = "gold AS (SELECT b.item_id AS query_id, d.doc_id AS page FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def gold(spark, sf_dir):
    """(query_id, page): documents that hold a benchmark passage.

    A passage's first and last word may be part of longer ones in a document; up to four of those
    between are whole there. So all runs of one to four words of a document, of the widths that
    passages have, are joined with the passages' inner words, and the passage is looked for where
    both agree. Passages of one or two words are looked for in every document.
    """
    words = lambda c: F.split(F.lower(F.trim(c)), r"\s+")
    docs = t.given(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text").filter("text is not null")
    asked = t.given(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage")).filter("passage is not null")
    width = F.greatest(F.lit(0), F.least(F.lit(4), F.size(words(F.col("passage"))) - 2))
    asked = asked.withColumn("width", width)
    widths = sorted(r[0] for r in asked.select("width").distinct().collect())  # 0 to 4
    found = docs.join(asked.filter("width = 0"), F.contains("text", F.col("passage"))).select("query_id", "page") if 0 in widths else None

    def grams(w):
        run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return F.concat(*[run(n) for n in widths if n])

    if any(widths):
        starts = F.array_distinct(F.flatten(F.transform(F.array(words(F.col("text"))), grams)))
        inner = F.xxhash64(F.array_join(F.slice(words(F.col("passage")), F.lit(2), F.col("width")), " "))
        near = docs.select("page", F.explode(starts).alias("h")).join(asked.filter("width > 0").withColumn("h", inner), "h").select("page", "query_id", "passage").distinct()
        more = docs.join(near, "page").filter(F.contains("text", F.col("passage"))).select("query_id", "page")
        found = more if found is None else found.union(more)
    return docs.select(F.col("page").alias("query_id"), "page").limit(0) if found is None else found


EVAL = f"""{TOKENS}, {ASKED}, {bm25_cte(K)}, {GOLD}, ev AS (SELECT g.query_id, count(*) AS expected, count(b.id) AS found, min(b.rank) AS first, (SELECT count(*) FROM bm25 x WHERE x.query_id = g.query_id) AS shown FROM gold g LEFT JOIN bm25 b ON b.query_id = g.query_id AND b.id = g.page GROUP BY g.query_id)"""


def _eval(spark, sf_dir):
    hits = _bm25(spark, sf_dir, K).select("query_id", F.col("id").alias("page"), "rank")
    return evaluate.evaluate_retrieval(hits, gold(spark, sf_dir), K)


@query(f"WITH {EVAL} SELECT query_id, round(found / expected, 6) AS recall, round(found / shown, 6) AS precision, round(coalesce(1.0 / first, 0), 6) AS rr, CAST(found > 0 AS INTEGER) AS hit FROM ev")
def retrieval_eval(spark, sf_dir):
    rows, _ = _eval(spark, sf_dir)
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "rr")], "hit")


@query(f"WITH {EVAL} SELECT count(*) AS n, round(avg(found / expected), 6) AS recall, round(avg(found / shown), 6) AS precision, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CAST(found > 0 AS INTEGER)), 6) AS hit_rate FROM ev")
def retrieval_summary(spark, sf_dir):
    _, total = _eval(spark, sf_dir)
    return total.select("n", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "hit_rate")])


@query(f"""WITH {TOKENS}, {ASKED}, {bm25_cte(20)}, {tf_cte(20)}, b AS (SELECT query_id, id, 'bm25' AS channel FROM bm25 UNION ALL SELECT query_id, id, 'tf' FROM tfs), a AS (SELECT query_id, id, min(channel) AS channel FROM b GROUP BY query_id, id HAVING count(*) = 1)
SELECT query_id, channel, count(*) AS n FROM a GROUP BY ALL""")
def channel_exclusive(spark, sf_dir):
    return evaluate.exclusive_hits({"bm25": _bm25(spark, sf_dir), "tf": _tf(spark, sf_dir)})


# -- chunks and vectors


@query(f"""WITH RECURSIVE {t.WIKI}, b AS (SELECT repo_id, filename, regexp_replace(CASE WHEN doc_id % 11 = 0 THEN content ELSE regexp_replace(content, '(?s)^---\\n.*?\\n---\\n*', '') END, '^\\s+|\\s+$', '', 'g') AS body FROM wiki),
c AS (SELECT repo_id, filename, body, 0::BIGINT AS o, -1::BIGINT AS cut FROM b WHERE body <> '' UNION ALL
 SELECT repo_id, filename, body, greatest(stop - 80, o + 1), stop FROM (SELECT *, CASE WHEN w = '' THEN o + 1200 ELSE o + 1000 + length(w) END AS stop FROM (SELECT *, regexp_extract(substr(body, o + 1001, 200), '(?s)^.*[。！？!?\\n]') AS w FROM c WHERE length(body) - o > 1200))),
p AS (SELECT repo_id, filename, o, regexp_replace(substr(body, o + 1, coalesce(lead(cut) OVER (PARTITION BY repo_id, filename ORDER BY o), length(body)) - o), '^\\s+|\\s+$', '', 'g') AS chunk FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, filename ORDER BY o) - 1 AS i FROM p WHERE chunk <> '')
SELECT repo_id, filename, filename || '#' || i AS chunk_id, '' AS heading, CAST(i AS INTEGER) AS position, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS md5 FROM n""")
def chunk_pages(spark, sf_dir):
    return chunking.chunk_pages(t.wiki(spark, sf_dir)).select("repo_id", "filename", "chunk_id", "heading", "position", F.length("chunk_text").alias("n_chars"), F.md5("chunk_text").alias("md5"))


@query()
def chunk_retrieval(spark, sf_dir):
    """Chunks by keywords and by vectors of hashed words, fused, capped and with neighbours."""
    pages = t.wiki(spark, sf_dir).withColumn("repo_id", F.lit(0).cast("long"))
    asked = models.embed(t.questions(spark, sf_dir), "question", models.hash_embedder())
    # a chunk's words, vector and place are worked out and written once, its text is not
    vectors = models.embed(chunking.chunk_pages(pages).select("repo_id", "chunk_id", "filename", "position", "chunk_text"), "chunk_text", models.hash_embedder())
    index = lexical.written(lexical.build_postings(vectors, "chunk_id", "chunk_text", keep=("filename", "position", "embedding")))
    near = dense.dense_topk(asked.select("repo_id", "query_id", "embedding"), index.docs.select("repo_id", "id", F.col("filename").alias("file"), "embedding"), CHUNKS.chunk_candidates, threshold=None, oversample=CHUNKS.chunk_oversample)
    chunks = index.docs.select("repo_id", "filename", "position", F.col("id").alias("chunk_id"))
    return fusion.retrieve_chunks(t.questions(spark, sf_dir), chunks, near, CHUNKS, postings=index).drop("repo_id")


@query()
def embed_hash(spark, sf_dir):
    docs = t.given(spark, sf_dir, "documents").select("doc_id", "text")
    rows = models.embed(docs, "text", models.hash_embedder())
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"), "error")


# -- answers

CONF = """conf AS (SELECT doc_id, doc_id % 4 AS wiki, doc_id % 6 AS chunk, doc_id % 5 AS fact, (doc_id % 100) / 100.0::DOUBLE AS tc, (doc_id * 7 % 100) / 100.0::DOUBLE AS tf, doc_id % 3 = 0 AS both_c, doc_id % 5 > 0 AS fc, doc_id % 17 = 0 AS ov, doc_id % 19 = 0 AS unsure FROM documents),
scored AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.0::DOUBLE + CASE WHEN wiki >= 1 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN wiki >= 2 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN chunk >= 2 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN chunk >= 4 THEN 0.10::DOUBLE ELSE 0 END
 + CASE WHEN fact >= 1 THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN fact >= 3 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN both_c THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN fc THEN 0.10::DOUBLE ELSE 0 END
 + CASE WHEN tc >= 0.85::DOUBLE THEN 0.10::DOUBLE WHEN tc >= 0.75::DOUBLE THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN tf >= 0.90::DOUBLE THEN 0.10::DOUBLE WHEN tf >= 0.80::DOUBLE THEN 0.05::DOUBLE ELSE 0 END
 + CASE WHEN ov THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN unsure THEN -0.20::DOUBLE ELSE 0 END)) AS raw FROM conf)"""


def _confidence(spark, sf_dir):
    d = F.col("doc_id")
    rows = t.given(spark, sf_dir, "documents").select(
        "doc_id", (d % 4).alias("wiki_hit_count"), (d % 6).alias("chunk_hit_count"), (d % 5).alias("fact_hit_count"), ((d % 100) / 100.0).alias("top_chunk_score"), ((d * 7 % 100) / 100.0).alias("top_fact_score"),
        (d % 3 == 0).alias("both_channels"), (d % 5 > 0).alias("fact_channel"), (d % 17 == 0).alias("hit_overview"), F.when(d % 19 == 0, X.UNCERTAIN_PHRASES[0]).otherwise("").alias("answer_text"),
    )
    return evidence.confidence(rows)


@query(f"WITH {CONF} SELECT doc_id, round(raw, 2) AS score, CASE WHEN raw >= 0.75::DOUBLE THEN 'high' WHEN raw >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS level FROM scored")
def confidence_score(spark, sf_dir):
    return _confidence(spark, sf_dir).select("doc_id", "score", "level")


CITED = """cited AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all('see doc-' || (doc_id % 7) || '.md and report_' || (doc_id % 3) || '.pdf, doc-' || (doc_id % 7) || '.md', '[A-Za-z0-9_-]+\\.(?:md|pdf)'))) AS c FROM documents),
unk AS (SELECT doc_id, c, list_filter(c, lambda x: x NOT IN ('doc-0.md', 'doc-1.md', 'doc-2.md', 'report_0.pdf', 'report_1.pdf')) AS u FROM cited)"""


def _cited(spark, sf_dir):
    d = F.col("doc_id")
    answer = F.concat(F.lit("see doc-"), d % 7, F.lit(".md and report_"), d % 3, F.lit(".pdf, doc-"), d % 7, F.lit(".md"))
    allowed = F.array(*[F.lit(x) for x in ("doc-0.md", "doc-1.md", "doc-2.md", "report_0.pdf", "report_1.pdf")])
    return t.given(spark, sf_dir, "documents").select("doc_id", evidence.check_citations(answer, allowed).alias("c")).select("doc_id", "c.*")


@query(f"WITH {CITED} SELECT doc_id, array_to_string(c, ',') AS cited, array_to_string(u, ',') AS unknown, len(u) = 0 AS ok FROM unk")
def citation_check(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", F.array_join("cited", ",").alias("cited"), F.array_join("unknown", ",").alias("unknown"), "ok")


@query(f"""WITH {CONF}, {CITED}, p AS (SELECT doc_id, round(raw, 2) AS s, raw, len(u) > 0 AS bad, greatest(0.0::DOUBLE, round(round(raw, 2) - 0.25::DOUBLE, 2)) AS lower FROM scored JOIN unk USING (doc_id))
SELECT doc_id, CASE WHEN bad THEN lower ELSE s END AS score, CASE WHEN CASE WHEN bad THEN lower ELSE raw END >= 0.75::DOUBLE THEN 'high' WHEN CASE WHEN bad THEN lower ELSE raw END >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS level FROM p""")
def citation_penalty(spark, sf_dir):
    rows = _confidence(spark, sf_dir).join(_cited(spark, sf_dir), "doc_id")
    return evidence.penalize(rows).select("doc_id", "score", "level")
