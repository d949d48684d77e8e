"""Queries on pages: links, lint, duplicates, storage, literal search, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.functions import yaml
from kbspark.operators import access, evidence, graph, lexical, literal, logs
from kbspark.plans import tables as t
from kbspark.plans.registry import query
from kbspark.plans.search import ASKED, TOKENS, bm25_cte, postings
from kbspark.sources import files, merged, store

WIKI = t.WIKI
LINKED = f"{WIKI}, edges AS (SELECT repo_id, filename AS source, target FROM wiki), found AS (SELECT e.* FROM edges e JOIN wiki w ON w.repo_id = e.repo_id AND w.filename = e.target)"


@query(f"WITH {WIKI} SELECT repo_id, filename, title, type, source, length(content) AS n_chars FROM (SELECT repo_id, filename, CASE WHEN doc_id % 11 = 0 THEN replace(filename, '.md', '') ELSE title END AS title, CASE WHEN doc_id % 11 = 0 THEN 'unknown' ELSE type END AS type, CASE WHEN doc_id % 11 <> 0 THEN source END AS source, content FROM wiki)")
def wiki_pages(spark, sf_dir):
    rows = files.page_fields(t.wiki(spark, sf_dir).select("repo_id", "filename", "content"))
    return rows.select("repo_id", "filename", "title", "type", "source", F.length("content").cast("long").alias("n_chars"))


@query("SELECT doc_id, CAST(('0x' || substr(md5('p' || doc_id), 1, 16))::UBIGINT AS VARCHAR) AS point_id, CAST(('0x' || substr(md5('p' || doc_id), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT AS BIGINT) AS point_id63, md5(text) AS md5 FROM documents")
def point_ids(spark, sf_dir):
    key = F.concat(F.lit("p"), F.col("doc_id"))
    return t.given(spark, sf_dir, "documents").select("doc_id", X.point_id(key).cast("string").alias("point_id"), X.point_id63(key).alias("point_id63"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("""SELECT p_partkey, p_name, version FROM (SELECT p_partkey, p_name, 1 AS version FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, upper(p_name), 3 FROM part WHERE p_partkey % 3 = 0)""")
def upsert_latest(spark, sf_dir):
    part = t.given(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = part.filter("p_partkey % 3 = 0")
    two = new.withColumn("version", F.lit(2)).union(new.select("p_partkey", F.upper("p_name"), F.lit(3)))
    return store.upsert(part.withColumn("version", F.lit(1)), two, ["p_partkey"], ["version"])


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 100 = 7 THEN 3 ELSE 1 END AS version FROM (SELECT p_partkey, CASE WHEN p_partkey % 100 = 7 THEN upper(p_name) ELSE p_name END AS p_name FROM part WHERE p_partkey % 50 <> 11)
UNION ALL SELECT -p_partkey, p_name, 2 FROM part WHERE p_partkey % 100 = 3""")
def merged_table(spark, sf_dir):
    """A keyed table after an upsert of 1 % of its keys, new keys, a deletion and a folding."""
    part = t.given(spark, sf_dir, "part").select("p_partkey", "p_name")
    path = store.scratch(spark)
    table = merged.MergedTable(spark, path, ["p_partkey"], buckets=8)
    table.upsert(part.withColumn("version", F.lit(1)))
    table.fold()
    some = part.filter("p_partkey % 100 = 7")
    table.upsert(some.withColumn("version", F.lit(2)).union(some.select("p_partkey", F.upper("p_name"), F.lit(3))), ["version"])
    table.upsert(part.filter("p_partkey % 100 = 3").select((-F.col("p_partkey")).alias("p_partkey"), "p_name", F.lit(2).alias("version")))
    table.delete(part.filter("p_partkey % 50 = 11"))
    return table.read()


@query("SELECT * FROM part WHERE p_size <> 10")
def delete_by_key(spark, sf_dir):
    part = t.given(spark, sf_dir, "part")
    return store.delete_by(part, part.filter("p_size = 10"), ["p_partkey"])


@query(f"WITH {WIKI} SELECT repo_id, filename, content FROM wiki WHERE repo_id % 2 = 1 UNION ALL SELECT repo_id, filename, upper(title) FROM wiki WHERE repo_id % 2 = 0 AND doc_id % 3 = 0")
def snapshot_replace(spark, sf_dir):
    pages = t.wiki(spark, sf_dir)
    new = pages.filter("repo_id % 2 = 0 and doc_id % 3 = 0").select("repo_id", "filename", F.upper("title").alias("content"))
    return store.import_snapshot(pages.select("repo_id", "filename", "content"), new, "replace")


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type || '  ' || p_name), '[^a-z0-9_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark, sf_dir):
    return t.given(spark, sf_dir, "part").select("p_partkey", X.slugify(F.concat("p_brand", F.lit(" / "), "p_type", F.lit("  "), "p_name")).alias("slug"))


@query(f"WITH {WIKI} SELECT filename, replace(target, '.md', '') AS links, replace(content, '](' || target || ')', '](base/' || replace(target, '.md', '') || ')') AS rewritten FROM wiki")
def link_extract(spark, sf_dir):
    c = F.col("content")
    return t.wiki(spark, sf_dir).select("filename", F.array_join(X.links(c), ",").alias("links"), X.rewrite_links(c, F.lit("base")).alias("rewritten"))


@query(f"WITH {LINKED} SELECT * FROM found")
def link_graph(spark, sf_dir):
    return graph.link_graph(t.wiki(spark, sf_dir))[1]


@query(f"WITH {LINKED} SELECT f.repo_id, f.target, f.source AS filename, w.title FROM found f JOIN wiki w ON w.filename = f.source")
def backlinks(spark, sf_dir):
    return graph.backlinks(t.wiki(spark, sf_dir))


@query(f"WITH {LINKED} SELECT repo_id, filename FROM wiki w WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.repo_id = w.repo_id AND f.target = w.filename AND f.source <> f.target)")
def orphan_pages(spark, sf_dir):
    return graph.orphans(t.wiki(spark, sf_dir))


@query(f"WITH {LINKED} SELECT repo_id, source, target FROM edges EXCEPT SELECT repo_id, source, target FROM found")
def broken_links(spark, sf_dir):
    return graph.broken_links(t.wiki(spark, sf_dir))


@query(f"""WITH {LINKED} SELECT repo_id, 'orphan' AS type, filename AS page, 'no page links here' AS description FROM wiki w WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.repo_id = w.repo_id AND f.target = w.filename AND f.source <> f.target)
UNION ALL SELECT repo_id, 'broken_link', source, 'links to ' || target FROM (SELECT repo_id, source, target FROM edges EXCEPT SELECT repo_id, source, target FROM found)
UNION ALL SELECT repo_id, 'bad_frontmatter', filename, 'lacks title, type, updated' FROM wiki WHERE doc_id % 11 = 0
UNION ALL SELECT repo_id, 'wrong_type', filename, 'unknown type ' || type FROM wiki WHERE doc_id % 11 <> 0 AND CASE repo_id % 5 WHEN 4 THEN type = 'memo' WHEN 2 THEN true ELSE type <> 'concept' END""")
def frontmatter_lint(spark, sf_dir):
    pages = t.wiki(spark, sf_dir)
    repos = pages.select("repo_id").distinct().withColumn("template", t.repo_template())
    return graph.lint(pages, graph.vocabulary(repos, t.templates(spark)))


@query("WITH h AS (SELECT CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS repo_id, doc_id, md5(text) AS m FROM documents), f AS (SELECT repo_id, m, min(doc_id) AS kept FROM h GROUP BY ALL HAVING count(*) > 1) SELECT repo_id, doc_id, kept FROM h JOIN f USING (repo_id, m) WHERE doc_id <> kept")
def exact_duplicates(spark, sf_dir):
    docs = t.given(spark, sf_dir, "documents").withColumn("repo_id", t.repo_of())
    return graph.exact_duplicates(docs, "doc_id", "text")


@query(f"""WITH {WIKI}, ws AS (SELECT repo_id, filename, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(title, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ('the', 'a', 'an', 'of', 'is', 'are', 'to', 'and', 'or', 'for')))) AS w FROM wiki),
s AS (SELECT repo_id, w, min(filename) AS one FROM ws WHERE len(w) > 0 GROUP BY ALL)
SELECT a.repo_id, least(a.one, b.one) AS a, greatest(a.one, b.one) AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS similarity FROM s a JOIN s b ON a.repo_id = b.repo_id AND a.one < b.one
 WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.6
UNION ALL SELECT ws.repo_id, one, filename, 1.0 FROM ws JOIN s ON s.repo_id = ws.repo_id AND s.w = ws.w WHERE filename <> one""")
def near_duplicate_titles(spark, sf_dir):
    return graph.similar_titles(t.wiki(spark, sf_dir), 0.6).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {WIKI}, src AS (SELECT DISTINCT repo_id, source AS source_file FROM wiki UNION SELECT DISTINCT repo_id, 'doc-' || (doc_id % 9 + 1) || '.pdf' FROM wiki)
SELECT DISTINCT w.repo_id, source_file, filename FROM wiki w JOIN src s ON s.repo_id = w.repo_id AND (w.source = s.source_file OR filename = replace(source_file, '.pdf', '.md') OR starts_with(filename, replace(source_file, '.pdf', '-')))""")
def source_derived_pages(spark, sf_dir):
    pages = t.wiki(spark, sf_dir)
    sources = pages.select("repo_id", F.col("source").alias("source_file")).union(pages.select("repo_id", F.concat(F.lit("doc-"), F.col("doc_id") % 9 + 1, F.lit(".pdf")))).distinct()
    return graph.pages_from_sources(pages, sources)


@query("""WITH f AS (SELECT DISTINCT p_name AS entity, 'brand' AS field, p_brand AS value FROM part UNION SELECT DISTINCT p_name, 'type', p_type FROM part)
SELECT entity, field, string_agg(value, '|' ORDER BY value) AS vals FROM f GROUP BY ALL HAVING count(*) > 1""")
def fact_conflicts(spark, sf_dir):
    rows = graph.fact_conflicts(t.part_facts(spark, sf_dir), "name", ["brand", "type"])
    return rows.select("entity", "field", F.array_join("values", "|").alias("vals"))


SEARCHED = f"""{WIKI}, q AS (SELECT DISTINCT repo_id, repo_id AS query_id, CASE WHEN repo_id % 2 = 0 THEN 'And ' ELSE 'updated' END AS q FROM wiki),
hit AS (SELECT query_id, w.repo_id, filename, content, q, strpos(lower(content), lower(q)) AS p FROM wiki w JOIN q USING (repo_id) WHERE contains(lower(content), lower(q)))"""


def _searched(spark, sf_dir):
    pages = t.wiki(spark, sf_dir)
    asked = pages.select("repo_id").distinct().select("repo_id", F.col("repo_id").alias("query_id"), F.when(F.col("repo_id") % 2 == 0, "And ").otherwise("updated").alias("q"))
    index = store.kept(spark, "grams", t.given(spark, sf_dir, "documents"), lambda path: literal.build_grams(pages, path))
    return literal.literal_search(asked, literal.GramIndex.read(spark, index), 80)


@query(f"""WITH {SEARCHED}, c AS (SELECT *, greatest(p - 80, 1) AS s, least(p + length(q) - 1 + 80, length(content)) AS e FROM hit)
SELECT query_id, repo_id, filename, replace(CASE WHEN s > 1 THEN '...' ELSE '' END || substr(content, s, e - s + 1) || CASE WHEN e < length(content) THEN '...' ELSE '' END, chr(10), ' ') AS snippet,
 CAST((length(lower(content)) - length(replace(lower(content), lower(q), ''))) / length(q) AS INTEGER) AS match_count FROM c""")
def literal_search(spark, sf_dir):
    return _searched(spark, sf_dir)


@query(f"WITH {SEARCHED} SELECT repo_id, count(*) AS pages, CAST(sum((length(lower(content)) - length(replace(lower(content), lower(q), ''))) / length(q)) AS BIGINT) AS total FROM hit GROUP BY repo_id")
def search_totals(spark, sf_dir):
    return _searched(spark, sf_dir).groupBy("repo_id").agg(F.count("*").alias("pages"), F.sum("match_count").alias("total"))


@query(f"""WITH {WIKI}, gone AS (SELECT filename, repo_id FROM wiki WHERE doc_id % 50 IN (3, 4)) SELECT 'pages' AS kind, count(*) AS n FROM wiki w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.filename = w.filename)
UNION ALL SELECT 'chunks', 2 * count(*) FROM wiki w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.filename = w.filename) UNION ALL SELECT 'facts', count(*) FROM wiki WHERE doc_id % 50 NOT IN (3, 4)
UNION ALL SELECT 'index', count(*) FROM wiki w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.filename = w.filename) UNION ALL SELECT 'logs', count(DISTINCT (repo_id, source)) FROM wiki WHERE doc_id % 50 NOT IN (3, 4)""")
def lineage_delete(spark, sf_dir):
    pages = t.wiki(spark, sf_dir)
    gone = pages.filter("doc_id % 50 in (3, 4)").select("repo_id", F.col("source").alias("source_file")).distinct()
    chunks = pages.select("repo_id", "filename", F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    section = F.concat(F.lit("## 2024-01-01 — Ingested `"), "source", F.lit("`\n- Created: x.md\n"))
    written = pages.select("repo_id", "source", section.alias("s")).distinct().groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("s")), "\n").alias("content"))
    left = graph.delete_documents(gone, pages, chunks, pages.select("repo_id", F.col("source").alias("source_file")), written)
    # the lines of the index and the sections of the logs
    left["index"] = left["index"].select(F.explode(F.filter(F.split("content", "\n"), lambda x: F.startswith(x, F.lit("- [")))))
    left["logs"] = left["logs"].select(F.explode(F.regexp_extract_all("content", F.lit("Ingested `"), F.lit(0))))
    count = lambda k: left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return count("pages").union(count("chunks")).union(count("facts")).union(count("index")).union(count("logs"))


@query(f"""WITH {LINKED}, i AS (SELECT repo_id, 'orphan_pages' AS part, true AS fixable, count(*) AS n FROM wiki w WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.repo_id = w.repo_id AND f.target = w.filename AND f.source <> f.target) GROUP BY repo_id
UNION ALL SELECT repo_id, 'missing_refs', false, count(*) FROM (SELECT repo_id, source, target FROM edges EXCEPT SELECT repo_id, source, target FROM found) GROUP BY repo_id
UNION ALL SELECT repo_id, 'contradictions', false, count(*) FROM wiki WHERE doc_id % 40 = 1 GROUP BY repo_id UNION ALL SELECT repo_id, 'suggestions', false, 1 FROM wiki GROUP BY repo_id
UNION ALL SELECT repo_id, 'missing_refs', true, count(*) FROM wiki WHERE doc_id % 11 = 0 OR CASE repo_id % 5 WHEN 4 THEN type = 'memo' WHEN 2 THEN true ELSE type <> 'concept' END GROUP BY repo_id) SELECT * FROM i""")
def lint_report(spark, sf_dir):
    """Structural issues with those that a model found (here every fortieth page), by part of the report."""
    pages = t.wiki(spark, sf_dir)
    repos = pages.select("repo_id").distinct()
    issues = graph.lint(pages, graph.vocabulary(repos.withColumn("template", t.repo_template()), t.templates(spark)))
    told = pages.filter("doc_id % 40 = 1").select("repo_id", F.lit("contradiction").alias("type"), F.col("filename").alias("page"), F.lit("says otherwise").alias("description"))
    rows = graph.lint_report(issues.unionByName(told), repos.select("repo_id", F.lit("read more").alias("message")))
    return rows.groupBy("repo_id", "part", "fixable").agg(F.count("*").alias("n"))


@query(f"WITH {WIKI} SELECT repo_id, type, count(*) AS n, CAST(CASE type WHEN 'concept' THEN 2 WHEN 'entity' THEN 3 WHEN 'source' THEN 4 ELSE 6 END AS INTEGER) AS place, string_agg(title, '|' ORDER BY title, filename) AS titles FROM wiki GROUP BY repo_id, type")
def pages_by_type(spark, sf_dir):
    rows = graph.pages_by_type(t.wiki(spark, sf_dir))
    return rows.select("repo_id", "type", "n", "place", F.array_join(F.transform("items", lambda x: x["title"]), "|").alias("titles"))


@query(f"""WITH {WIKI}, p AS (SELECT repo_id, CASE type WHEN 'concept' THEN 2 WHEN 'entity' THEN 3 WHEN 'source' THEN 4 ELSE 6 END AS place, type, '## ' || type || chr(10) || string_agg('- [' || title || '](' || filename || ')', chr(10) ORDER BY title, filename) AS text FROM wiki GROUP BY repo_id, type)
SELECT repo_id, '# Index' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY place, type) AS content FROM p GROUP BY repo_id""")
def index_page(spark, sf_dir):
    return graph.index_page(t.wiki(spark, sf_dir))


@query(f"""WITH {WIKI}, ex AS (SELECT repo_id, filename, substr(trim(regexp_replace(CASE WHEN doc_id % 11 = 0 THEN content ELSE regexp_replace(content, '(?s)^---\\n.*?\\n---\\n*', '') END, '\\s+', ' ', 'g')), 1, 400) AS text, row_number() OVER (PARTITION BY repo_id ORDER BY filename) AS i, count(*) OVER (PARTITION BY repo_id) AS total FROM wiki),
s AS (SELECT *, sum(length(text)) OVER (PARTITION BY repo_id ORDER BY i) AS sum FROM ex WHERE i <= 25)
SELECT repo_id, CAST(count(*) AS INTEGER) AS n_pages, count(*) < any_value(total) AS truncated, md5(string_agg(filename || ': ' || text, chr(10) ORDER BY i)) AS md5 FROM s WHERE sum <= 8000 GROUP BY repo_id""")
def description_sample(spark, sf_dir):
    rows = graph.sample_pages(t.wiki(spark, sf_dir))
    return rows.select("repo_id", "n_pages", "truncated", F.md5(F.col("sample").cast("binary")).alias("md5"))


def _hits(spark, sf_dir, k=5):
    pages = t.wiki(spark, sf_dir).withColumn("repo_id", F.lit(0).cast("long"))
    hits = lexical.bm25_topk(t.questions(spark, sf_dir), postings(spark, sf_dir), k).withColumnRenamed("id", "doc_id")
    return hits.join(pages.drop("repo_id"), "doc_id"), pages


@query(f"""WITH {TOKENS}, {ASKED}, {bm25_cte(5)}, {WIKI} SELECT query_id, 'page' AS kind, rank, filename, 'wiki/doc-' || doc_id AS url, 'selected page' AS reason FROM bm25 JOIN wiki ON doc_id = bm25.id
UNION ALL SELECT query_id, 'chunk', rank, filename, 'wiki/doc-' || doc_id || '#0', CASE WHEN rank % 2 = 0 THEN 'next to a match' ELSE 'matching chunk' END FROM bm25 JOIN wiki ON doc_id = bm25.id""")
def evidence_rows(spark, sf_dir):
    hits, _ = _hits(spark, sf_dir)
    chunks = hits.withColumns({"position": F.lit(0), "chunk_text": F.col("content"), "neighbor_of": F.when(F.col("rank") % 2 == 0, "x#1")})
    none = hits.limit(0).withColumns({"source_markdown_filename": F.lit(""), "record_id": F.lit(""), "fact_text": F.lit("")})
    return evidence.evidence_rows(hits, chunks, none).select("query_id", "kind", "rank", "filename", "url", "reason")


@query(f"""WITH {TOKENS}, {ASKED}, {bm25_cte(5)}, {WIKI} SELECT query_id, md5(string_agg('[' || filename || '#' || (rank % 2) || '] ' || substr(content, 1, 700), chr(10) || chr(10) ORDER BY rank)) AS md5, count(*) AS n FROM bm25 JOIN wiki ON doc_id = bm25.id GROUP BY query_id""")
def context_block(spark, sf_dir):
    hits, pages = _hits(spark, sf_dir)
    chunks = hits.withColumns({"position": F.col("rank") % 2, "chunk_text": F.col("content")})
    context = evidence.build_context(chunks, hits.limit(0))
    return context.join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").select("query_id", F.md5(F.col("context").cast("binary")).alias("md5"), "n")


@query("""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, page_id, url FROM pages) SELECT host, count(*) AS n_pages, string_agg('<!-- ' || url || ' -->' || chr(10) || page_id, chr(10) || chr(10) ORDER BY page_id, url) AS content FROM p GROUP BY host""")
def topic_merge(spark, sf_dir):
    rows = t.given(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), "page_id", "url", F.col("page_id").cast("string").alias("text"))
    return files.merge_topic(rows, "host", "page_id", "text", "url")


@query("""WITH s AS (SELECT page_id, url, substr(trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', ''), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id, url) - 1 AS n FROM s)
SELECT page_id, slug || CASE WHEN n > 0 THEN '-' || n ELSE '' END || '.md' AS filename FROM n""")
def url_names(spark, sf_dir):
    return files.web_sources(t.given(spark, sf_dir, "pages")).select("page_id", "filename")


@query()
def url_sources(spark, sf_dir):
    return files.web_sources(t.given(spark, sf_dir, "pages")).select("page_id", "filename", F.length("content").alias("n_chars"), F.md5("content").alias("md5"))


@query()
def page_text(spark, sf_dir):
    """How much of each page's article is found, and how much else, when nothing marks it as one: runs of three words planted, found and right."""
    pages = t.given(spark, sf_dir, "pages").select("page_id", "html")
    planted = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), "<[^>]*>", " ")
    plain = F.regexp_replace("html", r"(</?)article>", "$1div>")
    rows = files.web_text(pages.select("page_id", plain.alias("html")), "page_id").withColumnRenamed("content", "found")
    rows = rows.join(files.web_text(pages.select("page_id", F.concat(F.lit("<main><p>"), planted, F.lit("</p></main>")).alias("html")), "page_id").withColumnRenamed("content", "planted"), "page_id")

    words = lambda c: F.filter(F.split(F.regexp_replace(c, "[#*|]+", " "), r"\s+"), lambda w: w != "")
    join = lambda a, b: F.concat_ws(" ", a, b)
    runs = lambda w: F.zip_with(F.zip_with(w, F.slice(w, 2, 1 << 30), join), F.slice(w, 3, 1 << 30), join)
    # words are worked out once: a lambda's argument is
    shingles = lambda c: F.array_distinct(F.flatten(F.transform(F.array(words(c)), runs)))
    rows = rows.select("page_id", shingles("planted").alias("p"), shingles("found").alias("f"))
    return rows.select("page_id", F.size("p").alias("planted"), F.size("f").alias("found"), F.size(F.array_intersect("p", "f")).alias("right"))


HEADED = """headed AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '^[A-Za-z]+'), ''), 'None') AS word, lang, source, n_chars FROM documents)"""


@query(f"""WITH {HEADED} SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE word || ': the "' || doc_id || '"' END AS title, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS owner, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang || '@' || source || '.org' END AS mail,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'first ' || word || chr(10) || '  indented: yes' || chr(10) || chr(10) || 'last' || chr(10) END AS summary, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'folded ' || word || ' over lines' END AS note,
 CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 3 END AS n_tags, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'a, ' || lang END AS second_tag, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS size, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'it''s ' || word END AS said FROM headed""")
def header_fields(spark, sf_dir):
    """Nested headers of pages, written over the documents; every seventh can't be read."""
    word = F.coalesce(F.nullif(F.regexp_extract("text", "^[A-Za-z]+", 0), F.lit("")), F.lit("None"))
    lines = [F.concat(F.lit('title: "'), word, F.lit(': the \\"'), "doc_id", F.lit('\\""')), F.lit("owner:"), F.concat(F.lit("  name: "), "source", F.lit("  # who")), F.lit("  contact:"), F.concat(F.lit("    mail: "), "lang", F.lit("@"), "source", F.lit(".org")),
             F.lit("summary: |"), F.concat(F.lit("  first "), word), F.lit("    indented: yes"), F.lit(""), F.lit("  last"), F.lit("note: >-"), F.concat(F.lit("  folded "), word), F.lit("  over lines"),
             F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("tags: [x, 'a, "), "lang", F.lit("', {k: v}]"))).otherwise(F.concat(F.lit("tags:\n- x\n- a, "), "lang", F.lit("\n- k: v"))), F.concat(F.lit("parts:\n  - size: "), "n_chars", F.lit("\n    said: 'it''s\n      "), word, F.lit("'"))]
    broken = F.when(F.col("doc_id") % 7 == 0, "open: [1, 2\n").otherwise("")
    pages = t.given(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("---\n"), broken, F.concat_ws("\n", *lines), F.lit("\n---\n"), "text").alias("content"))
    rows, get = yaml.with_header(pages), lambda path: yaml.at("header", path)
    tags = F.size(F.array_distinct(F.transform(F.filter(F.map_keys("header"), lambda k: k.startswith("tags[")), lambda k: F.regexp_extract(k, r"^tags\[(\d+)\]", 1))))
    return rows.select("doc_id", get("title").alias("title"), get("owner.name").alias("owner"), get("owner.contact.mail").alias("mail"), get("summary").alias("summary"), get("note").alias("note"), tags.alias("n_tags"), get("tags[1]").alias("second_tag"), get("parts[0].size").alias("size"), get("parts[0].said").alias("said"))


@query(f"""WITH {WIKI}, h AS (SELECT repo_id, substr(filename, 1, 6) AS range, filename, sha1(filename || chr(31) || content) AS h FROM wiki), p AS (SELECT repo_id, range, count(*) AS n, sha1(string_agg(h, '' ORDER BY filename)) AS h FROM h GROUP BY ALL)
SELECT repo_id, 'n=' || CAST(sum(n) AS BIGINT) || ';h=' || substr(sha1(string_agg(h, '' ORDER BY range)), 1, 16) AS signature FROM p GROUP BY repo_id""")
def content_signature(spark, sf_dir):
    """n=<count>;h=<digest> of each repository's pages; digests of ranges of names are digested again."""
    pages = t.wiki(spark, sf_dir).select("repo_id", F.substring("filename", 1, 6).alias("range"), "filename", F.sha1(F.concat_ws("\x1f", "filename", "content")).alias("h"))
    parts = pages.groupBy("repo_id", "range").agg(F.count("*").alias("n"), F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("filename", "h"))), lambda x: x["h"]), "")).alias("h"))
    return parts.groupBy("repo_id").agg(F.concat(F.lit("n="), F.sum("n"), F.lit(";h="), F.substring(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "h"))), lambda x: x["h"]), "")), 1, 16)).alias("signature"))


# -- access and routing

A = t.ACCESS


@query(f"""WITH {A}, r AS (SELECT owner_id AS user_id, repo_id, 0 AS p FROM repos UNION ALL SELECT user_id, repo_id, 1 FROM members UNION ALL SELECT user_id, repo_id, 2 FROM users, repos WHERE is_public)
SELECT user_id, repo_id, CASE min(p) WHEN 0 THEN 'owner' WHEN 1 THEN 'member' ELSE 'public' END AS via FROM r GROUP BY ALL""")
def visible_repos(spark, sf_dir):
    return access.visible_repos(t.users(spark, sf_dir), t.repos(spark, sf_dir), t.members(spark, sf_dir))


@query(f"""WITH {A}, p AS (SELECT DISTINCT (event_id % 25) AS user_id, (event_id % 90) AS repo_id FROM events) SELECT p.user_id, p.repo_id, CASE WHEN owner_id = p.user_id THEN 'owner' ELSE coalesce(role, CASE WHEN is_public THEN 'viewer' END) END AS role
 FROM p LEFT JOIN repos USING (repo_id) LEFT JOIN members m ON m.repo_id = p.repo_id AND m.user_id = p.user_id""")
def repo_roles(spark, sf_dir):
    pairs = t.given(spark, sf_dir, "events").select((F.col("event_id") % 25).alias("user_id"), (F.col("event_id") % 90).alias("repo_id")).distinct()
    return access.repo_roles(pairs, t.repos(spark, sf_dir), t.members(spark, sf_dir))


@query(f"""WITH {A}, acc AS (SELECT owner_id AS user_id, repo_id FROM repos UNION SELECT user_id, repo_id FROM members UNION SELECT user_id, repo_id FROM users, repos WHERE is_public),
 refs AS (SELECT DISTINCT event_id % 25 AS user_id, CASE WHEN event_id % 10 = 0 THEN 'noslash' ELSE 'nation_' || (event_id % 30) || '/kb-' || (event_id % 100) END AS ref FROM events),
 k AS (SELECT username || '/' || slug AS ref, repo_id FROM repos JOIN users ON owner_id = user_id)
SELECT r.user_id, r.ref, CASE WHEN a.user_id IS NOT NULL THEN k.repo_id END AS repo_id, CASE WHEN r.ref = 'noslash' THEN 'bad_name' WHEN a.user_id IS NULL THEN 'not_found' END AS error FROM refs r LEFT JOIN k USING (ref) LEFT JOIN acc a ON a.user_id = r.user_id AND a.repo_id = k.repo_id""")
def resolve_repo(spark, sf_dir):
    e = F.col("event_id")
    refs = t.given(spark, sf_dir, "events").select((e % 25).alias("user_id"), F.when(e % 10 == 0, "noslash").otherwise(F.concat(F.lit("nation_"), e % 30, F.lit("/kb-"), e % 100)).alias("ref")).distinct()
    users, repos = t.users(spark, sf_dir), t.repos(spark, sf_dir)
    seen = access.visible_repos(users, repos, t.members(spark, sf_dir)).select("user_id", "repo_id")
    return access.resolve(refs, users.withColumnRenamed("user_id", "owner_id"), repos, seen)


@query("""WITH r AS (SELECT p_partkey AS pos, lower(p_name) AS name, lower(p_type || ' ' || replace(p_brand, '#', ' ')) AS descr FROM part WHERE p_partkey % 20 = 0), q AS (SELECT p_partkey AS query_id, lower('find ' || p_name || ' of type ' || p_type) AS question FROM part WHERE p_partkey % 77 = 0),
 w AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(question, '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'an', 'of', 'is', 'are', 'to', 'and', 'or', 'for')))) AS w FROM q),
 rw AS (SELECT pos, 2.0 AS p, unnest(list_distinct(list_filter(regexp_extract_all(name, '[a-z0-9]+'), lambda x: length(x) >= 2))) AS w FROM r UNION ALL SELECT pos, 1.0, unnest(list_distinct(list_filter(regexp_extract_all(descr, '[a-z0-9]+'), lambda x: length(x) >= 2))) FROM r),
 s AS (SELECT q.query_id, r.pos, coalesce((SELECT sum(p) FROM w JOIN rw USING (w) WHERE w.query_id = q.query_id AND rw.pos = r.pos), 0) AS points FROM q, r)
SELECT * FROM (SELECT query_id, pos AS repo_id, CAST(points AS DOUBLE) AS points, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN (SELECT count(*) FROM r) <= 10 THEN 0 ELSE points END DESC, pos) AS rank FROM s) WHERE rank <= 10""")
def repo_preselect(spark, sf_dir):
    part = t.given(spark, sf_dir, "part")
    repos = part.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("repo_id"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("description"), F.col("p_partkey").alias("pos"))
    asked = part.filter("p_partkey % 77 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("find "), "p_name", F.lit(" of type "), "p_type").alias("question"))
    return access.preselect(asked, repos, 10)


@query(f"""WITH {TOKENS}, {ASKED} SELECT term, count(*) AS questions FROM asked WHERE length(term) >= 4 AND term NOT IN (SELECT term FROM tf) GROUP BY term""")
def gap_terms(spark, sf_dir):
    return logs.gap_terms(t.questions(spark, sf_dir), postings(spark, sf_dir)).select("term", "questions")
