"""Jobs that rebuild stored tables, settings, reports, and parts of retrieval that no query covers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.operators import chunking, dense, facts, fusion, graph, lexical, models
from kbspark.plans import jobs
from kbspark.plans.config import ChunkConfig, RetrievalConfig
from kbspark.sources import files, store
from kbspark.streaming import streams


def test_frontmatter_lists(spark):
    text = "---\ntitle: 'A b'\ntags:\n  - one\n  - \"two three\"\nflat: [x, 'y z']\nempty:\ntitle: Last\n---\nbody"
    row = spark.createDataFrame([(text,)], "t string").select(X.frontmatter(F.col("t")).alias("f")).first().f
    assert row == {"title": "Last", "tags": "[one, two three]", "flat": "[x, 'y z']"}
    items = spark.createDataFrame([("[one, two three]",), ("[x, 'y z']",), ("single",), (None,), ("[]",)], "v string").select(X.list_items(F.col("v")).alias("i"))
    assert [r.i for r in items.collect()] == [["one", "two three"], ["x", "y z"], ["single"], [], []]
    page = files.page_fields(spark.createDataFrame([("p.md", text)], "filename string, content string")).first()
    assert (page.title, page.type, page.tags) == ("Last", "unknown", ["one", "two three"])


def test_settings_keep_their_names():
    cfg = RetrievalConfig.from_config({"RAG_CHUNK_TOP_K": "7", "RAG_ENABLE_BM25": "off", "RAG_FACT_SCORE_THRESHOLD": 0.5})
    assert (cfg.chunk_top_k, cfg.enable_bm25, cfg.fact_score_threshold, cfg.rrf_k) == (7, False, 0.5, 60)
    assert RetrievalConfig.from_config(None) == RetrievalConfig() and RetrievalConfig().chunk_candidates == 24


def test_long_chunks_are_embedded_whole(spark):
    pages = spark.createDataFrame([(1, "p.md", "T", "word " * 500)], "repo_id long, filename string, title string, content string")
    chunks = chunking.chunk_pages(pages, ChunkConfig(400, 2000, 0))
    assert chunks.agg(F.max(F.length("chunk_text"))).first()[0] > 1500
    assert chunking.stored(chunks).agg(F.max(F.length("chunk_text"))).first()[0] == 1200


def test_rebuilds_replace_whole_repositories(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    pages = spark.createDataFrame([(r, f"p{i}.md", "T", "concept", f"text {r} {i}") for r in (1, 2, 3) for i in range(2)], "repo_id long, filename string, title string, type string, content string")
    jobs.rebuild_chunks(pages, path)
    assert spark.read.parquet(path).count() == 6
    jobs.rebuild_chunks(pages.filter("repo_id = 1 and filename = 'p0.md'"), path, [1, 2], embedder=None)
    assert Counter(r.repo_id for r in spark.read.parquet(path).collect()) == {1: 1, 3: 2}
    jobs.rebuild_pages(pages, f"{path}-pages", models.hash_embedder(), [3])
    assert [(r.repo_id, r.error) for r in spark.read.parquet(f"{path}-pages").collect()] == [(3, None)] * 2
    sheets = spark.createDataFrame([(4, "f.csv", "S", [["a", "b"], ["1", "2"], ["3", ""]])], "repo_id long, source_file string, name string, rows array<array<string>>")
    jobs.rebuild_facts(sheets, f"{path}-facts", embedder=models.hash_embedder())
    got = spark.read.parquet(f"{path}-facts").orderBy("row_index").collect()
    assert [(r.repo_id, r.record_id, r.fields) for r in got] == [(4, "s:1", {"a": "1", "b": "2"}), (4, "s:2", {"a": "3"})] and len(got[0].embedding) > 0


FACTS = "repo_id long, id long, fields map<string,string>, source_file string, source_markdown_filename string, sheet string, row_index int, fact_text string"


def test_fact_switches(spark):
    rows = spark.createDataFrame([(1, i, {"k": f"v{i}"}, "a.csv", "a.md", "T", i, "x" * 900 + f" far{i}") for i in range(1, 6)], FACTS)
    asked = spark.createDataFrame([(1, 1, "far3 please")], "repo_id long, query_id long, question string")
    near = spark.createDataFrame([(1, 1, 2, 0.9, 1)], "repo_id long, query_id long, id long, score double, rank int")
    first = lambda cfg: [r.id for r in fusion.retrieve_facts(asked, rows, near, cfg).orderBy("rank").collect()]
    assert 3 in first(RetrievalConfig())  # a word behind 800 characters is found
    assert first(RetrievalConfig(fact_search_text_chars=800)) == first(RetrievalConfig(enable_fact_keyword=False)) == first(RetrievalConfig(fact_keyword_max_records=4)) == [2]
    tables = jobs.CorpusTables(rows.limit(0), rows, rows.limit(0), fact_postings=lexical.build_postings(facts.search_text(rows), "id", "fact_search_text"))
    assert [r.id for r in tables.search_facts(asked, near).orderBy("rank").collect()] == first(RetrievalConfig())


def test_missing_attributes_come_from_later_channels(spark):
    cols = "repo_id long, query_id long, id long, rank int, sheet string, row_index int, fields map<string,string>"
    a = spark.createDataFrame([(1, 1, 1, 1, "", 0, {}), (1, 1, 2, 2, "S", 4, None)], cols)
    b = spark.createDataFrame([(1, 1, 1, 1, "T", 7, {"k": "v"}), (1, 1, 2, 2, "U", 9, {"x": "y"}), (1, 1, 3, 3, None, 0, None)], cols)
    got = {r.id: (r.sheet, r.row_index, r.fields) for r in fusion.merge_attributes({"dense": a, "bm25": b}, ["sheet", "row_index", "fields"]).collect()}
    assert got == {1: ("T", 7, {"k": "v"}), 2: ("S", 4, {"x": "y"}), 3: (None, None, None)}


def test_dense_presets(spark):
    vectors = spark.createDataFrame([(1, f"p{i}.md", [float(i), 1.0]) for i in range(20)] + [(1, "none.md", None)], "repo_id long, filename string, embedding array<double>")
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, None)], "repo_id long, query_id long, embedding array<double>")
    got = dense.semantic_search(asked, vectors).orderBy("rank").collect()
    assert [r.id for r in got][:2] == ["p19.md", "p18.md"] and len(got) == 15
    hits = spark.createDataFrame([(1, 0.5), (2, 0.4)], "point_id long, score double")
    assert [(r.point_id, r.title) for r in dense.with_metadata(hits, spark.createDataFrame([(1, "a", 9.0)], "point_id long, title string, score double")).collect()] == [(1, "a")]


def test_lint_report(spark):
    issues = spark.createDataFrame([(1, "orphan", "a.md", "x"), (1, "contradiction", "b.md", "y"), (1, "new_kind", None, "z")], "repo_id long, type string, page string, description string")
    rows = graph.lint_report(issues, spark.createDataFrame([(1, "more")], "repo_id long, message string")).collect()
    assert {(r.part, r.page_slug, r.fixable) for r in rows} == {("orphan_pages", "a", True), ("contradictions", "b", False), ("missing_refs", None, False), ("suggestions", None, False)}


def test_deleting_documents_mends_logs_and_index(spark):
    pages = spark.createDataFrame([(1, "a.md", "A", "concept", "a.pdf", ""), (1, "b.md", "B", "concept", "b.pdf", "")], "repo_id long, filename string, title string, type string, source string, content string")
    logs = spark.createDataFrame([(1, "# Log\n## t — Ingested `a.pdf`\n- Created: a.md\n## t — Ingested `b.pdf`\n- Created: b.md\n")], "repo_id long, content string")
    gone = spark.createDataFrame([(1, "a.pdf")], "repo_id long, source_file string")
    left = graph.delete_documents(gone, pages, pages.select("repo_id", "filename"), pages.select("repo_id", F.col("source").alias("source_file")), logs)
    assert "a.md" not in left["index"].first().content and "b.md" in left["index"].first().content
    assert "a.pdf" not in left["logs"].first().content and "b.pdf" in left["logs"].first().content


def test_users_go_with_their_repositories(spark):
    repos = spark.createDataFrame([(1, 7), (2, 8)], "repo_id long, owner_id long")
    logs = spark.createDataFrame([(1, 9), (2, 7), (2, 8)], "repo_id long, user_id long")
    tokens = spark.createDataFrame([(7,), (8,)], "user_id long")
    out = store.cascade_delete_users({"repos": repos, "logs": logs, "tokens": tokens}, spark.createDataFrame([(7,)], "user_id long"), repos, nullify=("logs",))
    assert out["repos"].collect() == [(2, 8)] and sorted(out["logs"].collect(), key=str) == [(2, 8), (2, None)] and out["tokens"].collect() == [(8,)]


@pytest.mark.parametrize("k", [1, 3])
def test_pages_are_selected_by_title_and_beginning(spark, k):
    pages = spark.createDataFrame([(1, f"p{i}.md", f"Title {i}", f"---\nx: y\n---\n# Head\nalpha{i} beta") for i in range(6)], "repo_id long, filename string, title string, content string")
    asked = spark.createDataFrame([(1, 1, "what of alpha4")], "repo_id long, query_id long, question string")
    assert [r.id for r in lexical.select_pages(asked, pages, k).orderBy("rank").collect()][0] == "p4.md"


def test_written_postings_give_the_same_hits(spark, tmp_path):
    docs = spark.createDataFrame([(1, i, f"w{i} w{i % 3} common") for i in range(30)], "repo_id long, id long, text string")
    asked = spark.createDataFrame([(1, q, f"w{q} common") for q in range(4)], "repo_id long, query_id long, question string")
    p = lexical.build_postings(docs, "id", "text")
    p.write(f"file://{tmp_path}/p")
    rows = lambda x: sorted(tuple(r) for r in lexical.bm25_topk(asked, x, 5).collect())
    assert rows(p) == rows(lexical.Postings.read(spark, f"file://{tmp_path}/p"))


def test_session_buffers_on_a_stream(spark, tmp_path):
    schema = "session_key string, ts timestamp, role string, text string"
    row = lambda s, i, role: (s, f"2024-01-01 00:00:{i:02d}", role, f"{role} {i}")
    told = []
    listener = streams.Progress(lambda name, batch, n: told.append((name, batch, n)))
    spark.streams.addListener(listener)
    for n, part in enumerate(([row("a", i, "user" if i % 2 else "assistant") for i in range(15)], [row("a", i, "user" if i % 2 else "assistant") for i in range(15, 30)])):
        spark.createDataFrame(part, "session_key string, ts string, role string, text string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        out = streams.session_buffer_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
        got = []
        query = out.writeStream.queryName("buffers").outputMode("update").foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    spark.streams.removeListener(listener)
    last = got[-1]
    assert last.title == "user 1" and len(last.texts) == 20 and last.texts[-1] == "user 29" and last.texts[0] == "assistant 10"
    assert sum(n for name, _, n in told if name == "buffers" and n > 0) in (0, 15, 30)  # the listener is told later


def test_gold_passages_of_any_length(spark, tmp_path):
    from kbspark.plans import search

    texts = ["one two three four five six seven eight", "x one two threefour", "Zone two threes here", "on e", "a b c d e f g", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    items = ["one", "one two three", "two three four five", "two three four five six seven eight", "a b c d e", "b c d e f", "on", "missing words are here now", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.page) for r in search.gold(spark, f"file://{tmp_path}").collect()}
    assert got == {(i, d) for i, p in enumerate(items) for d, x in enumerate(texts) if p and x and p in x}
