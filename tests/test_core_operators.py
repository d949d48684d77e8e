"""Chunks, facts, search, fusion, evidence, graph, access, scores on small cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kbspark.operators import access, chunking, dense, evaluate, evidence, facts, fusion, graph, lexical, logs, models
from kbspark.plans.config import ChunkConfig, RetrievalConfig


def chunks_of(spark, text, **cfg):
    df = spark.createDataFrame([(1, "p.md", text)], "repo_id long, filename string, content string")
    return [(r.heading, r.chunk_text) for r in chunking.chunk_pages(df, ChunkConfig(**cfg)).orderBy("position").collect()]


def test_chunks(spark):
    assert chunks_of(spark, "") == []
    assert chunks_of(spark, "plain text") == [("", "plain text")]
    assert chunks_of(spark, "# A\nshort\n\n## B\nalso") == [("A", "short\n\nalso")]
    assert chunks_of(spark, "---\nt: x\n---\n##### five\nbody") == [("", "##### five\nbody")]


def test_long_chunks(spark):
    rng = random.Random(1)
    text = " ".join("word" * rng.randint(1, 3) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(700))
    got = [c for _, c in chunks_of(spark, text)]
    assert all(0 < len(c) <= 1200 for c in got) and len(got) > 2
    at = 0
    for c in got:  # in order, with at most the overlap in common and nothing but blanks between
        start = text.index(c, max(0, at - 81))
        assert start <= at or not text[at:start].strip()
        at = start + len(c)
    assert not text[at:].strip()


def test_clamps():
    assert ChunkConfig(10, 50, 900) == ChunkConfig(100, 200, 50)


def test_sheets(spark):
    rows = [["Report"], [None, ""], ["name", "", "name", "n"], ["a", "1", "b"], ["", "", "", ""], ["c", "", "", "4", "more"]]
    df = spark.createDataFrame([("f.csv", "My Sheet", rows), ("g.csv", None, [["x"], ["y"]]), ("h.csv", "E", [["", None]])], "source_file string, name string, rows array<array<string>>")
    got = {r.record_id: r for r in facts.sheets_to_facts(df).collect()}
    assert got["my-sheet:1"].fields == {"name": "a", "col_2": "1", "name_2": "b"}
    assert got["my-sheet:2"].fields == {"name": "c", "n": "4"}
    assert got["my-sheet:2"].fact_text == "来源=f.csv; 表=My Sheet; 行=2; name=c; n=4"
    assert got["sheet1:1"].fields == {"x": "y"} and len(got) == 3
    table = facts.sheets_to_markdown(df).filter("source_file = 'f.csv'").first().markdown
    assert table.split("\n")[0] == "| name | col_2 | name_2 | n |" and table.split("\n")[3] == "| c |  |  | 4 |"


def okapi(docs, query):
    n, lengths = len(docs), {i: len(d) for i, d in docs.items()}
    mean = sum(lengths.values()) / n
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    low = 0.25 * sum(idf.values()) / len(idf)
    score = lambda d, i: sum(max(idf[w], low) if idf[w] >= 0 else low for w in []) + sum((idf[w] if idf[w] >= 0 else low) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * lengths[i] / mean)) for w in query if w in d)
    return {i: s for i, d in docs.items() if (s := score(d, i)) > 0}


def test_bm25_against_a_model(spark):
    rng = random.Random(2)
    docs = {i: [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))] for i in range(30)}
    df = spark.createDataFrame([(1, i, " ".join(d)) for i, d in docs.items()], "repo_id long, id long, text string")
    asked = spark.createDataFrame([(1, 1, "a b b"), (1, 2, "zzz"), (1, 3, "h")], "repo_id long, query_id long, question string")
    got = lexical.bm25_topk(asked, lexical.build_postings(df, "id", "text"), 100).collect()
    for q, words in ((1, "abb"), (2, []), (3, "h")):
        expected = okapi(docs, list(words))
        mine = {r.id: r.score for r in got if r.query_id == q}
        assert mine.keys() == expected.keys() and all(mine[i] == pytest.approx(s, abs=1e-6) for i, s in expected.items())


def test_tiny_corpus_needs_plain_frequency(spark):
    df = spark.createDataFrame([(1, 1, "one word"), (1, 2, "two")], "repo_id long, id long, text string")
    asked = spark.createDataFrame([(1, 1, "one")], "repo_id long, query_id long, question string")
    p = lexical.build_postings(df, "id", "text")
    assert lexical.bm25_topk(asked, p).count() == 0
    assert [(r.id, r.score) for r in lexical.bm25_topk(asked, p, variant="tf").collect()] == [(1, 1.0)]


def hits(spark, rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "repo_id long, query_id long, id string, score double, rank int")


def test_fusion(spark):
    got = fusion.rrf_fuse({"dense": hits(spark, [("a", 0.9, 1), ("b", 0.8, 2)]), "bm25": hits(spark, [("b", 3.0, 1)])})
    top = fusion.ranked(got, "id").orderBy("rank").collect()
    assert [r.id for r in top] == ["b", "a"] and top[0].sources == ["bm25", "dense"] and top[0].fused == pytest.approx(1 / 61 + 1 / 62)
    assert top[1].bm25_score == 0.0


def test_cap_and_neighbours(spark):
    df = spark.createDataFrame([(1, 1, f"c{i}", f, i, i + 1) for i, f in enumerate("xxxyz")], "repo_id long, query_id long, id string, filename string, position int, rank int")
    assert [r.id for r in fusion.cap_per_file(df, 2, 3).orderBy("rank").collect()] == ["c0", "c1", "c3"]
    chunks = spark.createDataFrame([(1, "x", i) for i in range(4)], "repo_id long, filename string, position int")
    near = lambda at: [(r.position, r.neighbor_of) for r in fusion.expand_neighbors(df.limit(0).union(spark.createDataFrame([(1, 1, "c", "x", p, i + 1) for i, p in enumerate(at)], df.schema)), chunks, 1).orderBy("rank").collect()]
    assert near([1]) == [(1, None), (0, "x#1"), (2, "x#1")]
    assert [p for p, _ in near([1, 2])] == [1, 0, 2, 3]


def test_dense(spark):
    rng = random.Random(3)
    vecs = [(1, i, f"f{i % 3}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(50)]
    df = spark.createDataFrame(vecs, "repo_id long, id long, file string, embedding array<float>")
    asked = df.filter("id < 3").select("repo_id", F.col("id").alias("query_id"), "embedding")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    for rows in (50, 13):
        got = dense.dense_topk(asked, df, 4, exclude_self=True, block_rows=rows).collect()
        for q in range(3):
            expected = sorted((i for i in range(50) if i != q), key=lambda i: -cos(vecs[q][3], vecs[i][3]))[:4]
            assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == expected


def test_exact_facts(spark):
    df = spark.createDataFrame([(1, 1, {"region": "East", "revenue": "1200"}, "s.csv", "s.md", "S"), (1, 2, {"region": "West"}, "s.csv", "s.md", "S")], "repo_id long, id long, fields map<string,string>, source_file string, source_markdown_filename string, sheet string")
    asked = spark.createDataFrame([(1, 1, "Which region has 1200 in east?"), (1, 2, "only region"), (1, 3, "north")], "repo_id long, query_id long, question string")
    got = {(r.query_id, r.id): r.score for r in fusion.exact_fact_scores(asked, df).collect()}
    # "s" is an origin of one ASCII letter and occurs in the first question
    assert got[1, 1] == pytest.approx(1 + 0.8 + 1 + 0.3 + 0.2) and got[1, 2] == pytest.approx(0.3 + 0.2)
    assert (2, 1) not in got and (3, 1) not in got


def test_facts_without_matches_stay_dense(spark):
    df = facts.search_text(spark.createDataFrame([(1, 1, {"k": "v1"}, "a.csv", "a.md", "T", 1, "x"), (1, 2, {"k": "w2"}, "a.csv", "a.md", "T", 2, "y"), (1, 3, {"k": "u3"}, "a.csv", "a.md", "T", 3, "z")], "repo_id long, id long, fields map<string,string>, source_file string, source_markdown_filename string, sheet string, row_index int, fact_text string"))
    asked = spark.createDataFrame([(1, 1, "v1?"), (1, 2, "qqq")], "repo_id long, query_id long, question string")
    near = spark.createDataFrame([(1, q, i, s, r) for q in (1, 2) for r, (i, s) in enumerate([(2, 0.9), (1, 0.5)], 1)], "repo_id long, query_id long, id long, score double, rank int")
    got = fusion.retrieve_facts(asked, df, near, RetrievalConfig()).orderBy("query_id", "rank").collect()
    assert [r.id for r in got if r.query_id == 1][0] == 1
    assert [(r.id, r.fused) for r in got if r.query_id == 2] == [(2, 0.9), (1, 0.5)]


def test_confidence(spark):
    cols = "wiki_hit_count int, chunk_hit_count int, top_chunk_score double, hit_overview boolean, both_channels boolean, answer_text string, fact_hit_count int, top_fact_score double, fact_channel boolean"
    unsure = "当前知识库中缺少直接证据"
    rows = [(3, 4, 0.90, True, True, "", 0, 0.0, False), (1, 2, 0.6, False, False, "", 0, 0.0, False), (0, 0, 0.0, False, False, "", 0, 0.0, False), (2, 0, 0.0, False, False, "", 0, 0.0, False), (1, 2, 0.6, False, False, unsure, 0, 0.0, False)]
    got = [(r.score, r.level) for r in evidence.confidence(spark.createDataFrame(rows, cols).coalesce(1)).collect()]
    assert got == [(1.0, "high"), (0.55, "medium"), (0.0, "low"), (0.45, "low"), (0.35, "low")]


def test_penalty_and_citations(spark):
    df = spark.createDataFrame([(0.80, "high", ["x"]), (0.10, "low", ["x"]), (0.80, "high", [])], "score double, level string, unknown array<string>").coalesce(1)
    assert [(r.score, r.level) for r in evidence.penalize(df).collect()] == [(0.55, "medium"), (0.0, "low"), (0.80, "high")]
    row = spark.range(1).select(evidence.check_citations(F.lit("a.md b.pdf c.xlsx d.csv"), F.array(F.lit("a.md"), F.lit("b.pdf"), F.lit("d.csv"))).alias("c")).first().c
    assert (row.cited, row.unknown, row.ok) == (["a.md", "b.pdf", "c.xlsx", "d.csv"], ["c.xlsx"], False)


@pytest.fixture(scope="module")
def pages(spark):
    text = lambda head, body: f"---\n{head}\nupdated: x\n---\n{body}"
    rows = [("a.md", text("title: A\ntype: concept", "[b](b.md) [gone](gone.md)")), ("b.md", text("title: B\ntype: odd", "[a](a)")), ("index.md", "[a](a.md)"), ("c.md", "no front")]
    from kbspark.sources.files import page_fields

    return page_fields(spark.createDataFrame([(1, *r) for r in rows], "repo_id long, filename string, content string"))


def test_graph(spark, pages):
    issues = {(r.type, r.page) for r in graph.lint(pages, spark.createDataFrame([(1, "concept")], "repo_id long, type string")).collect()}
    assert issues == {("orphan", "c.md"), ("broken_link", "a.md"), ("bad_frontmatter", "c.md"), ("wrong_type", "b.md")}
    assert {(r.target, r.filename) for r in graph.backlinks(pages).collect()} == {("b.md", "a.md"), ("a.md", "b.md"), ("a.md", "index.md")}
    assert "- [A](a.md)" in graph.index_page(pages).first().content
    expected = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], "repo_id long, source string, target string")
    assert {(r.source, r.found) for r in graph.cross_references(expected, pages).collect()} == {("a.md", True), ("b.md", False)}


def test_derived_pages(spark):
    p = spark.createDataFrame([(1, f, s, "") for f, s in (("rep.md", None), ("rep-x.md", None), ("report.md", None), ("z.md", "rep.pdf"))], "repo_id long, filename string, source string, content string")
    s = spark.createDataFrame([(1, "rep.pdf")], "repo_id long, source_file string")
    assert {r.filename for r in graph.pages_from_sources(p, s).collect()} == {"rep.md", "rep-x.md", "z.md"}


def test_ingest_log(spark):
    log = "# Log\n## t1 — Ingested `a.pdf`\n- Created: a.md, index.md\n## t2 — Ingested `b.pdf`\n- Updated: b.md\n## t3 — Ingested `a.pdf`\n- Created: [c](c.md)\n"
    df = spark.createDataFrame([(1, log)], "repo_id long, content string")
    parsed = graph.ingest_log(df)
    assert {r.source: r.pages for r in parsed.collect()} == {"a.pdf": ["c.md"], "b.pdf": ["b.md"]}
    left = graph.drop_log_sections(df, spark.createDataFrame([(1, "a.pdf")], "repo_id long, source string")).first().content
    assert left == "# Log\n## t2 — Ingested `b.pdf`\n- Updated: b.md\n"
    state = spark.createDataFrame([(1, "a.pdf", [], None, None), (1, "x", ["x.md"], None, None)], "repo_id long, source string, affected_pages array<string>, created array<string>, updated array<string>")
    assert {r.source: r.pages for r in graph.affected_pages(state, parsed).collect()} == {"a.pdf": ["c.md"], "x": ["x.md"]}


def test_sampler_stops_at_the_first_page_that_does_not_fit(spark):
    df = spark.createDataFrame([(1, f"p{i:02}.md", "w" * (300 if i != 3 else 400)) for i in range(40)] + [(1, "index.md", "x")], "repo_id long, filename string, content string")
    r = graph.sample_pages(df, max_chars=1250).first()
    assert r.n_pages == 3 and r.truncated
    none = graph.sample_pages(df.filter("filename = 'index.md'"), spark.createDataFrame([(1, "raw.pdf")], "repo_id long, source_file string")).first()
    assert none.sample == "raw.pdf"


def test_routing(spark):
    repos = spark.createDataFrame([(i, f"name{i}", "about cats" if i == 9 else "", i) for i in range(12)], "repo_id long, name string, description string, pos int")
    asked = spark.createDataFrame([(1, "cats or name11"), (2, "nothing")], "query_id long, question string")
    got = access.preselect(asked, repos, 3).orderBy("query_id", "rank").collect()
    assert [r.repo_id for r in got] == [11, 9, 0, 0, 1, 2]
    few = access.preselect(asked, repos.limit(3), 3).orderBy("query_id", "rank").collect()
    assert [r.repo_id for r in few] == [0, 1, 2, 0, 1, 2]
    chosen = spark.createDataFrame([(1, 11, 1.7), (2, 77, 0.9)], "query_id long, repo_id long, confidence double")
    routed = {r.query_id: r for r in access.route(access.preselect(asked, repos, 3), chosen).collect()}
    assert (routed[1].repo_id, routed[1].confidence) == (11, 1.0) and routed[2].error == "selected_not_in_candidates"


def test_gold_scores(spark):
    cols = "answer string, level string, hit_pages array<string>, expected_pages array<string>, expected_keywords array<string>, must_abstain boolean, forbidden array<string>, facts array<struct<record_id:string,sheet:string,row_index:int,fields:map<string,string>>>, expected_facts array<struct<record_id:string,sheet:string,row_index:int,field_substrings:array<string>>>"
    fact = [("s:1", "S", 1, {"a": "x1"})]
    row = ("kw and BAD", "high", ["d/p1.md"], ["p1", "p2"], ["kw"], False, ["bad"], fact, [(None, "S", 1, ["x1"])])
    r = evaluate.score_answers(spark.createDataFrame([row], cols)).first()
    assert (r.page_recall, r.fact_row, r.keywords, r.abstain, r.comparison) == (0.5, 1.0, 1.0, 1.0, 0.0) and r.aggregate == pytest.approx(0.7)


def test_models(spark):
    df = spark.createDataFrame([(i, "bad" if i == 2 else f"t{i}") for i in range(5)], "id long, text string").coalesce(1)

    def embedder(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    got = {r.id: (r.embedding, r.error) for r in models.embed(df, "text", embedder).collect()}
    assert got[2] == (None, "no") and got[1] == ([2.0], None)
    model = lambda p: '```json\n{"items": ["q1", "q2", "q1"]}\n```' if "t1" in p else "not json"
    parts = models.decompose(df.withColumnRenamed("text", "question").filter("id in (1, 3)"), model).orderBy("id", "pos").collect()
    assert [r.sub_question for r in parts] == ["q1", "q2", "t3"]
    hyde = {r.id: r.dense_query for r in models.hyde(df.withColumnRenamed("text", "question"), lambda p: "a long enough draft" if "t1" in p else "short").collect()}
    assert hyde[1] == "t1\na long enough draft" and hyde[3] == "t3"
    plan = models.plan_pages(models.analyse_sources(df.filter("id = 1").withColumnRenamed("text", "content"), lambda p: '{"summary": "s"}'), lambda p: '{"create": ["a.md"], "update": ["b.md"]}')
    assert {(r.action, r.page) for r in plan.collect()} == {("create", "a.md"), ("update", "b.md")}
    enough, more = models.critique(spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, summary string"), lambda p: '{"sufficient": false, "follow_ups": ["z"]}' if p.endswith("y") else '{"sufficient": true}')
    assert [r.query_id for r in enough.collect()] == [1] and [r.question for r in more.collect()] == ["z"]


def test_fixes(spark, pages):
    issues = spark.createDataFrame([(1, "orphan", "a.md", "d"), (1, "contradiction", "a.md", "d"), (1, "wrong_type", "zz.md", "d")], "repo_id long, type string, page string, description string")
    got = {(r.type, r.status) for r in models.apply_fixes(issues, pages, lambda p: "new").collect()}
    assert got == {("orphan", "fixed"), ("contradiction", "skipped"), ("wrong_type", "page is missing")}


def test_reports(spark):
    tasks = spark.createDataFrame([(1, 1, "a", "done"), (2, 1, "a", "queued"), (3, 1, "b", "failed")], "task_id long, repo_id long, source_file string, status string").withColumn("created_at", F.col("task_id"))
    sources = tasks.select("repo_id", "source_file").distinct()
    assert [r.source_file for r in logs.pending_sources(sources, tasks).collect()] == ["b"]
    state = {r.source_file: (r.ingested, r.task_id) for r in logs.sources_with_tasks(sources, tasks).collect()}
    assert state == {"a": (True, 2), "b": (False, None)}
