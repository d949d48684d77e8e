"""Parts that no query covers: files, names, evidence, prompts, model steps, metadata reports, sinks."""

import json

from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.operators import access, chunking, evidence, facts, fusion, logs, models
from kbspark.sources import files, store
from kbspark.streaming import streams


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text_files_and_snapshots(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: A\n---\nx")
    (tmp_path / "sub" / "b.txt").write_text("plain é")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    got = {r.filename: r.content for r in files.read_text(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.md": "---\ntitle: A\n---\nx", "b.txt": "plain é"}
    pages = spark.createDataFrame([(1, "b.md", "y"), (1, "a.md", "x"), (2, "c.md", "z")], "repo_id long, filename string, content string")
    assert [tuple(r) for r in store.export_snapshot(pages, 1).collect()] == [("a.md", "x"), ("b.md", "y")]


def test_small_text_functions(spark):
    assert column(spark, ["x", None], X.stringify) == ["x", ""]
    assert json.loads(column(spark, [{"a": "1"}], lambda c: X.stringify(c, "map<string,string>"), "map<string,string>")[0]) == {"a": "1"}
    assert column(spark, ["s" * 480, "s" * 481], X.audit_detail) == ["s" * 480, "s" * 479 + "…"]
    assert [len(x) for x in column(spark, ["s" * 600], lambda c: X.audit_detail(c, 10))] == [10]
    assert all(isinstance(x, str) for x in column(spark, [0.5, 2048.0], X.size_display, "double"))


def test_texts_to_embed(spark):
    row = spark.range(1).select(
        chunking.embed_text(F.lit("T"), F.lit("H"), F.lit(" body ")).alias("a"), chunking.embed_text(F.lit("T"), F.lit("T"), F.lit("body")).alias("b"), chunking.embed_text(F.lit(None).cast("string"), F.lit(""), F.lit("body")).alias("c"),
        facts.embed_text(F.lit("f.csv"), F.lit("S"), F.lit(3), F.lit("k=v")).alias("d"), facts.embed_text(F.lit(""), F.lit(""), F.lit(None).cast("int"), F.lit("k=v")).alias("e"),
    ).first()
    assert tuple(row) == ("T / H\n\nbody", "T\n\nbody", "body", "[f.csv | 表=S | 行=3]\nk=v", "k=v")


Q = "repo_id long, query_id long, rank int, filename string"


def test_evidence_to_prompt(spark):
    pages = spark.createDataFrame([(1, 1, 1, "a.md", "# A\ntext"), (1, 1, 2, "b.md", "more")], f"{Q}, content string")
    chunks = spark.createDataFrame([(1, 1, 1, "b.md", 0, "chunk  one", None), (1, 1, 2, "c.md", 3, "chunk two", "c.md#2")], f"{Q}, position int, chunk_text string, neighbor_of string")
    records = spark.createDataFrame([(1, 1, 1, "d.md", "s:1", "k=v"), (1, 1, 2, "a.md", "s:2", "k=w")], f"{Q.replace('filename', 'source_markdown_filename')}, record_id string, fact_text string")
    rows = evidence.evidence_rows(pages, chunks, records)
    assert evidence.allowed_sources(rows).first().allowed == ["a.md", "b.md", "c.md", "d.md"]
    assert evidence.fact_context(records).first().fact_context == "1. k=v\n2. k=w"
    summary = models.evidence_summary(pages, chunks).first().summary
    assert summary == "pages: a.md, b.md\nchunk one\nchunk two"
    prompts = column(spark, ["ctx", ""], lambda c: evidence.build_prompt(F.lit("why?"), F.lit("comparison"), c, F.lit("")))
    assert "Use only the context" in prompts[0] and "Context:\nctx" in prompts[0] and "Use only" not in prompts[1] and prompts[1].endswith("Question: why?")


def test_ordered_distinct_and_merged_pages(spark):
    df = spark.createDataFrame([(1, 1, "b", 2), (1, 1, "a", 1), (1, 1, "b", 0), (1, 1, "", 3), (1, 1, None, 4)], "repo_id long, query_id long, key string, pos int")
    assert [(r.key, r.rank) for r in fusion.ordered_distinct(df, "key", 5).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    chosen = spark.createDataFrame([(1, 1, 1, "x.md"), (1, 1, 2, "gone.md")], Q)
    near = spark.createDataFrame([(1, 1, 1, "y.md"), (1, 1, 2, "x.md")], Q)
    pages = spark.createDataFrame([(1, "x.md"), (1, "y.md")], "repo_id long, filename string")
    assert [r.filename for r in fusion.merged_pages(chosen, near, pages).orderBy("rank").collect()] == ["x.md", "y.md"]


def test_steps_end_when_nothing_is_open(spark):
    first = spark.createDataFrame([(1, 3), (2, 1)], "query_id long, need int")
    step = lambda q, i: q.select("query_id", "need", F.lit(i).alias("round"))
    more = lambda hits: hits.filter("need > 1").select("query_id", (F.col("need") - 1).alias("need"))
    hits = models.retrieve_in_steps(first, step, more)
    assert sorted((r.query_id, r.step) for r in hits.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert models.retrieve_in_steps(first, step, lambda h: h.select("query_id", "need"), most=2).count() == 4


def test_models_write_pages_and_descriptions(spark):
    plan = spark.createDataFrame([(1, "a.md", "update"), (1, "bad.md", "create")], "repo_id long, page string, action string")
    pages = spark.createDataFrame([(1, "a.md", "old text")], "repo_id long, filename string, content string")

    def model(prompt):
        if "bad.md" in prompt:
            raise ValueError("no")
        return f"new of [{prompt}]"

    got = {r.page: (r.content, r.error) for r in models.write_pages(plan, pages, model).collect()}
    assert "old text" in got["a.md"][0] and got["bad.md"] == (None, "no")
    told = models.describe_repos(spark.createDataFrame([(1, "sample")], "repo_id long, sample string"), lambda p: '  "A   line"  ').first()
    assert told.description == "A line"


def test_metadata_reports(spark):
    repos = spark.createDataFrame([(1, 7, True, 1, "r1"), (2, 8, True, 2, "r2"), (3, 8, False, 3, "r3"), (4, 8, True, 4, "r4")], "repo_id long, owner_id long, is_public boolean, updated_at int, name string")
    members = spark.createDataFrame([(4, 7, "reader", 1)], "repo_id long, user_id long, role string, created_at int")
    users = spark.createDataFrame([(7, "u7"), (8, "u8")], "user_id long, username string")
    assert [r.repo_id for r in access.discover(7, repos, members).collect()] == [2]
    assert [r.username for r in logs.repo_people(members, users).collect()] == ["u7"]
    rows = spark.createDataFrame([("t1", 1, 7, '{"n": 3}'), ("t2", 1, None, "not json")], "trace_id string, repo_id long, user_id long, retrieval_json string")
    assert logs.trace_detail("t1", rows, users, repos, "n int").first().evidence.n == 3
    unread = logs.trace_detail("t2", rows, users, repos, "n int").first().evidence
    assert unread is None or unread.n is None
    sizes = logs.disk_usage(spark.createDataFrame([(1, 10), (1, 5), (2, 1)], "repo_id long, length long"))
    assert {tuple(r) for r in sizes.collect()} == {(1, 15, 2), (2, 1, 1)}


def test_traces_on_a_stream(spark, tmp_path):
    schema = "ts timestamp, question string"
    spark.sql("SELECT TIMESTAMP '2024-01-01 17:00:00' AS ts, 'a' AS question UNION ALL SELECT TIMESTAMP '2024-01-01 10:00:00', 'b'").write.json(f"file://{tmp_path}/in")
    query = streams.trace_sink(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    query.awaitTermination()
    assert {(str(r.date), r.question) for r in spark.read.json(f"file://{tmp_path}/out").collect()} == {("2024-01-02", "a"), ("2024-01-01", "b")}


def test_one_rate_decision():
    assert streams.admit([1.0, 2.0], 3.0, 3, 60) == (True, 0.0, [1.0, 2.0, 3.0])
    assert streams.admit([1.0, 2.0, 3.0], 4.0, 3, 60) == (False, 57.0, [1.0, 2.0, 3.0])
    assert streams.admit([1.0, 2.0, 3.0], 61.0, 3, 60) == (True, 0.0, [2.0, 3.0, 61.0])
