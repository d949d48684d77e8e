"""Files in and out, keyed storage, and streams against their batch twins."""

import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kbspark.operators import logs
from kbspark.sources import files, store
from kbspark.streaming import streams


def put(path, **named):
    path.mkdir(exist_ok=True)
    for name, content in named.items():
        (path / name.replace("__", ".")).write_bytes(content if isinstance(content, bytes) else content.encode())
    return f"file://{path}"


def test_pages_and_sources(spark, tmp_path):
    at = put(tmp_path / "w", a__md="---\ntitle: T\ntype: concept\n---\nx", b__md="plain", c__csv="x")
    got = {r.filename: (r.title, r.type) for r in files.read_pages(spark, at).collect()}
    assert got == {"a.md": ("T", "concept"), "b.md": ("b", "unknown")}
    (tmp_path / "w" / ".hidden").write_text("x")
    assert {(r.filename, r.is_markdown) for r in files.list_sources(spark, at).collect()} == {("a.md", True), ("b.md", True), ("c.csv", False)}


def test_csv(spark, tmp_path):
    at = put(tmp_path / "c", t__csv=b"\xef\xbb\xbftitle\na,b\n1,2,3\n", none__csv=b"")
    (row,) = files.read_csv_tables(spark, at).collect()
    assert row.name == "CSV" and row.rows == [["title"], ["a", "b"], ["1", "2", "3"]]
    assert files.read_csv_tables(spark, at, stem_as_name=True).first().name == "t"


def test_parsed(spark, tmp_path):
    at = put(tmp_path / "p", d__pdf=b"bytes")
    got = files.read_parsed(spark, at, lambda n, b: {"md_content": "", "markdown": f"{n}:{len(b)}"}).first()
    assert got.content == "d.pdf:5"


def test_html():
    page = "<html><body><nav>menu</nav><article><h2>Head</h2><p>One <b>two</b> <a href='/x'>link</a><img src=y></p><ul><li>item</li></ul></article><footer>f</footer></body></html>"
    assert files.html_markdown(page) == "## Head\n\nOne two [link](/x)\n\n- item"
    assert files.html_markdown(None) == ""


def test_jsonl_and_traces(spark, tmp_path):
    at = put(tmp_path / "j", r__jsonl='{"record_id": "s:1", "fields": {"a": "1"}}\n\n{"record_id": "s:2"}\n')
    rows = files.read_jsonl(spark, at)
    assert [r.record_id for r in rows.orderBy("record_id").collect()] == ["s:1", "s:2"]
    files.write_jsonl(rows, f"{at}/out")
    assert files.read_jsonl(spark, f"{at}/out").count() == 2
    bad = put(tmp_path / "t", x__jsonl='{"ts": "2024-01-01", "repo": "r"}\nnot json\n')
    assert files.read_traces(spark, bad).count() == 1
    traces = spark.createDataFrame([("2024-01-01 20:00:00", "q")], "ts string, question string").withColumn("ts", F.to_timestamp("ts"))
    files.write_traces(traces, f"file://{tmp_path}/days")
    assert (tmp_path / "days" / "date=2024-01-02").is_dir()


def test_questions(spark, tmp_path):
    at = put(tmp_path / "q", q__json=json.dumps({"questions": [{"id": "a", "expected_pages": ["x.md"]}]}, indent=1))
    assert files.read_questions(spark, at, "id:string, expected_pages:array<string>").first().expected_pages == ["x.md"]


def test_store(spark, tmp_path):
    base = spark.createDataFrame([(1, "a", 0, "old"), (1, "a", 1, "stale"), (2, "b", 0, "keep")], "repo_id long, filename string, position int, text string")
    new = spark.createDataFrame([(1, "a", 0, "v1", 1), (1, "a", 0, "v2", 2)], "repo_id long, filename string, position int, text string, v int")
    got = store.upsert(base, new, ["repo_id", "filename", "position"], ["v"], replace_by=["repo_id", "filename"])
    assert sorted(r.text for r in got.collect()) == ["keep", "v2"]
    path = f"file://{tmp_path}/t"
    store.write(base, path)
    store.write(spark.createDataFrame([(1, "z", 0, "only")], base.schema), path)
    assert sorted(r.text for r in store.scan(spark, path).collect()) == ["keep", "only"]
    assert store.scan(spark, path, [2], ["text"]).columns == ["text"]
    merged = store.import_snapshot(base, spark.createDataFrame([(1, "n", 0, "new")], base.schema))
    assert merged.count() == 4
    gone = store.cascade_delete({"pages": base, "logs": base}, spark.createDataFrame([(1,)], "repo_id long"), nullify=("logs",))
    assert gone["pages"].count() == 1 and gone["logs"].filter("repo_id is null").count() == 2


EVENTS = [(1, i, t) for i, t in enumerate((0, 10, 20, 30, 61, 62, 90, 300))] + [(2, 100, 5)]


@pytest.fixture
def events(spark, tmp_path):
    rows = pd.DataFrame(EVENTS, columns=["repo_id", "event_id", "s"])
    df = spark.createDataFrame(rows.assign(ts=pd.Timestamp("2024-01-01") + pd.to_timedelta(rows["s"], unit="s"))).select("repo_id", "event_id", "ts")
    path = f"file://{tmp_path}/events"
    for i in range(3):  # three files, in the order of time
        df.filter(F.floor(F.col("event_id") % 100 / 3) == i).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_rate_limit(spark, events, tmp_path):
    batch, stream = events
    got = {r.event_id: (r.accepted, r.retry_after) for r in streams.rate_limit(batch).collect()}
    # 3 waits for the event at 0 to leave the window, 5 for that at 10; refused events don't count
    assert {i: wait for i, (ok, wait) in got.items() if not ok} == {3: 30.0, 5: 8.0}
    drained(streams.rate_limit_stream(stream), "rated", tmp_path)
    assert {r.event_id: (r.accepted, r.retry_after) for r in spark.table("rated").collect()} == got


def test_last_used(spark, events, tmp_path):
    batch, stream = (e.withColumnRenamed("repo_id", "token_id") for e in events)
    got = sorted((r.token_id, r.ts) for r in streams.last_used(batch).collect())
    assert [t.timestamp() % 86400 % 3600 for k, t in got if k == 1] == [0, 61, 300]
    drained(streams.last_used_stream(stream), "used", tmp_path)
    assert sorted((r.token_id, r.ts) for r in spark.table("used").collect()) == got


def test_hourly_and_distinct(spark, events, tmp_path):
    batch, stream = events
    assert streams.hourly_counts(batch, "repo_id").filter("repo_id = 1").first().n == 8
    drained(streams.hourly_counts(stream, "repo_id"), "hourly", tmp_path, "complete")
    assert spark.table("hourly").filter("repo_id = 1").first().n == 8
    same = lambda e: e.withColumn("content", (F.col("event_id") % 2).cast("string"))
    drained(streams.distinct_arrivals(same(stream)), "arrived", tmp_path)
    assert spark.table("arrived").count() == streams.distinct_arrivals(same(batch)).count() == 2


def test_ingest_each_file_once(spark, tmp_path):
    at, seen = put(tmp_path / "in", a__md="one"), []
    sink = lambda batch, n: seen.extend(r.content for r in batch.collect())
    for _ in range(2):
        streams.ingest(spark, at, f"file://{tmp_path}/cp", sink).awaitTermination(60)
    put(tmp_path / "in", b__md="two")
    streams.ingest(spark, at, f"file://{tmp_path}/cp", sink).awaitTermination(60)
    assert seen == ["one", "two"]


def test_document_states(spark, events, tmp_path):
    batch, stream = events
    made = lambda e: e.select("repo_id", F.concat(F.lit("s"), F.col("event_id") % 2).alias("source"), F.when(F.col("event_id") > 5, "completed").otherwise("running").alias("status"), F.col("event_id").cast("double").alias("progress"), "ts", "event_id")
    streams.state_sink(made(stream), f"file://{tmp_path}/st", f"file://{tmp_path}/cps").awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "st" / "state").iterdir() if p.name.startswith("v="))
    got = {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/st/state/v={last}").collect()}
    assert got == {tuple(r) for r in logs.document_state(made(batch)).collect()}


def test_stale_tasks(spark, tmp_path):
    minute = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [[(1, "running", minute(0)), (2, "running", minute(0))], [(2, "done", minute(5))], [(3, "queued", minute(60))], [(4, "queued", minute(61))]]
    path = tmp_path / "tasks"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "task_id long, status string, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{path}")
    stream = spark.readStream.schema("task_id long, status string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"file://{path}")
    drained(streams.stale_tasks_stream(stream), "stale", tmp_path)
    assert [tuple(r) for r in spark.table("stale").collect()] == [(1, "failed")]
    batch = spark.createDataFrame([r for p in rows for r in p], "task_id long, status string, started_at timestamp")
    late = logs.stale_tasks(batch, F.lit("2024-01-01 00:31:00").cast("timestamp"))
    assert {r.task_id for r in late.collect()} == {1, 2}
