"""Queries on logs, tasks, sessions, answers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.operators import evaluate, logs
from kbspark.plans import tables as t
from kbspark.plans.registry import query
from kbspark.streaming import streams

LOGS, TASKS, A = t.LOGS, t.TASKS, t.ACCESS


@query(f"WITH {LOGS}, {A} SELECT l.trace_id, l.repo_id, name AS repo_name, l.user_id, username, confidence, query_mode FROM logs l JOIN repos USING (repo_id) LEFT JOIN users u ON u.user_id = l.user_id WHERE confidence = 'low' ORDER BY created_at DESC, event_id DESC LIMIT 30 OFFSET 30")
def query_log_report(spark, sf_dir):
    rows = logs.query_log_report(t.logs(spark, sf_dir), t.users(spark, sf_dir), t.repos(spark, sf_dir), F.col("confidence") == "low")
    return logs.page(rows, 2, 30, F.desc("created_at"), F.desc("event_id")).select("trace_id", "repo_id", "repo_name", "user_id", "username", "confidence", "query_mode")


@query(f"""WITH {LOGS}, {A}, fb AS (SELECT 't' || doc_id AS trace_id, doc_id % 120 AS repo_id, doc_id % 30 AS user_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS rating FROM labels)
SELECT fb.trace_id, fb.repo_id, r.name AS repo_name, username, rating, l.question, l.confidence FROM fb JOIN repos r ON r.repo_id = fb.repo_id LEFT JOIN users u ON u.user_id = fb.user_id LEFT JOIN logs l ON l.trace_id = fb.trace_id""")
def feedback_report(spark, sf_dir):
    d = F.col("doc_id")
    fb = t.given(spark, sf_dir, "labels").select(F.concat(F.lit("t"), d).alias("trace_id"), (d % 120).alias("repo_id"), (d % 30).alias("user_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("rating"))
    rows = logs.feedback_report(fb, t.users(spark, sf_dir), t.repos(spark, sf_dir), t.logs(spark, sf_dir))
    return rows.select("trace_id", "repo_id", "repo_name", "username", "rating", "question", "confidence")


@query("SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM labels")
def feedback_totals(spark, sf_dir):
    return logs.feedback_totals(t.given(spark, sf_dir, "labels").withColumn("rating", F.when(F.col("quality") == 1, "good").otherwise("bad")))


@query(f"WITH {LOGS} SELECT confidence, count(*) AS n FROM logs GROUP BY ALL")
def confidence_counts(spark, sf_dir):
    return logs.confidence_counts(t.logs(spark, sf_dir))


@query(f"WITH {LOGS}, {A} SELECT repo_id, count(*) AS queries, name FROM logs JOIN repos USING (repo_id) GROUP BY repo_id, name ORDER BY queries DESC, repo_id LIMIT 10")
def top_repos(spark, sf_dir):
    return logs.top_repos(t.logs(spark, sf_dir), t.repos(spark, sf_dir))


@query(f"WITH {LOGS}, {A} SELECT r.repo_id, owner_id, name, slug, is_public, (SELECT count(*) FROM logs l WHERE l.repo_id = r.repo_id) AS queries FROM repos r")
def repo_usage(spark, sf_dir):
    return logs.repo_usage(t.repos(spark, sf_dir).drop("updated_at"), t.logs(spark, sf_dir))


@query(f"WITH {TASKS} SELECT repo_id, count(*) AS total, count(*) FILTER (status IN ('queued', 'running')) AS active, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM tasks GROUP BY repo_id")
def task_status(spark, sf_dir):
    return logs.task_status(t.tasks(spark, sf_dir))


def _sources(spark, sf_dir):
    return t.tasks(spark, sf_dir).select("repo_id", "source_file").distinct()


@query(f"WITH {TASKS}, src AS (SELECT repo_id, source_file FROM tasks UNION SELECT doc_id % 20, 'upload-' || (doc_id % 900) || '.pdf' FROM documents) SELECT DISTINCT repo_id, source_file FROM src s WHERE NOT EXISTS (SELECT 1 FROM tasks x WHERE x.repo_id = s.repo_id AND x.source_file = s.source_file AND status IN ('done', 'queued', 'running'))")
def pending_sources(spark, sf_dir):
    raw = t.given(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("repo_id"), F.concat(F.lit("upload-"), F.col("doc_id") % 900, F.lit(".pdf")).alias("source_file"))
    return logs.pending_sources(_sources(spark, sf_dir).union(raw).distinct(), t.tasks(spark, sf_dir))


@query(f"""WITH {TASKS}, a AS (SELECT repo_id, source_file, max(CASE WHEN status = 'done' THEN 1 ELSE 0 END) = 1 AS ingested, arg_max(task_id, task_id) FILTER (status IN ('queued', 'running')) AS task_id, arg_max(status, task_id) FILTER (status IN ('queued', 'running')) AS task_status FROM tasks GROUP BY ALL) SELECT * FROM a""")
def source_tasks(spark, sf_dir):
    return logs.sources_with_tasks(_sources(spark, sf_dir), t.tasks(spark, sf_dir))


@query(f"WITH {TASKS} SELECT task_id, repo_id, 'failed' AS status FROM tasks WHERE status = 'running' AND started_at < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def stale_tasks(spark, sf_dir):
    rows = t.tasks(spark, sf_dir)
    now = rows.agg(F.max("started_at")).first()[0]
    return logs.stale_tasks(rows, F.lit(now)).select("task_id", "repo_id", "status")


@query("""WITH e AS (SELECT event_id % 50 AS repo_id, 'upload-' || (event_id % 300) || '.pdf' AS source, event_type, CAST(value AS INTEGER) AS progress, row_number() OVER (PARTITION BY event_id % 50, event_id % 300 ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT repo_id, source, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END AS status FROM e WHERE n = 1""")
def document_state(spark, sf_dir):
    e = F.col("event_id")
    rows = t.given(spark, sf_dir, "events").select((e % 50).alias("repo_id"), F.concat(F.lit("upload-"), e % 300, F.lit(".pdf")).alias("source"), F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("status"), F.col("value").alias("progress"), "ts", "event_id")
    return logs.document_state(rows).select("repo_id", "source", "status")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), h AS (SELECT conv_id, substr(arg_min(text, turn), 1, 60) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT m.conv_id, any_value(title) AS title, count(*) AS n_messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS md5 FROM m LEFT JOIN h USING (conv_id) WHERE n <= 20 GROUP BY m.conv_id""")
def session_buffer(spark, sf_dir):
    rows = logs.session_buffers(t.given(spark, sf_dir, "conversations"))
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return rows.select("conv_id", "title", "n_messages", F.md5(joined.cast("binary")).alias("md5"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, md5(string_agg(role || ': ' || substr(text, 1, 500), chr(10) ORDER BY turn)) AS md5 FROM m WHERE n <= 6 GROUP BY conv_id""")
def history_block(spark, sf_dir):
    rows = logs.session_buffers(t.given(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.md5(X.history_block(F.col("messages")).cast("binary")).alias("md5"))


@query(f"WITH {LOGS} SELECT trace_id, question, confidence, query_mode, created_at FROM logs WHERE contains(lower(question), '9') AND confidence = 'medium' ORDER BY created_at DESC, trace_id DESC LIMIT 20")
def log_tail(spark, sf_dir):
    rows = t.logs(spark, sf_dir).withColumn("answer", F.lit(""))
    return logs.search_log(rows, "9", level="medium").select("trace_id", "question", "confidence", "query_mode", "created_at")


@query(f"SELECT mode, count(*) AS n FROM ({t.MODES}) GROUP BY ALL")
def query_mode(spark, sf_dir):
    rows = t.given(spark, sf_dir, "conversations")
    return rows.select(X.query_mode(F.col("text"), *t.MODE_WORDS).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'vs') THEN 'comparison' ELSE 'generic' END AS intent FROM conversations")
def query_intent(spark, sf_dir):
    return t.given(spark, sf_dir, "conversations").select("conv_id", "turn", X.query_intent(F.col("text")).alias("intent"))


GOLD = """g AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS page_recall, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS fact_row,
 (CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'und') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS keywords,
 CASE WHEN doc_id % 5 = 0 AND doc_id % 10 <> 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS abstain, CASE WHEN contains(lower(text), 'eaux') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS comparison FROM documents),
 s AS (SELECT *, (page_recall + fact_row + keywords + abstain + comparison) / 5 AS aggregate FROM g)"""


def _scores(spark, sf_dir):
    d = F.col("doc_id")
    fact = lambda row: F.array(F.struct(F.lit("csv:1").alias("record_id"), F.lit("CSV").alias("sheet"), row.cast("int").alias("row_index"), F.create_map(F.lit("name"), F.lit("ring")).alias("fields")))
    want = F.array(F.struct(F.lit(None).cast("string").alias("record_id"), F.lit("CSV").alias("sheet"), F.lit(1).alias("row_index"), F.array(F.lit("rin")).alias("field_substrings")))
    rows = t.given(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("answer"), F.when(d % 10 == 0, "low").otherwise("high").alias("level"), F.when(d % 2 == 0, F.array(F.lit("wiki/a.md"))).otherwise(F.array(F.lit("a"), F.lit("b.md"))).alias("hit_pages"),
        F.array(F.lit("a.md"), F.lit("x/b")).alias("expected_pages"), F.array(F.lit("the"), F.lit("und")).alias("expected_keywords"), (d % 5 == 0).alias("must_abstain"), F.array(F.lit("EAUX ")).alias("forbidden"),
        fact(F.when(d % 3 == 0, 2).otherwise(1)).alias("facts"), want.alias("expected_facts"), F.when(d % 4 == 0, "deep").otherwise("standard").alias("mode"), (d - 3).alias("latency_ms"),
    )
    return evaluate.score_answers(rows)


@query(f"WITH {GOLD} SELECT doc_id, page_recall, fact_row, keywords, abstain, comparison, round(aggregate, 6) AS aggregate FROM s")
def gold_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", "page_recall", "fact_row", "keywords", "abstain", "comparison", F.round("aggregate", 6).alias("aggregate"))


@query(f"WITH {GOLD} SELECT CASE WHEN doc_id % 4 = 0 THEN 'deep' ELSE 'standard' END AS mode, count(*) AS n, round(avg(aggregate), 4) AS mean_score, round(avg(CASE WHEN doc_id - 3 >= 0 THEN doc_id - 3 END), 4) AS mean_latency FROM s GROUP BY 1")
def mode_summary(spark, sf_dir):
    return evaluate.mode_summary(_scores(spark, sf_dir))


@query("SELECT doc_id, (CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'und') THEN 1 ELSE 0 END) / 2.0 AS coverage, contains(lower(text), 'eaux') AS forbidden FROM documents")
def keyword_coverage(spark, sf_dir):
    keys = F.array(F.lit("the"), F.lit("und"))
    return t.given(spark, sf_dir, "documents").select("doc_id", evaluate.keyword_coverage(F.col("text"), keys).alias("coverage"), (F.size(evaluate.forbidden_hits(F.col("text"), F.array(F.lit("EAUX")))) > 0).alias("forbidden"))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS high, 0::BIGINT AS medium, count(*) FILTER (quality = 0) AS low, round(avg(doc_id % 4), 6) AS mean_wiki_hits, round(avg(doc_id % 6), 6) AS mean_chunk_hits FROM labels")
def set_summary(spark, sf_dir):
    d = F.col("doc_id")
    rows = t.given(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "high").otherwise("low").alias("level"), (d % 4).alias("wiki_hits"), (d % 6).alias("chunk_hits"))
    return evaluate.set_summary(rows).withColumns({c: F.round(c, 6) for c in ("mean_wiki_hits", "mean_chunk_hits")})


@query("SELECT doc_id, round((doc_id % 5 + 1) * 0.40 + (doc_id % 4 + 1) * 0.25 + (doc_id % 3 + 1) * 0.20 + (doc_id % 2 + 1) * 0.15, 6)::DOUBLE AS quality FROM labels")
def answer_quality(spark, sf_dir):
    d = F.col("doc_id")
    rows = t.given(spark, sf_dir, "labels").select("doc_id", (d % 5 + 1).alias("accuracy"), (d % 4 + 1).alias("completeness"), (d % 3 + 1).alias("citation"), (d % 2 + 1).alias("clarity"))
    return evaluate.answer_quality(rows).select("doc_id", F.round("quality", 6).alias("quality"))


@query("WITH e AS (SELECT DISTINCT p_type AS name FROM part), f AS (SELECT DISTINCT p_type AS name FROM part WHERE p_size > 45 AND p_partkey % 7 = 0) SELECT count(*) AS expected, count(f.name) AS found, round(count(f.name) / count(*), 6) AS ratio FROM e LEFT JOIN f USING (name)")
def entity_recall(spark, sf_dir):
    part = t.given(spark, sf_dir, "part")
    found = part.filter("p_size > 45 and p_partkey % 7 = 0").select(F.col("p_type").alias("name"))
    return evaluate.expected_ratio(part.select(F.col("p_type").alias("name")), found, ["name"]).withColumn("ratio", F.round("ratio", 6))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark, sf_dir):
    return streams.hourly_counts(t.given(spark, sf_dir, "events"))


@query("SELECT event_id, ts + INTERVAL 8 HOUR AS local_ts, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS local_date FROM events")
def local_dates(spark, sf_dir):
    return t.given(spark, sf_dir, "events").select("event_id", F.from_utc_timestamp("ts", "Asia/Shanghai").alias("local_ts"), X.local_date(F.col("ts")).alias("local_date"))


@query("SELECT event_id, event_id % 3 <> 0 AND (event_id % 4 = 0 OR ts > TIMESTAMP '2024-01-15') AS usable, event_id % 2 = 0 AS can_write FROM events")
def token_usable(spark, sf_dir):
    e = F.col("event_id")
    scopes = F.when(e % 2 == 0, "read, write").otherwise("read")
    return t.given(spark, sf_dir, "events").select("event_id", X.token_usable(e % 3 != 0, F.when(e % 4 != 0, F.col("ts")), F.lit("2024-01-15").cast("timestamp")).alias("usable"), X.has_scope(scopes, "write").alias("can_write"))


def _rated(spark, sf_dir):
    return t.given(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("repo_id"), "event_id", "ts")


@query("""WITH RECURSIVE e AS (SELECT user_id % 50 AS repo_id, event_id, ts, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT repo_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::BOOLEAN AS accepted, NULL::DOUBLE AS retry_after, []::DOUBLE[] AS times FROM (SELECT DISTINCT repo_id FROM e) UNION ALL
 SELECT repo_id, n, event_id, ts, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE 3600 - (s - live[1]) END, CASE WHEN len(live) < 3 THEN list_append(live, s) ELSE live END
 FROM (SELECT e.*, list_filter(r.times, lambda x: e.s - x < 3600) AS live FROM r JOIN e ON e.repo_id = r.repo_id AND e.n = r.n + 1))
SELECT repo_id, event_id, ts, accepted, round(retry_after, 3) AS retry_after FROM r WHERE n > 0""")
def rate_limit(spark, sf_dir):
    return streams.rate_limit(_rated(spark, sf_dir), 3, 3600).withColumn("retry_after", F.round("retry_after", 3))


@query("""WITH RECURSIVE e AS (SELECT user_id AS token_id, ts FROM events), r AS (SELECT token_id, min(ts) AS ts FROM e GROUP BY token_id UNION ALL
 SELECT r.token_id, min(e.ts) FROM r JOIN e ON e.token_id = r.token_id AND e.ts >= r.ts + INTERVAL 3600 SECOND GROUP BY r.token_id) SELECT token_id, ts FROM r""")
def last_used(spark, sf_dir):
    return streams.last_used(t.given(spark, sf_dir, "events").select(F.col("user_id").alias("token_id"), "ts"), 3600)
