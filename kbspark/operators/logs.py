"""Reports over query logs, tasks, feedback and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """One page of an ordered report, numbers from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def query_log_report(logs: DataFrame, users: DataFrame, repos: DataFrame, where: Column | None = None) -> DataFrame:
    """Log rows with user and repository names; those of unknown users stay, those of deleted repositories go."""
    rows = logs if where is None else logs.filter(where)
    return rows.join(repos.select("repo_id", F.col("name").alias("repo_name")), "repo_id").join(users.select("user_id", "username"), "user_id", "left")


def feedback_report(feedback: DataFrame, users: DataFrame, repos: DataFrame, logs: DataFrame) -> DataFrame:
    """Ratings with names, and the question of the trace if it was logged."""
    named = query_log_report(feedback, users, repos)
    return named.join(logs.select("trace_id", "question", "confidence"), "trace_id", "left")


def sources_with_tasks(sources: DataFrame, tasks: DataFrame) -> DataFrame:
    """sources (repo_id, source_file) with ingested (a task is done) and the last active task."""
    done = F.max((F.col("status") == "done").cast("int")) == 1
    active = F.max(F.when(F.col("status").isin(*ACTIVE), F.struct("created_at", "task_id", "status")))
    state = tasks.groupBy("repo_id", "source_file").agg(done.alias("ingested"), active.alias("a"))
    return sources.join(state, ["repo_id", "source_file"], "left").select("repo_id", "source_file", F.coalesce("ingested", F.lit(False)).alias("ingested"), F.col("a.task_id").alias("task_id"), F.col("a.status").alias("task_status"))


def pending_sources(sources: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sources without a task that is done, queued or running."""
    return sources.join(tasks.filter(F.col("status").isin("done", *ACTIVE)).select("repo_id", "source_file"), ["repo_id", "source_file"], "left_anti")


def confidence_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("confidence").agg(F.count("*").alias("n"))


def top_repos(logs: DataFrame, repos: DataFrame, n: int = 10) -> DataFrame:
    counts = logs.groupBy("repo_id").agg(F.count("*").alias("queries"))
    return counts.join(repos.select("repo_id", "name"), "repo_id").orderBy(F.desc("queries"), "repo_id").limit(n)


def repo_usage(repos: DataFrame, logs: DataFrame) -> DataFrame:
    """All repositories with their number of queries, 0 included."""
    return repos.join(logs.groupBy("repo_id").agg(F.count("*").alias("queries")), "repo_id", "left").withColumn("queries", F.coalesce("queries", F.lit(0)))


def task_status(tasks: DataFrame) -> DataFrame:
    """(repo_id, total, active, and a count of each status)."""
    one = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return tasks.groupBy("repo_id").agg(F.count("*").alias("total"), one(*ACTIVE).alias("active"), *[one(s).alias(s) for s in ("queued", "running", "done", "failed")])


def feedback_totals(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count(F.when(F.col("rating") == "good", 1)).alias("good"), F.count(F.when(F.col("rating") == "bad", 1)).alias("bad"))


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last n rows, oldest first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def search_log(logs: DataFrame, keyword: str = "", level: str | None = None, mode: str | None = None, day: str | None = None, n: int = 20) -> DataFrame:
    rows = logs.filter(F.contains(F.lower("question"), F.lit(keyword.lower())) | F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit(keyword.lower()))) if keyword else logs
    for column, value in (("confidence", level), ("query_mode", mode)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    rows = rows if day is None else rows.filter(F.date_format("created_at", "yyyy-MM-dd") == day)
    return tail(rows, n, "created_at", "trace_id")


def session_buffers(turns: DataFrame, keep: int = 20, title_chars: int = 60) -> DataFrame:
    """(conv_id, title, n_messages, messages) of turns (conv_id, turn, role, text): the last messages, and the first question as title."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    head = turns.filter("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, title_chars).alias("title"))
    recent = turns.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= keep)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return recent.groupBy("conv_id").agg(F.count("*").alias("n_messages"), listed.alias("messages")).join(head, "conv_id", "left")


def document_state(events: DataFrame) -> DataFrame:
    """(repo_id, source, status, progress): of each document the last event's, with statuses in three words."""
    last = F.max_by(F.struct("status", "progress"), F.struct("ts", "event_id"))
    word = F.when(F.col("s.status").isin("done", "completed"), "done").when(F.col("s.status").isin("failed", "error", "cancelled"), "error").otherwise("processing")
    return events.groupBy("repo_id", "source").agg(last.alias("s")).select("repo_id", "source", word.alias("status"), F.col("s.progress").alias("progress"))


def stale_tasks(tasks: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Running tasks that began too long ago, as failed."""
    old = tasks.filter((F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(mins=F.lit(minutes))))
    return old.withColumn("status", F.lit("failed"))


def trace_detail(trace_id: str, logs: DataFrame, users: DataFrame, repos: DataFrame, schema: str) -> DataFrame:
    """One log row with names and its JSON evidence in columns; evidence that can't be read is null."""
    return query_log_report(logs, users, repos, F.col("trace_id") == trace_id).withColumn("evidence", F.from_json("retrieval_json", schema))


def repo_people(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users.select("user_id", "username"), "user_id").orderBy("repo_id", "created_at", "user_id")


def disk_usage(files: DataFrame) -> DataFrame:
    """(repo_id, bytes, files) of files (repo_id, length)."""
    return files.groupBy("repo_id").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def gap_terms(low: DataFrame, postings, least_chars: int = 4) -> DataFrame:
    """(repo_id, term, questions): words of low-confidence questions (repo_id, query_id, question) that the corpus lacks."""
    from kbspark.operators.lexical import query_terms

    asked = query_terms(low).filter(F.length("term") >= least_chars)
    return asked.join(postings.terms, ["repo_id", "term"], "left_anti").groupBy("repo_id", "term").agg(F.count("*").alias("questions"))
