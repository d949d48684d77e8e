"""Structured Streaming forms of what is incremental by nature, and batch twins of the stateful ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kbspark.functions import text as X

RATE_SCHEMA = "repo_id long, event_id long, ts timestamp, accepted boolean, retry_after double"


def ingest(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands newly arrived text files (filename, content) to sink(batch, number), each file once, all that are there."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("content"))
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit(times: list[float], now: float, limit: int, seconds: float) -> tuple[bool, float, list[float]]:
    """Whether an event may pass, seconds to wait if not, and the accepted times that still count."""
    live = [t for t in times if now - t < seconds]
    return (True, 0.0, [*live, now]) if len(live) < limit else (False, seconds - (now - live[0]), live)


def _rated(rows: pd.DataFrame, times: list[float], limit: int, seconds: float) -> tuple[pd.DataFrame, list[float]]:
    rows = rows.sort_values(["ts", "event_id"])
    out = []
    for repo, event, ts in zip(rows["repo_id"], rows["event_id"], rows["ts"]):
        ok, wait, times = admit(times, ts.timestamp(), limit, seconds)
        out.append((repo, event, ts, ok, wait))
    return pd.DataFrame(out, columns=["repo_id", "event_id", "ts", "accepted", "retry_after"]), times


def rate_limit_stream(events: DataFrame, limit: int = 3, seconds: float = 60) -> DataFrame:
    """A stream of (repo_id, event_id, ts) with accepted and retry_after: at most `limit` accepted events in any `seconds`."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        times = list(state.get[0]) if state.exists else []
        out, times = _rated(pd.concat(list(batches)), times, limit, seconds)
        state.update((times,))
        yield out

    return events.select("repo_id", "event_id", "ts").groupBy("repo_id").applyInPandasWithState(run, RATE_SCHEMA, "times array<double>", "append", GroupStateTimeout.NoTimeout)


def _in_order(events: DataFrame, key: str, columns: list[str], schema: str, step: Callable) -> DataFrame:
    """Runs step(rows of one key in order, its state) -> (rows, state) over each key's rows, batch by batch.

    A task holds one batch and the state of the key at hand, however many rows a key has.
    """

    def run(batches):
        at = state = None
        for pdf in batches:
            out = []
            for k, rows in pdf.groupby(key, sort=False):
                state = state if k == at else None
                at = k
                part, state = step(rows, state)
                out.append(part)
            if out:
                yield pd.concat(out)

    return events.select(*columns).repartition(key).sortWithinPartitions(key, *[c for c in ("ts", "event_id") if c in columns]).mapInPandas(run, schema)


def rate_limit(events: DataFrame, limit: int = 3, seconds: float = 60) -> DataFrame:
    """The batch twin of rate_limit_stream."""
    return _in_order(events, "repo_id", ["repo_id", "event_id", "ts"], RATE_SCHEMA, lambda rows, times: _rated(rows, times or [], limit, seconds))


def last_used(events: DataFrame, seconds: float = 60) -> DataFrame:
    """(token_id, ts) of uses that are recorded: the first of a token, then the next a minute or more later."""

    def step(rows: pd.DataFrame, last):
        kept = []
        for ts in rows["ts"]:
            if last is None or (ts - last).total_seconds() >= seconds:
                kept.append(ts)
                last = ts
        return pd.DataFrame({"token_id": rows["token_id"].iloc[0], "ts": kept}), last

    return _in_order(events, "token_id", ["token_id", "ts"], "token_id long, ts timestamp", step)


def last_used_stream(events: DataFrame, seconds: float = 60) -> DataFrame:
    def run(key, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        kept = []
        for ts in pd.concat(list(batches))["ts"].sort_values():
            if last is None or ts.timestamp() - last >= seconds:
                kept.append(ts)
                last = ts.timestamp()
        state.update((last,))
        yield pd.DataFrame({"token_id": [key[0]] * len(kept), "ts": kept})

    return events.select("token_id", "ts").groupBy("token_id").applyInPandasWithState(run, "token_id long, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def hourly_counts(events: DataFrame, key: str = "event_type", late: str = "10 minutes") -> DataFrame:
    """Counts in windows of an hour; on a stream, events later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), key, "n")


def distinct_arrivals(sources: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Arrivals (ts, content, …) whose content was not seen within the watermark."""
    rows = sources.withColumn("md5", F.md5(F.col("content").cast("binary")))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["md5"]) if sources.isStreaming else rows.dropDuplicates(["md5"])


def session_buffer_stream(messages: DataFrame, last: int = 20, title_chars: int = 60) -> DataFrame:
    """A stream of messages (session_key, ts, role, text) to each session's buffer after every batch: its title and last messages.

    The title is the first question's beginning. A session's state is its title and `last` messages, however long it goes on.
    """

    def run(key, batches, state: GroupState):
        title, kept = (state.get[0], list(zip(*state.get[1:]))) if state.exists else (None, [])
        for role, text in (m for part in [pd.concat(list(batches)).sort_values("ts", kind="stable")] for m in zip(part["role"], part["text"])):
            title = (text or "")[:title_chars] if title is None and role == "user" else title
            kept = [*kept, (role, text)][-last:]
        state.update((title, [m[0] for m in kept], [m[1] for m in kept]))
        yield pd.DataFrame({"session_key": [key[0]], "title": [title], "roles": [[m[0] for m in kept]], "texts": [[m[1] for m in kept]]})

    out, held = "session_key string, title string, roles array<string>, texts array<string>", "title string, roles array<string>, texts array<string>"
    return messages.select("session_key", "ts", "role", "text").groupBy("session_key").applyInPandasWithState(run, out, held, "update", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Tells callback(name, batch, rows) how a streaming query gets on; add it with spark.streams.addListener()."""

    def __init__(self, callback: Callable[[str, int, int], None]):
        self.callback = callback

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.callback(event.name or str(event.id), -1, 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.callback(p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def trace_sink(traces: DataFrame, path: str, checkpoint: str, zone: str = "Asia/Shanghai") -> StreamingQuery:
    """Writes a stream of traces, a folder for each local day."""
    rows = traces.withColumn("date", X.local_date(F.col("ts"), zone))
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("date").trigger(availableNow=True).start()


def state_sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps each document's last state in a folder for each batch: path/v=<number>.

    A batch that runs again after a failure gives the same folder.
    """
    from kbspark.operators.logs import document_state

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("repo_id", "source").agg(F.max_by(F.struct("ts", "event_id", "status", "progress"), F.struct("ts", "event_id")).alias("s")).select("repo_id", "source", "s.*")
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/events/v={number - 1}"))
            new = new.groupBy("repo_id", "source").agg(F.max_by(F.struct("ts", "event_id", "status", "progress"), F.struct("ts", "event_id")).alias("s")).select("repo_id", "source", "s.*")
        new.write.mode("overwrite").parquet(f"{path}/events/v={number}")
        document_state(spark.read.parquet(f"{path}/events/v={number}")).write.mode("overwrite").parquet(f"{path}/state/v={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale_tasks_stream(tasks: DataFrame, minutes: int = 30) -> DataFrame:
    """A stream of task events (task_id, status, ts) to tasks that ran for too long, as failed, by event time."""

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"task_id": [key[0]], "status": ["failed"]})
            return
        last = pd.concat(list(batches)).sort_values("ts").iloc[-1]
        if last["status"] == "running":
            state.update((last["ts"].timestamp(),))
            state.setTimeoutTimestamp(int(last["ts"].timestamp() * 1000) + minutes * 60_000)
        elif state.exists:
            state.remove()

    rows = tasks.withWatermark("ts", "1 minute").select("task_id", "status", "ts")
    return rows.groupBy("task_id").applyInPandasWithState(run, "task_id long, status string", "since double", "append", GroupStateTimeout.EventTimeTimeout)
