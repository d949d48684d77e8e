"""The keyword index that grows by batches of a stream."""

import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import lexical
from kbspark.streaming import streams
from kbspark.streaming.index import KeywordIndex

DOCS = "repo_id long, id string, text string"


def batches(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    return [[(rng.randint(0, 1), f"d{rng.randint(0, 14)}", text()) for _ in range(6)] for _ in range(5)] + [[(0, "d1", None), (1, "d1", "")], []]


def content(p):
    tf = sorted((r.repo_id, r.term, r.id, r.tf, r.length) for r in p.tf.collect())
    terms = sorted((r.repo_id, r.term, r.df) for r in p.terms.collect())
    return tf, terms, sorted((r.repo_id, r.n, round(r.avgdl, 9)) for r in p.stats.collect())


def rebuilt(spark, parts):
    last = {}
    for part in parts:
        new = {}
        for r in part:
            key = r[:2]
            new[key] = max((x for x in (new.get(key), r[2]) if x is not None), default=None)
        last |= new
    return content(lexical.build_postings(spark.createDataFrame([(*k, t) for k, t in last.items()], DOCS), "id", "text"))


def test_the_index_grows_by_batches(spark, tmp_path):
    index, parts = KeywordIndex(spark, f"file://{tmp_path}/i"), batches()
    with pytest.raises(ValueError):
        index.postings()
    for n, part in enumerate(parts):
        index(spark.createDataFrame(part, DOCS), n)
        if n in (1, 6):
            index(spark.createDataFrame(part, DOCS), n)  # handed over again: nothing changes
        if n == 3:
            assert index.fold(2) and not index.fold(5)
        if n in (0, 2, 3, 6):
            assert content(index.postings()) == rebuilt(spark, parts[: n + 1])
    assert index.fold(2) and content(index.postings()) == rebuilt(spark, parts)


def test_a_crash_before_the_commit(spark, tmp_path, monkeypatch):
    index, parts = KeywordIndex(spark, f"file://{tmp_path}/i"), batches(5)
    index(spark.createDataFrame(parts[0], DOCS), 0)
    commit = KeywordIndex._commit
    monkeypatch.setattr(KeywordIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index(spark.createDataFrame(parts[1], DOCS), 1)
    assert content(index.postings()) == rebuilt(spark, parts[:1])
    monkeypatch.setattr(KeywordIndex, "_commit", commit)
    again = KeywordIndex(spark, f"file://{tmp_path}/i")
    again(spark.createDataFrame(parts[1], DOCS), 1)
    assert content(again.postings()) == rebuilt(spark, parts[:2])


def test_files_into_the_index(spark, tmp_path):
    put = lambda name, text: (tmp_path / "in").mkdir(exist_ok=True) or (tmp_path / "in" / name).write_text(text)
    index = KeywordIndex(spark, f"file://{tmp_path}/i")
    sink = lambda batch, n: index(batch.select(F.lit(7).cast("long").alias("repo_id"), F.col("filename").alias("id"), F.col("content").alias("text")), n)
    put("a.md", "red fox and fox")
    streams.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", sink).awaitTermination(120)
    put("b.md", "blue fox")
    streams.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/cp", sink).awaitTermination(120)
    asked = spark.createDataFrame([(7, 1, "fox")], "repo_id long, query_id long, question string")
    hits = lexical.bm25_topk(asked, index.postings(), variant="tf").collect()
    assert [(r.id, r.score) for r in sorted(hits, key=lambda r: r["rank"])] == [("a.md", 2.0), ("b.md", 1.0)]
