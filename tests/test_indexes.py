"""Stored indexes: rows are those of a full search, and less is read."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.operators import automaton, dense, graph, impacts, ivf, lexical, literal
from kbspark.operators import vectors as near
from kbspark.sources import store


def vectors(spark, n=600, width=6, repos=2, seed=1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((i % repos, i, f"f{i % 5}", [x + rng.gauss(0, 0.25) for x in m]))
    rows += [(0, n, "f0", None), (0, n + 1, "f0", [float("nan")] * width), (1, n + 2, "f0", [0.0] * width), (0, n + 3, "f0", rows[0][3])]
    return spark.createDataFrame(rows, "repo_id long, id long, file string, embedding array<float>").repartition(5)


def asked_of(df):
    return df.filter("id % 40 = 0").select("repo_id", F.col("id").alias("query_id"), "embedding")


def hits(df):
    return sorted((r.repo_id, r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("cells", [1, 7, 40])
def test_exact_search_of_cells_misses_nothing(spark, tmp_path, cells):
    df = vectors(spark)
    index = ivf.build_ivf(df, f"file://{tmp_path}/i", n_cells=cells)
    assert index.cells.count() == ivf.usable(df, "embedding").count()
    asked = asked_of(df)
    full = hits(dense.dense_topk(asked, df, 5, exclude_self=True))
    assert hits(ivf.ivf_topk(asked, index, 5, probes=1, exact=True, exclude_self=True)) == full
    options = dict(threshold=0.9, per_file=1, oversample=3)
    assert hits(ivf.ivf_topk(asked, index, 4, probes=2, exact=True, **options)) == hits(dense.dense_topk(asked, df, 4, **options))


def test_blocks_hand_on_what_reaches_the_known_score(spark):
    rows = vectors(spark).filter("id % 7 != 3")
    asked = asked_of(ivf.usable(rows, "embedding")).select("repo_id", "query_id", F.col("embedding").alias("q"), F.when(F.col("query_id") % 80 == 0, F.lit(0.99)).alias("low"))
    held = ivf.usable(rows, "embedding").select("repo_id", "id", "file", F.col("embedding").alias("v"))
    free = {r[:4]: r.score for r in dense.block_topk(asked.drop("low"), held, ["repo_id"], 30).collect()}
    found = {r[:4]: r.score for r in dense.block_topk(asked, held, ["repo_id"], 30).collect()}
    assert found == {k: s for k, s in free.items() if k[1] % 80 or s >= 0.99} and len(found) < len(free)


def test_few_probes_find_most_and_read_little(spark, tmp_path):
    df = vectors(spark, n=1500)
    index = ivf.build_ivf(df, f"file://{tmp_path}/i")
    asked = asked_of(df)
    found = ivf.ivf_topk(asked, index, 10, probes=8, exclude_self=True)
    r = ivf.recall(found, dense.dense_topk(asked, df, 10, exclude_self=True)).agg(F.sum("found") / F.sum("n")).first()[0]
    read = ivf.cells_read(asked, index, 8).agg(F.avg("vectors")).first()[0]
    assert r >= 0.9 and read < 750 / 2
    assert "PartitionFilters: [cell" in index.cells.filter(F.col("cell").isin([1, 2]))._jdf.queryExecution().toString()


def test_cells_bound_what_they_hold(spark, tmp_path):
    df = vectors(spark)
    index = ivf.build_ivf(df, f"file://{tmp_path}/i", n_cells=9)
    near = {(r.repo_id, r.query_id): (r.q, {c.cell: c.bound for c in r.near}) for r in ivf.nearest_cells(asked_of(df), index).collect()}
    members = index.cells.collect()
    for q, bounds in near.values():
        for m in members:
            norm = math.hypot(*q) * math.hypot(*m.v)
            assert not norm or np.dot(q, m.v) / norm <= bounds[m.cell] + 1e-6


def test_index_of_nothing(spark, tmp_path):
    df = vectors(spark).filter("id < 0")
    index = ivf.build_ivf(df, f"file://{tmp_path}/i")
    assert ivf.ivf_topk(asked_of(vectors(spark)).limit(0), index, 3).count() == 0


def test_kept_tables_follow_their_files(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build(folder):
        built.append(folder)
        spark.range(len(built)).write.parquet(folder)

    spark.range(10).coalesce(1).write.parquet(path)
    first = store.kept(spark, "x", spark.read.parquet(path), build)
    assert store.kept(spark, "x", spark.read.parquet(path), build) == first and len(built) == 1
    spark.range(20).coalesce(1).write.mode("overwrite").parquet(path)
    second = store.kept(spark, "x", spark.read.parquet(path), build)
    assert second != first and len(built) == 2 and spark.read.parquet(second).count() == 2


# -- postings in blocks by gain


def corpus(spark, n, seed=2):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = ["the"] * rng.randint(1, 9) + rng.choices(["of", "and", "to"], k=rng.randint(0, 8)) + rng.choices(rare, k=rng.randint(0, 30))
        rng.shuffle(words)
        rows.append((i % 3 if n > 9 else 0, f"d{i:05}", " ".join(words)))
    rows.append((0, "empty", ""))
    docs = spark.createDataFrame(rows, "repo_id long, id string, text string").repartition(4)
    asked = [(r, q, " ".join(rng.choices(rare, k=5) + ["the", "of", "the", "unknown"])) for r in range(4) for q in range(6)]
    asked += [(0, 90, "the of"), (1, 91, ""), (0, 92, None), (2, 93, " ".join(rare))]
    return docs, spark.createDataFrame(asked, "repo_id long, query_id long, question string")


@pytest.mark.parametrize("n", [1, 2, 9, 900])
@pytest.mark.parametrize("k", [3, 20])
def test_blocks_give_the_rows_of_all_postings(spark, tmp_path, monkeypatch, n, k):
    monkeypatch.setattr(impacts, "BLOCK", 8)
    docs, asked = corpus(spark, n)
    p = lexical.build_postings(docs, "id", "text")
    index = impacts.build_impacts(p, f"file://{tmp_path}/i")
    rows = lambda df: sorted((r.repo_id, r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
    assert rows(impacts.block_topk(asked, index, k)) == rows(lexical.bm25_topk(asked, p, k))
    if n == 900 and k == 3:
        read = impacts.reads(asked.filter("query_id < 6"), index, k).agg(F.sum("blocks"), F.sum("blocks_read")).first()
        assert 0 < read[1] < read[0] / 2
        per = index.blocks.agg(F.max("n"), F.sum("n")).first()
        assert per[0] < 200 and per[1] == p.tf.count()


def test_shards_hold_small_blocks_and_hand_on_their_best(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(impacts, "BLOCK", 8)
    monkeypatch.setattr(impacts, "SHARD_ROWS", 50)
    docs, asked = corpus(spark, 600)
    index = impacts.build_impacts(lexical.build_postings(docs, "id", "text"), f"file://{tmp_path}/i")
    assert index.shards.count() >= 12 and index.blocks.agg(F.max("n")).first()[0] == 8
    best = impacts.shard_best(pa.table({"repo_id": [0], "query_id": [1], "theta": [0.0], "x": [[{"term": "a", "w": 2.0, "cut": 16, "unread": 0.0}, {"term": "b", "w": 1.0, "cut": 0, "unread": 1.5}]]}), pa.table({"term": ["a", "b"], "level": pa.array([0, 8], pa.int32()), "ids": [[7, 5, 6], [6, 9]], "gains": [[1.0, 0.5, 0.5], [1.5, 1.0]]}), 2)
    assert best.select(["id", "score"]).to_pylist() == [{"id": 6, "score": 2.5}, {"id": 7, "score": 2.0}]


def test_levels_are_cut_where_the_rest_stays_below():
    rows = pd.DataFrame([("a", 0, 5.0, 10), ("a", 1, 4.0, 1000), ("b", 0, 9.0, 2), ("b", 1, 1.0, 50), ("c", 0, 0.5, 10_000)], columns=["term", "level", "top", "n"])
    rows["blocks"], rows["repo_id"], rows["query_id"], rows["theta"] = 1, 0, 0, 10.0
    cut = {r.term: (r.cut, r.unread, r.blocks_read) for r in impacts.cut_levels(rows).itertuples()}
    assert cut["b"][0] >= 1 and cut["c"] == (0, 0.5, 0)
    assert sum(u for _, u, _ in cut.values()) < impacts.SLACK * 10
    rows["theta"] = 0.0
    assert all(u == 0 for _, u, _ in ((r.cut, r.unread, r.blocks_read) for r in impacts.cut_levels(rows).itertuples()))


def test_postings_keep_what_stands_beside_the_text(spark):
    """A chunk's place and vector are written with its words, so its text is worked on once."""
    docs = spark.createDataFrame([(0, "a#0", "x y x", "a", 0, [1.0]), (0, "a#1", None, "a", 1, None)], "repo_id long, id string, text string, filename string, position int, embedding array<float>")
    held = lexical.written(lexical.build_postings(docs, "id", "text", keep=("filename", "position", "embedding"))).docs
    assert {r.id: (r.length, r.filename, r.position, r.embedding) for r in held.collect()} == {"a#0": (3, "a", 0, [1.0]), "a#1": (0, "a", 1, None)}


# -- literal search


def test_grams_give_the_pages_that_a_scan_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(literal, "SORTED_CHARS", 500)
    rng = random.Random(4)
    words = ["Straße", "naïve", "日本語", "aaa", "aaaa", "İstanbul", "and", "𝔘nit", "x"]
    pages = [(r, f"p{i}", " ".join(rng.choices(words, k=rng.randint(0, 60)))) for r in (0, 1, 2) for i in range(40)]
    pages += [(0, "null", None), (0, "empty", ""), (1, "tail", "ends with aaa"), (1, "p1", "the same name again and aaaa"), (2, "lines", "one\ntwo and\nthree")]
    queries = ["AND", "aaa", "aaaa aaa", "日本語 日本語", "x", "xx", "straße naïve", "i̇stanbul", "nothing like it", "", None, "ONE\ntwo", "𝔘nit 𝔘", "and x and"]
    rows = [(q, r, text) for q, text in enumerate(queries) for r in (0, 1, 2, 9)]
    pages, asked = spark.createDataFrame(pages, "repo_id long, filename string, content string").repartition(3), spark.createDataFrame(rows, "query_id int, repo_id long, q string")
    index = literal.build_grams(pages, f"file://{tmp_path}/g")
    found = lambda df: sorted(map(tuple, df.collect()))
    full = found(graph.literal_search(asked, pages, 10))
    assert found(literal.literal_search(asked, index, 10)) == full and len(full) > 100
    # what is read: the pages that hold a query's rarest grams in their places, few more than those that hold the query
    near = literal.candidates(asked, index).count()
    exact = sum(1 for r in full if len(queries[r[0]]) > 2)
    assert exact <= near <= 1.2 * exact + 5


def test_places_take_few_bytes():
    rng = np.random.default_rng(8)
    page = np.sort(rng.integers(1 << 40, (1 << 40) + 300, 2000))
    at = np.concatenate([np.sort(rng.choice(100_000, n, replace=False)) for n in np.unique(page, return_counts=True)[1]])
    starts = np.array([0, 1, 700, 701, 1500])
    rows = literal.packed(page, at, starts).to_pylist()
    ends = [*starts[1:], 2000]
    for a, b, data in zip(starts, ends, rows):
        p, q = literal.unpacked(int(page[a]), data)
        assert p.tolist() == page[a:b].tolist() and q.tolist() == at[a:b].tolist()
    assert sum(map(len, rows)) < 4 * len(page)


def test_grams_of_no_pages(spark, tmp_path):
    index = literal.build_grams(spark.createDataFrame([], "repo_id long, filename string, content string"), f"file://{tmp_path}/g")
    asked = spark.createDataFrame([(1, 1, "abc"), (2, 1, "a")], "query_id int, repo_id long, q string")
    assert literal.literal_search(asked, index).count() == 0


# -- automata


def test_automata_find_what_texts_hold(spark, monkeypatch):
    monkeypatch.setattr(automaton, "SHARD_PATTERNS", 7)
    monkeypatch.setattr(automaton, "TEXT_ROWS", 5)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé日") for _ in range(n))
    patterns = sorted({(r, word(rng.randint(1, 5))) for r in (0, 1) for _ in range(60)})
    texts = [(r, f"q{r}{i}", word(rng.randint(0, 40))) for r in (0, 1, 2) for i in range(20)] + [(0, "null", None)]
    asked = spark.createDataFrame(texts, "repo_id long, query_id string, q string").filter("q is not null")
    found = automaton.contained(asked, spark.createDataFrame(patterns, "repo_id long, part string")).collect()
    assert sorted(map(tuple, found)) == sorted((r, q, p) for r, q, t in texts if t is not None for s, p in patterns if s == r and p in t)


# -- groups of near vectors


def brute_groups(rows, threshold, across):
    m = np.array([r[2] for r in rows], np.float64)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    near = m @ m.T >= threshold
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near[a, b] and (across or rows[a][0] == rows[b][0]):
                group = [group[b] if g == group[a] else g for g in group] if group[a] != group[b] else group
    named = {}
    for g in set(group):
        members = [rows[i][:2] for i in range(len(rows)) if group[i] == g]
        if len(members) > 1:
            named |= {x: (*min(members), len(members)) for x in members}
    return named


@pytest.mark.parametrize("across", [True, False])
def test_groups_of_near_vectors(spark, monkeypatch, across):
    monkeypatch.setattr(near, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        middle = rng.normal(size=24)
        for _ in range(rng.integers(1, 6)):
            rows.append((int(rng.integers(0, 3)), len(rows), (middle + rng.normal(size=24) * 0.12).astype(np.float32).tolist()))
    hot = rng.normal(size=24).astype(np.float32)
    rows += [(i % 3, len(rows) + i, hot.tolist()) for i in range(120)]  # one vector in a third of all rows
    rows += [(i % 3, len(rows) + i, (hot + rng.normal(size=24) * 0.02).astype(np.float32).tolist()) for i in range(90)]  # and many close to it
    rows += [(0, 5000, (hot * 3).tolist())]
    schema = "repo_id long, id long, embedding array<float>"
    extra = [(0, 9000, None), (0, 9001, [float("nan")] * 24), (1, 9002, [])]
    found = near.near_vectors(spark.createDataFrame(rows + extra, schema).repartition(4), 0.9, across)
    assert {(r.repo_id, r.id): (r.group_repo, r.group_id, r.members) for r in found.collect()} == brute_groups(rows, 0.9, across)


def test_pairs_at_the_threshold_are_rarely_missed(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        a, b = rng.normal(size=(2, 32))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(0, 2 * i, a.tolist()), (0, 2 * i + 1, (0.91 * a + (1 - 0.91**2) ** 0.5 * b).tolist())]
    found = near.near_vectors(spark.createDataFrame(rows, "repo_id long, id long, embedding array<float>"), 0.9)
    assert found.count() >= 0.97 * len(rows)


def test_no_near_vectors(spark):
    assert near.near_vectors(spark.createDataFrame([], "repo_id long, id long, embedding array<float>")).count() == 0


def test_small_buckets_share_a_task(spark):
    """Buckets are many: they come to Python as rows in order, not one call for each."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(50, 8))
    rows = [(0, code, 0, 0, 0, 2 * code + side, m[code % 50] + side * 0.001) for code in range(400) for side in (0, 1)]
    names = ["scope", "code", "i", "j", "block", "kind", "v"]
    batches = [pa.RecordBatch.from_pydict({n: [r[c].tolist() if n == "v" else r[c] for r in rows[at : at + 7]] for c, n in enumerate(names)}) for at in range(0, len(rows), 7)]
    found = [pair for out in near._linked(8, 0.9)(iter(batches)) for pair in zip(*out.to_pydict().values())]
    assert sorted(found) == [(2 * code, 2 * code + 1) for code in range(400)]
