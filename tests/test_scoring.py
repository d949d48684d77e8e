"""Best documents by sums over terms, and best facts by subsets of their values, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import access, fusion, lexical, scoring


@pytest.mark.parametrize("collapse", [False, True])
def test_the_best_of_all_pairs(spark, monkeypatch, collapse):
    monkeypatch.setattr(scoring, "DOC_ROWS", 40)
    monkeypatch.setattr(scoring, "QUERY_ROWS", 7)
    rng = random.Random(3)
    docs = [(r, 1000 * r + i, rng.sample(range(12), rng.randint(0, 5)), [rng.randint(1, 2) for _ in range(5)]) for r in (0, 1) for i in range(150)]
    docs = [(r, i, ts, [float(v) for v in vs[: len(ts)]], None) for r, i, ts, vs in docs]
    asked = [(r, q, t, rng.choice([0.5, 1.0, -1.0])) for r in (0, 1) for q in range(20) for t in rng.sample(range(15), 3)]
    got = scoring.top_by_terms(spark.createDataFrame(asked, "repo_id int, query_id int, term bigint, w double"), spark.createDataFrame(docs, "repo_id int, id int, terms array<bigint>, values array<double>, base double"), 4, collapse)
    want = []
    for r in (0, 1):
        for q in range(20):
            w = {t: x for a, b, t, x in asked if (a, b) == (r, q)}
            scored = sorted((-sum(w.get(t, 0.0) * v for t, v in zip(ts, vs)), i) for a, i, ts, vs, _ in docs if a == r)
            want += [(r, q, i, -s, n + 1) for n, (s, i) in enumerate([x for x in scored if x[0] < 0][:4])]
    assert sorted(tuple(x) for x in got.select("repo_id", "query_id", "id", "score", "rank").collect()) == sorted(want)


def test_a_written_index_has_a_row_for_each_document(spark, tmp_path):
    docs = spark.createDataFrame([(0, 1, "a b a"), (0, 2, ""), (0, 3, None), (1, 4, "b 中文字")], "repo_id int, id int, text string")
    lexical.build_postings(docs, "id", "text").write(f"file://{tmp_path}/p")
    p = lexical.Postings.read(spark, f"file://{tmp_path}/p")
    assert {r.id: (r.length, dict(zip(r.terms, r.tfs))) for r in p.docs.collect()} == {1: (3, {"a": 2, "b": 1}), 2: (0, {}), 3: (0, {}), 4: (3, {"b": 1, "中文": 1, "文字": 1})}
    assert {(r.repo_id, r.n, r.avgdl) for r in p.stats.collect()} == {(0, 3, 1.0), (1, 1, 3.0)}
    assert "Exchange" not in lexical.build_postings(docs, "id", "text").tf._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limits", [(6, 4096), (1, 4096), (6, 2)])
def test_best_facts_of_all_pairs(spark, monkeypatch, limits):
    monkeypatch.setattr(fusion, "MOST_VALUES", limits[0])
    monkeypatch.setattr(fusion, "MOST_SUBSETS", limits[1])
    rng = random.Random(5)
    rows = [(0, i, {"color": rng.choice(["red", "blue", ""]), rng.choice(["size", "kind"]): str(rng.randint(1, 12)), "x": rng.choice("ab")}, rng.choice(["stock.csv", "b.csv"]), "s.md", rng.choice(["one", None])) for i in range(120)]
    facts = spark.createDataFrame(rows, "repo_id int, id int, fields map<string,string>, source_file string, source_markdown_filename string, sheet string")
    asked = spark.createDataFrame([(0, 0, "which red size 12"), (0, 1, "kind 3 of blue in stock.csv"), (0, 2, "nothing?!"), (0, 3, "one"), (0, 4, "color red blue size 1 2 kind 11")], "repo_id int, query_id int, question string")

    def score(q, fields, *origins):
        q, keys, values, both = q.replace(" ", ""), 0, 0, 0
        for k, v in fields.items():
            hit = v != "" and v in q
            keys, values, both = keys + (k in q), values + hit, both + (hit and k in q)
        named = sum(o is not None and o in q for o in origins)
        return values * 1.0 + both * 0.8 + named * 0.3 + min(keys, 3) * 0.2 if values + named else None

    every = {(q.query_id, f[1]): s for q in asked.collect() for f in rows if (s := score(q.question, *f[2:])) is not None}
    got = fusion.exact_fact_scores(asked, facts).collect()
    assert {(r.query_id, r.id): round(r.score, 6) for r in got} == {k: round(v, 6) for k, v in every.items()} and len(got) == len(every)
    want = [(q, i, n + 1) for q in range(5) for n, (_, i) in enumerate(sorted((-round(s, 6), i) for (a, i), s in every.items() if a == q)[:6])]
    best = fusion.exact_fact_topk(asked, facts, 6, 6)
    assert sorted((r.query_id, r.id, r.rank) for r in best.collect()) == sorted(want)


def test_pairs_of_facts_and_questions_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(fusion, "FACT_ROWS", 7)
    monkeypatch.setattr(fusion, "ASKED_ROWS", 3)
    # one fact of 300 values, facts that are alike, and a null id
    rows = [(1, "wide", {f"k{i}": f"v{i}" for i in range(300)}, "w.csv", None, None)]
    rows += [(r, f"f{i}" if i else None, {"color": "red", "size": str(i % 3)}, "a.csv", None, None) for r in (1, 2) for i in range(40)]
    facts = spark.createDataFrame(rows, "repo_id long, id string, fields map<string,string>, source_file string, source_markdown_filename string, sheet string")
    texts = ["red", "size 2", "color?", "in a.csv", "k5 " + " ".join(f"v{i}" for i in range(300))] * 4
    asked = spark.createDataFrame([(1 + i % 2, i, t) for i, t in enumerate(texts)], "repo_id long, query_id int, question string")
    found = fusion.exact_fact_scores(asked, facts, digits=1)
    got = sorted(((r.repo_id, r.query_id, r.id or "", r.score) for r in found.collect()))
    want = []
    for i, t in enumerate(texts):
        for repo, fact, fields, *origins in rows:
            q, named = t.replace(" ", ""), sum(o is not None and o in t for o in origins)
            keys, hits = sum(k in q for k in fields), [k for k, v in fields.items() if v in q]
            if repo == 1 + i % 2 and (hits or named):
                want.append((repo, i, fact or "", round(len(hits) + sum(k in q for k in hits) * 0.8 + named * 0.3 + min(keys, 3) * 0.2, 1)))
    assert got == sorted(want) and max(s for *_, s in got) > 300
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[0] and "FlatMapCoGroupsInArrow" in plan


def test_repositories_are_not_paired_with_questions(spark):
    repos = spark.createDataFrame([(100 - i, "tea shop" if i % 2 else "coffee", "tea" if i % 3 else "the", i) for i in range(60)], "repo_id int, name string, description string, pos int")
    asked = spark.createDataFrame([(q, "find the tea shop" if q % 2 else "coffee and tea") for q in range(30)] + [(99, "none")], "query_id int, question string")
    got = access.preselect(asked, repos, 3)
    found = {q: [(r.repo_id, r.points) for r in sorted(got.filter(F.col("query_id") == q).collect(), key=lambda r: r.rank)] for q in (0, 1, 99)}
    assert found == {0: [(99, 3.0), (98, 3.0), (96, 3.0)], 1: [(99, 5.0), (95, 5.0), (93, 5.0)], 99: [(100, 0.0), (99, 0.0), (98, 0.0)]}
    assert got.count() == 93
