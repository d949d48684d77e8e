"""Filter audit, quality classifier and source divergence."""

import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm import divergence as dv
from kbspark.llm import quality, survival
from kbspark.llm.oracles import ORACLE_SQL
from kbspark.llm.queries import QUERIES
from tests.test_queries import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, part string, id string, word string, n int"
LABELS = "doc_id bigint, quality int, toxic int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", "x", "y", 7) for r in rows], DOCS).repartition(parts)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_divergence"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, found = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in found.description], found.fetchall())


# -- filter audit

PROSE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE + " $", "en", "a"),
    (4, "WORD " * 100, "en", None),
    (5, None, "en", None),
    (6, "", "en", "b"),
    (6, "", "en", "b"),
    (None, PROSE, "en", "a"),
    (None, PROSE, "en", "a"),
    (7, "x " * 49, None, "b"),
    (8, "Ünï " + "ä b " * 400, "en", "b"),
    (9, PROSE.upper() + " | & ", "en", "a"),
]
MARKS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 1, None), (4, None, 1), (9, 0, 1), (None, 1, 1), (99, 1, 1)]


def fails(rows):
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, _, source in rows:
        t = text or ""
        words = [w for w in t.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        x = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        x += "D" * any(c in "#$%&*|" for c in t) + "E" * (doc is not None and t in first and doc > first[t])
        yield doc, source or "", x


def brute_audit(rows, marks):
    good, toxic = {d for d, q, _ in marks if q == 1 and d is not None}, {d for d, _, t in marks if t == 1 and d is not None}
    out, shapley = {}, Counter()
    told = list(fails(rows))
    parts = {p for _, p, _ in told}
    for part in parts:
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                r = Counter()
                for doc, p, x in told:
                    if p != part:
                        continue
                    gone = any(c in x for c in order[: step - 1])
                    r["kept"] += not gone and f not in x
                    r["removed"] += not gone and f in x
                    r["redundant"] += gone and f in x
                    r["unique"] += x == f
                    r["good"] += not gone and f in x and doc in good
                    r["toxic"] += not gone and f in x and doc in toxic
                shapley[part, f] += r["removed"]
                out[part, order, step] = [r[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_as_counted_one_by_one(spark):
    found = survival.audit_filters(frame(spark, ROWS), spark.createDataFrame(MARKS, LABELS)).collect()
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in found} == brute_audit(ROWS, MARKS)
    assert len(found) == 3 * 600


def test_audit_of_an_empty_table(spark):
    assert survival.audit_filters(frame(spark, [], 1), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 1000, 4099])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.int64)
    assert survival.positional_popcount(words).tolist() == [int(((words >> s) & 1).sum()) for s in range(32)]


def test_many_parts_and_a_hot_text(spark):
    """More parts than a task holds, and one text in a third of all rows."""
    rows = [(i, PROSE if i % 3 else f"{PROSE} {i}", "en", f"s{i % 2500}") for i in range(5000)]
    marks = [(i, i % 2, i % 5 == 0) for i in range(5000)]
    found = survival.audit_filters(frame(spark, rows), spark.createDataFrame([(d, q, int(t)) for d, q, t in marks], LABELS))
    r = found.filter("filter_order = 'EABCD' and step = 1").agg(F.count("*"), F.sum("removed"), F.sum("kept"), F.sum("good_lost")).first()
    again = [i for i in range(5000) if i % 3 and i != 1]
    assert tuple(r) == (2500, len(again), 5000 - len(again), sum(i % 2 for i in again))


# -- quality classifier


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    told = QUERIES["op12_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in told if r.quality == 1], [r.score for r in told if r.quality == 0]
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in told)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in told)
    # the chance that a good text scores above a bad one
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.85
    assert np.mean([r.predicted for r in told if r.quality == 1]) > 0.95


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fitted = quality.learn(docs, labels)
    one = {r.doc_id: r.score for r in quality.classify(docs.repartition(1), fitted).collect()}
    many = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "score": F.lit(1.0)}).repartition(50)
    assert {r.doc_id: r.score for r in quality.classify(many, fitted, keep=("score",)).collect()} == one
    again = quality.learn(docs.repartition(7), labels.repartition(5))
    assert {r.doc_id: r.score for r in quality.classify(docs, again).collect()} == one


def test_held_out_labels_are_never_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert _same(quality.learn(docs, labels), quality.learn(docs, turned))


def _same(a, b):
    return a.sizes == b.sizes and a.always == b.always and np.array_equal(a.slopes, b.slopes)


def test_quality_without_labels_of_a_class(spark):
    docs = frame(spark, [(1, "a", "en", "s"), (None, None, None, None), (3, "", "en", "s"), (3, "x" * 3_000_000, "en", "s")])
    for marks, score in (([], 0.5), ([(1, 1, 0), (2, 1, 0), (3, 1, 0), (4, 1, 1), (None, 0, 0), (6, None, 0)], None)):
        found = quality.classify(docs, quality.learn(docs, spark.createDataFrame(marks, LABELS))).collect()
        assert len(found) == 4 and len({r.score for r in found}) == 1
        assert score is None or found[0].score == score
    assert quality.classify(docs.limit(0), quality.fit([], {})).count() == 0


def test_long_and_empty_texts_are_scored(spark):
    good = [(f"the quick brown fox {i} jumps over lazy dog number {i * 7}".encode(), 1) for i in range(40)]
    bad = [(f"buy!!! now!!! $$$ {i} cheap!!! $$$".encode(), 0) for i in range(40)]
    fitted = quality.fit(good + bad, {0: 40, 1: 360})
    rows = [(1, None, "", ""), (2, "", "", ""), (3, "buy!!! now!!! $$$ " * 100_000, "", ""), (4, "the quick brown fox jumps over lazy dog", "", "")]
    score = {r.doc_id: r.score for r in quality.classify(frame(spark, rows), fitted).collect()}
    assert score[1] == score[2] and score[4] > score[3] and all(0 <= s <= 1 for s in score.values())


# -- divergence


def brute_divergence(rows, least):
    lang_docs, counts, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in t).split(" ")
        words = [w for w in words if w]
        lang_docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
        total[lang or ""].update(words)
    out = set()
    for lang in lang_docs.keys():
        kept = sorted((t for t, n in lang_docs[lang].items() if n >= least), key=lambda t: t.encode())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(counts[x, s]) for x, s in counts if x == lang}, share(total[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:10]
            out |= {(lang, s, part, item.decode(), -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(found, 1)}
    return out


def test_divergence_is_as_counted_one_by_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    terms = ["the", "The", "naïve", "élan", "z", "日本", "a", "Ä"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(terms, 30)) + " 3x_y-z", rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "é"])) for i in range(400)]
    rows += [(1000, None, "en", "empty"), (1001, "", "fr", "f1"), (1002, "seul", "fr", "f2"), (1003, "only", "it", "i1"), (None, "the", "en", "s1"), (None, "the", "en", "s1")]
    rows += [(1004, "the " * 300_000 + "x" * 1_500_000 + " the élan", "en", "long")]
    monkeypatch.setattr(dv, "BLOCK", 2)  # several blocks of groups
    found = [tuple(r) for r in dv.divergence(frame(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == brute_divergence(rows, 10)


def test_divergence_of_an_empty_table(spark):
    assert dv.divergence(frame(spark, [], 1)).count() == 0


def test_trees_share_equal_subtrees_and_pairs():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (6, 64))
    counts[:, 50:] = -1
    counts[3] = counts[2]
    forest = dv.Forest(counts)
    assert forest.roots[2] == forest.roots[3]
    assert all(len(left) <= 6 * 64 >> level + 1 for level, (left, _) in enumerate(forest.children))
    totals = np.maximum(counts, 0).sum(axis=1)
    a, b = np.array([0, 1, 2, 5, 4]), np.array([1, 2, 3, 0, 4])
    p = [[1 + 10**9 * (int(c) + 2) // (int(n) + 100) for c in row[:50]] for row, n in zip(counts, totals)]
    assert dv.walk(forest, a, b, totals, 50).tolist() == [sum((x - y) ** 2 // (x + y) for x, y in zip(p[i], p[j])) for i, j in zip(a, b)]


def test_shares_are_exact():
    count, total, terms = [0, 10**15, 7 * 10**15, 123456789012345], [10**15, 10**15, 8 * 10**15, 2 * 10**14], [10**6, 1, 10**7, 3]
    found = dv.billionths(*(np.array(x, np.int64) for x in (count, total, terms)))
    assert found.tolist() == [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in zip(count, total, terms)]
    p = np.array([1, 10**9 + 1, 10**9, 5], np.int64)
    assert dv.price(p, p[::-1]).tolist() == [(int(x) - int(y)) ** 2 // (int(x) + int(y)) for x, y in zip(p, p[::-1])]
