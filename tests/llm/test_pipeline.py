"""The pipeline's stages on the smallest tables: what each drops, changes and keeps."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm import queries
from kbspark.llm.minhash import near_duplicates

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, None, "src0", 0), (900_002, "... 123 ---", "en", "src0", 11), (None, "a text without an id but with quite clear words", "en", None, 40), (None, "another one without an id that differs from it", "en", None, 40), (900_003, "mail password=abcdefgh12345678 to me", "en", "src1", 36)], docs.schema)
    out, frame = [docs.unionByName(extra).unionByName(docs.limit(2))], docs.unionByName(extra).unionByName(docs.limit(2))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('p')}/{i}"
        stage(spark, frame, SF).write.parquet(path)
        frame = spark.read.parquet(path)
        out.append(frame)
    return out


def test_stages(stages):
    start, language, dedup, masked, mixed, encoded = stages
    assert all(f.columns == COLUMNS for f in (language, dedup, masked, mixed))
    gone = start.exceptAll(language)
    assert {r.doc_id for r in gone.collect()} == {900_001, 900_002}
    ids = Counter(r.doc_id for r in dedup.collect())
    kept = {r.doc_id for r in near_duplicates(language, 5, 0.8).filter("kept").collect() if r.doc_id is not None}
    assert {i for i in ids if i is not None} == kept and ids[None] == 2 and max(n for i, n in ids.items() if i is not None) == 1
    assert masked.count() == dedup.count()
    assert masked.filter("doc_id = 900003").first().text == "mail [assign] to me"
    assert masked.filter("n_chars != length(text)").count() == 0
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= set(ids) and max(n for i, n in copies.items() if i is not None) <= 2
    assert encoded.count() == mixed.count()
    assert Counter(r.doc_id for r in encoded.collect()) == copies


def test_stages_keep_extra_columns_with_clashing_names(spark, stages):
    names = "score lang_pred held_out shares __kinds __id __spans row key rest kept component_id copies target taken size __copy __key".split()
    plain = stages[0]
    extra = plain.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        got, expected = stage(spark, extra, SF), stage(spark, plain, SF)
        assert got.columns == extra.columns
        ids = lambda d: Counter((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
        if stage is not corpus_pipeline.mix_sources:  # whose row of documents is another one
            assert ids(got) == ids(expected), stage
        assert got.filter(" or ".join(f"{c} != 'x{i}'" for i, c in enumerate(names))).count() == 0
    coded = corpus_pipeline.encode(spark, extra, SF)
    assert coded.count() == plain.count() and "score" not in coded.columns


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 11)} and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_empty_input(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.count() == 0
