"""A training-data pipeline over `documents`: each stage's table is the next one's input.

Language identification drops what it can't tell; of each group of near duplicates one document
stays; secrets are masked; the sources are mixed, which repeats or leaves out documents; and the
texts are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.bpe import encode_documents
from kbspark.llm.common import discard, table, written
from kbspark.llm.langid import identify
from kbspark.llm.minhash import near_duplicates
from kbspark.llm.mixing import mix
from kbspark.llm.queries import tokenizer_path
from kbspark.llm.secrets import redact

#: Documents whose largest share of one language is below this are rejected.
LEAST_SCORE = 0.4


def _rows(docs: DataFrame) -> DataFrame:
    """row: all columns of docs; key: tells rows apart that differ in anything and sorts by id, nulls last; text, source.

    Whatever the columns of docs are called, no name clashes with what a stage adds.
    """
    every = [docs[c] for c in docs.columns]
    key = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"], F.xxhash64(*every).alias("a"), F.xxhash64(F.lit(1), *every).alias("b"))
    return docs.select(F.struct(*every).alias("row"), key.alias("key"), docs["text"], docs["source"])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters (null and empty ones too) and texts of no clear language; all other rows stay as they are.

    Repeated rows fare alike; rows without an id are told but not learned from. Long texts are told whole.
    """
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("rest")
    told = identify(docs.select("doc_id", "text", "lang", rest), keep=("rest", "text"))
    kept = told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates: that with the smallest id; of equal ids, the least row by digest.

    Texts without words, null or empty, are no duplicates; but rows that agree in everything are, and one
    of them stays. A row without an id stays only if nothing like it has one.
    """
    rows = _rows(docs)
    kept = near_duplicates(rows, words=5, similarity=0.8, id_col="key").filter("kept").select(F.col("doc_id").alias("kept"))
    return rows.join(kept, F.col("key") == F.col("kept"), "left_semi").dropDuplicates(["key"]).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind in brackets, in texts of any length, and counts n_chars anew; null and empty texts stay."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each row as often as the mix takes it, 0 to 2 times.

    A null source is a source of its own; null and empty texts weigh nothing and may be left out or
    repeated like others. Rows that agree in everything are counted together.
    """
    rows = _rows(docs)
    taken = mix(rows, id_col="key").groupBy(F.col("doc_id").alias("taken")).agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    out = rows.dropDuplicates(["key"]).join(taken, F.col("key") == F.col("taken"))
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, however long; none for a null or empty text. Repeated rows and other columns play no part."""
    return encode_documents(docs, tokenizer_path(), keep=("lang", "source"), decoded=False)


STAGES = [("language", language), ("near_dedup", near_dedup), ("mask_secrets", mask_secrets), ("mix_sources", mix_sources), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs, before = written(stage(spark, docs, sf_dir)), docs
        if i:
            discard(before)
    return docs
