"""The queries of these operators over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.llm.bpe import encode_documents
from kbspark.llm.common import shared_dir, table
from kbspark.llm.divergence import divergence
from kbspark.llm.fingerprints import fingerprint_digest
from kbspark.llm.langid import identify
from kbspark.llm.licenses import scan_licenses
from kbspark.llm.minhash import near_duplicates
from kbspark.llm.mixing import mix
from kbspark.llm.oracles import ORACLE_SQL  # noqa: F401
from kbspark.llm.quality import classify, learn
from kbspark.llm.secrets import scan_digest
from kbspark.llm.shards import store_documents
from kbspark.llm.suffixes import remove_repeats
from kbspark.llm.survival import audit_filters
from kbspark.llm.topk import top_k, whole_numbers


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_top_k(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", whole_numbers(F.col("embedding")))
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5)


def op2_secret_scan(spark, sf_dir):
    return scan_digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents")).drop("shares")


def op4_mix_sources(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op5_shards(spark, sf_dir):
    return store_documents(table(spark, sf_dir, "documents"), shared_dir(spark))


def op6_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), passage_words=51)


def op7_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=0.85)


def op8_fingerprints(spark, sf_dir):
    return fingerprint_digest(table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    found = scan_licenses(table(spark, sf_dir, "documents"))
    listed = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["first_word"], x["last_word"]))
    return found.withColumn("licenses", F.array_join(listed, ","))


def op10_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False, decoded=False)


def op11_filter_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))


def op13_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_top_k, op2_secret_scan, op3_language_id, op4_mix_sources, op5_shards, op6_suffix_dedup, op7_minhash_dedup, op8_fingerprints, op9_license_scan, op10_bpe, op11_filter_audit, op12_quality, op13_divergence)}
