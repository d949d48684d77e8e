"""The domain's tables, derived from the given ones."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.graph import SYSTEM_PAGES  # noqa: F401

# Metadata relations as they are stored.
SCHEMAS = {
    "users": "user_id long, username string, email string, email_verified boolean, display_name string, created_at timestamp",
    "repos": "repo_id long, owner_id long, name string, slug string, description string, source_count int, page_count int, is_public boolean, created_at timestamp, updated_at timestamp",
    "members": "repo_id long, user_id long, role string, granted_by long, share_code_id long, created_at timestamp",
    "share_codes": "code string, repo_id long, role string, use_count int, is_active boolean, created_at timestamp",
    "tasks": "task_id long, repo_id long, type string, status string, input_data string, progress int, cancel_requested boolean, created_at timestamp, started_at timestamp, finished_at timestamp",
    "query_logs": "trace_id string, repo_id long, user_id long, question string, answer string, confidence string, wiki_hit_count int, chunk_hit_count int, retrieval_json string, query_mode string, latency_ms long, created_at timestamp",
    "sessions": "session_key string, repo_id long, user_id long, title string, messages_json string, updated_at timestamp",
    "audit": "audit_id long, user_id long, action string, resource_type string, resource_id long, detail string, ip string, created_at timestamp",
    "feedback": "trace_id string, repo_id long, user_id long, rating string, comment string, created_at timestamp",
    "api_tokens": "token_id long, user_id long, scopes string, expires_at timestamp, last_used_at timestamp, is_active boolean",
    "pages": "repo_id long, filename string, title string, type string, tags array<string>, source string, updated string, content string",
    "chunks": "repo_id long, filename string, chunk_id string, heading string, chunk_text string, position int, page_title string, page_type string",
    "facts": "repo_id long, record_id string, source_file string, source_markdown_filename string, sheet string, row_index int, fields map<string,string>, fact_text string",
}

#: The page types of each template, and the keys that its frontmatter lists.
TEMPLATES = [
    ("default", ["concept", "guide", "reference", "overview", "comparison", "log", "index"], ["title", "type", "tags", "source", "updated"]),
    ("academic", ["paper", "concept", "method", "result", "comparison", "overview", "index", "log"], ["title", "type", "tags", "source", "evidence_level", "updated"]),
    ("product", ["feature", "guide", "reference", "faq", "changelog", "overview", "index", "log"], ["title", "type", "version", "updated"]),
    ("tech_notes", ["concept", "howto", "snippet", "troubleshoot", "overview", "index", "log"], ["title", "type", "tags", "updated"]),
    ("written", ["concept", "entity", "source", "overview", "analysis"], ["title", "type", "updated"]),
]


def templates(spark: SparkSession) -> DataFrame:
    """(template, types, fields)."""
    return spark.createDataFrame(TEMPLATES, "template string, types array<string>, fields array<string>")


def repo_template(repo: str = "repo_id"):
    """Repositories follow the templates in turn."""
    return F.element_at(F.array(*[F.lit(t) for t, _, _ in TEMPLATES]), (F.pmod(F.col(repo), F.lit(len(TEMPLATES))) + 1).cast("int"))


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repo_of(source: str = "source"):
    return F.regexp_extract(source, "[0-9]+", 0).cast("long")


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, repo_id, filename, title, type, source, content) of documents, with frontmatter and a link."""
    docs = given(spark, sf_dir, "documents")
    n = docs.count()
    title = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), 1, 5), " ")
    kind = F.when(F.col("lang") == "en", "concept").when(F.col("lang") == "fr", "entity").when(F.col("lang") == "de", "source").otherwise("memo")
    target = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("missing-"), F.col("doc_id"))).otherwise(F.concat(F.lit("doc-"), (F.col("doc_id") + 20 * (F.col("doc_id") % 7 + 1)) % F.lit(n)))
    rows = docs.select("doc_id", repo_of().alias("repo_id"), F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("filename"), F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled")).alias("title"), kind.alias("type"), F.concat(F.lit("upload-"), F.col("doc_id") % 50, F.lit(".pdf")).alias("source"), "text", target.alias("target"))
    head = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntype: "), "type", F.lit("\nsource: "), "source", F.lit("\nupdated: 2024-01-01\n---\n\n")))
    return rows.withColumn("content", F.concat(head, "text", F.lit("\n\n[next]("), "target", F.lit(".md)"))).drop("text", "target")


WIKI = r"""wiki AS (SELECT doc_id, repo_id, filename, title, type, source,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE '---' || chr(10) || 'title: ' || title || chr(10) || 'type: ' || type || chr(10) || 'source: ' || source || chr(10) || 'updated: 2024-01-01' || chr(10) || '---' || chr(10) || chr(10) END
  || text || chr(10) || chr(10) || '[next](' || target || '.md)' AS content, target || '.md' AS target
 FROM (SELECT doc_id, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS repo_id, 'doc-' || doc_id || '.md' AS filename,
  coalesce(nullif(array_to_string(regexp_extract_all(text, '[A-Za-z0-9_]+')[1:5], ' '), ''), 'untitled') AS title,
  CASE lang WHEN 'en' THEN 'concept' WHEN 'fr' THEN 'entity' WHEN 'de' THEN 'source' ELSE 'memo' END AS type,
  'upload-' || (doc_id % 50) || '.pdf' AS source, text,
  CASE WHEN doc_id % 13 = 0 THEN 'missing-' || doc_id ELSE 'doc-' || ((doc_id + 20 * (doc_id % 7 + 1)) % (SELECT count(*) FROM documents)) END AS target FROM documents))"""


#: Words and characters of the language that cjk() writes in.
CJK_WORDS, CJK_CHARACTERS = 1500, 500
#: Documents that a task puts into it at once, and given words whose number it remembers, at most.
CJK_ROWS, CJK_KNOWN = 2048, 1 << 17
#: Commas and stops that end a word, or stand before a line's end there.
CJK_STOPS = re.compile("[.,]+(?=[\x85\u2028\u2029]?\\Z)")


def _cjk_words() -> list[str]:
    code = lambda w, i: chr(0x4E00 + zlib.crc32(f"{w}:{i}".encode()) % CJK_CHARACTERS)
    return ["".join(code(w, i) for i in range(1, (1, 2, 2, 2, 2, 3, 3, 2, 4, 2)[w % 10] + 1)) for w in range(CJK_WORDS)]


def cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, repo_id, words, text) of documents, whose words are put into one of CJK_WORDS words of one to four CJK characters, without blanks; a comma stays where a word ends with one or with a stop."""
    spelled = _cjk_words()

    class Numbers(dict):
        """Of a given word: twice the number of the one written for it, and one more if a comma follows."""

        def __missing__(self, w):
            if len(self) > CJK_KNOWN:
                self.clear()
            self[w] = n = zlib.crc32(CJK_STOPS.sub("", w).lower().encode()) % CJK_WORDS * 2 + bool(CJK_STOPS.search(w))
            return n

    def write(batches):
        numbers, words = Numbers(), pa.array(spelled, pa.string())
        marked = pa.array([w + mark for w in spelled for mark in ("", "，")], pa.string())
        for batch in batches:
            for i in range(0, batch.num_rows, CJK_ROWS):
                some = batch.slice(i, CJK_ROWS)
                split = pc.ascii_split_whitespace(some.column(2))
                flat, n = split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy()
                full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # blanks at a text's ends part no words
                ends = pa.array(np.append(0, np.append(0, np.cumsum(full))[np.cumsum(n)]).astype(np.int32))
                coded = flat.filter(pa.array(full)).dictionary_encode()
                number = np.array([numbers[w] for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
                lists = [pa.ListArray.from_arrays(ends, x.take(pa.array(at)), mask=split.is_null()) for x, at in ((words, number >> 1), (marked, number))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), lists[0], pc.binary_join(lists[1], "")], names=["doc_id", "repo_id", "words", "text"])

    rows = given(spark, sf_dir, "documents").select("doc_id", repo_of().alias("repo_id"), "text")
    return rows.mapInArrow(write, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, repo_id bigint, words array<string>, text string")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one repository: (repo_id, id, text)."""
    return given(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("repo_id"), F.col("doc_id").alias("id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_id, query_id, question) of the benchmark."""
    return given(spark, sf_dir, "benchmark").select(F.lit(0).cast("long").alias("repo_id"), F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fact records of one repository, keyed by id."""
    names = ("p_name", "p_brand", "p_type", "p_size")
    fields = F.create_map(*[x for c in names for x in (F.lit(c[2:]), F.col(c).cast("string"))])
    pairs = F.concat_ws("; ", *[F.concat(F.lit(f"{c[2:]}="), F.col(c).cast("string")) for c in names])
    rows = given(spark, sf_dir, "part").select(F.lit(0).cast("long").alias("repo_id"), F.col("p_partkey").alias("id"), F.concat(F.lit("part:"), F.col("p_partkey") + 1).alias("record_id"), F.lit("parts.csv").alias("source_file"), F.lit("parts.md").alias("source_markdown_filename"), F.lit("part").alias("sheet"), (F.col("p_partkey") + 1).cast("int").alias("row_index"), fields.alias("fields"), F.col("p_name"), pairs.alias("pairs"))
    return rows.withColumn("fact_text", F.concat(F.lit("来源=parts.csv; 表=part; 行="), "row_index", F.lit("; "), "pairs")).drop("p_name", "pairs")


PART_FACTS = """part_facts AS (SELECT p_partkey AS id, 'part:' || (p_partkey + 1) AS record_id, CAST(p_partkey + 1 AS INTEGER) AS row_index, p_name, p_brand, p_type, p_size,
  '来源=parts.csv; 表=part; 行=' || (p_partkey + 1) || '; name=' || p_name || '; brand=' || p_brand || '; type=' || p_type || '; size=' || p_size AS fact_text FROM part)"""


def part_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on every hundredth part: its brand, size and name."""
    return given(spark, sf_dir, "part").filter("p_partkey % 100 = 0").select(F.lit(0).cast("long").alias("repo_id"), F.col("p_partkey").alias("query_id"), F.concat(F.lit("which "), "p_name", F.lit(" has brand "), "p_brand", F.lit(" and size "), F.col("p_size").cast("string")).alias("question"))


PART_QUESTIONS = "part_questions AS (SELECT p_partkey AS query_id, 'which ' || p_name || ' has brand ' || p_brand || ' and size ' || p_size AS question FROM part WHERE p_partkey % 100 = 0)"


#: Keys of a sheet, so that no sheet grows with the table.
SHEET_KEYS = 5000


def customer_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of customers by nation and range of SHEET_KEYS keys: title row, header, an empty row, then the rows by key."""
    row = F.struct("c_custkey", F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_mktsegment"), F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_custkey").cast("string"))).alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    head = F.array(F.array(F.lit("Customers")), F.array(F.lit("key"), F.lit("name"), F.lit(" "), F.lit("name")), F.array(F.lit(""), F.lit("")))
    part = F.floor(F.col("c_custkey") / SHEET_KEYS)
    sheets = given(spark, sf_dir, "customer").groupBy("c_nationkey", part.alias("part")).agg(F.concat(head, rows).alias("rows"))
    return sheets.select(F.concat(F.lit("customers-"), "c_nationkey", F.lit("-"), "part", F.lit(".csv")).alias("source_file"), F.lit("CSV").alias("name"), "rows")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.lower("n_name").alias("username"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo_id"), F.col("s_nationkey").cast("long").alias("owner_id"), F.col("s_name").alias("name"), F.concat(F.lit("kb-"), "s_suppkey").alias("slug"), (F.col("s_suppkey") % 5 == 0).alias("is_public"), F.col("s_acctbal").alias("updated_at"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations belong to the suppliers that they order from, thinned out."""
    lines = given(spark, sf_dir, "lineitem").filter("(l_orderkey + l_suppkey) % 17 = 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("repo_id"))
    bought = given(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_custkey").alias("c_custkey"), "repo_id")
    rows = given(spark, sf_dir, "customer").join(bought, "c_custkey").select("repo_id", F.col("c_nationkey").cast("long").alias("user_id")).distinct()
    return rows.filter("(repo_id * 7 + user_id) % 11 = 0").withColumn("role", F.when((F.col("repo_id") + F.col("user_id")) % 3 == 0, "editor").otherwise("reader"))


ACCESS = """users AS (SELECT CAST(n_nationkey AS BIGINT) AS user_id, lower(n_name) AS username FROM nation),
repos AS (SELECT s_suppkey AS repo_id, CAST(s_nationkey AS BIGINT) AS owner_id, s_name AS name, 'kb-' || s_suppkey AS slug, s_suppkey % 5 = 0 AS is_public FROM supplier),
members AS (SELECT DISTINCT l_suppkey AS repo_id, CAST(c_nationkey AS BIGINT) AS user_id, CASE WHEN (l_suppkey + c_nationkey) % 3 = 0 THEN 'editor' ELSE 'reader' END AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE (l_orderkey + l_suppkey) % 17 = 0 AND (l_suppkey * 7 + c_nationkey) % 11 = 0)"""


#: Words that tell questions apart, for the languages of `conversations`.
MODE_WORDS = ("which", " from ", " und ", " le "), ("that", " was ", " die ", " que ")
MODES = """SELECT CASE WHEN fact AND narrative THEN 'hybrid' WHEN fact THEN 'fact' ELSE 'narrative' END AS mode FROM (SELECT contains(q, 'which') OR contains(q, ' from ') OR contains(q, ' und ') OR contains(q, ' le ') AS fact,
 contains(q, 'that') OR contains(q, ' was ') OR contains(q, ' die ') OR contains(q, ' que ') AS narrative FROM (SELECT trim(lower(text)) AS q FROM conversations))"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as query logs: (trace_id, repo_id, user_id, question, confidence, query_mode, latency_ms, created_at)."""
    e = given(spark, sf_dir, "events")
    level = F.when(F.col("event_type").isin("purchase", "signup"), "high").when(F.col("event_type") == "view", "medium").otherwise("low")
    mode = F.element_at(F.array(F.lit("fact"), F.lit("narrative"), F.lit("hybrid")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.concat(F.lit("t"), "event_id").alias("trace_id"), (F.col("event_id") % 120).alias("repo_id"), F.when(F.col("event_id") % 9 != 0, F.col("user_id") % 25).alias("user_id"), F.col("props").alias("question"), level.alias("confidence"), mode.alias("query_mode"), F.floor(F.col("value") * 10).alias("latency_ms"), F.col("ts").alias("created_at"), "event_id")


LOGS = """logs AS (SELECT 't' || event_id AS trace_id, event_id % 120 AS repo_id, CASE WHEN event_id % 9 <> 0 THEN user_id % 25 END AS user_id, props AS question,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'high' WHEN event_type = 'view' THEN 'medium' ELSE 'low' END AS confidence,
  CASE event_id % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'narrative' ELSE 'hybrid' END AS query_mode, CAST(floor(value * 10) AS BIGINT) AS latency_ms, ts AS created_at, event_id FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = given(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("queued")
    return e.select(F.col("event_id").alias("task_id"), (F.col("event_id") % 20).alias("repo_id"), F.concat(F.lit("upload-"), F.col("event_id") % 700, F.lit(".pdf")).alias("source_file"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("started_at"))


TASKS = """tasks AS (SELECT event_id AS task_id, event_id % 20 AS repo_id, 'upload-' || (event_id % 700) || '.pdf' AS source_file,
  CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, ts AS created_at, ts AS started_at FROM events)"""
