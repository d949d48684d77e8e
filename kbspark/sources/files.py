"""Sources and sinks of files: Markdown, tables, web pages, logs."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as X
from kbspark.sources.html import html_markdown

#: Extensions that can be uploaded.
EXTENSIONS = ("md", "txt", "csv", "xlsx", "xls", "pdf", "docx", "doc", "pptx", "ppt", "png", "jpg", "jpeg")
TRACE = "ts string, trace_id string, repo string, user string, question string, mode string, latency_ms long, confidence struct<level:string,score:double>, wiki_hits array<string>, chunk_hits array<string>, fact_hits array<string>, answer string"
FACT = "repo_id long, record_id string, source_file string, source_markdown_filename string, sheet string, row_index int, fields map<string,string>, fact_text string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.withColumn("filename", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of the text and Markdown files."""
    rows = _files(spark, path).filter(X.file_ext(F.col("filename")).isin("md", "txt"))
    return rows.select("filename", F.decode("content", "UTF-8").alias("content"))


def read_pages(spark: SparkSession, path: str, repo_id: int = 0) -> DataFrame:
    """Wiki pages: *.md with title, type and updated from their frontmatter."""
    rows = read_text(spark, path).filter(F.endswith("filename", F.lit(".md")))
    return page_fields(rows.withColumn("repo_id", F.lit(repo_id).cast("long")))


def page_fields(rows: DataFrame) -> DataFrame:
    """Adds title (else the file's stem), type (else unknown), updated, source and tags from the content's frontmatter."""
    front = X.frontmatter(F.col("content"))
    get = lambda key: F.try_element_at(F.col("__front"), F.lit(key))
    rows = rows.withColumn("__front", front).withColumn("title", F.coalesce(get("title"), F.regexp_replace("filename", r"\.md$", "")))
    return rows.withColumns({"type": F.coalesce(get("type"), F.lit("unknown")), "updated": F.coalesce(get("updated"), F.lit("")), "source": get("source"), "tags": X.list_items(get("tags"))}).drop("__front")


def list_sources(spark: SparkSession, path: str) -> DataFrame:
    """(filename, size_kb, is_markdown) of raw files; hidden ones and assets are left out."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length")
    rows = rows.withColumn("filename", F.element_at(F.split("path", "/"), -1)).filter(~F.startswith("filename", F.lit(".")) & (F.col("filename") != "assets"))
    return rows.select("filename", F.round(F.col("length") / 1024, 1).alias("size_kb"), F.endswith("filename", F.lit(".md")).alias("is_markdown"))


def _sheets(batches, parse):
    for pdf in batches:
        out = [(name, sheet, rows) for name, content in zip(pdf["filename"], pdf["content"]) for sheet, rows in parse(bytes(content))]
        yield pd.DataFrame(out, columns=["source_file", "name", "rows"])


def _csv_tables(content: bytes):
    rows = list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))))
    return [("CSV", rows)] if rows else []


def _excel_tables(content: bytes):
    import openpyxl

    book = openpyxl.load_workbook(io.BytesIO(content), data_only=True, read_only=True)
    return [(s.title, [[None if c is None else c.isoformat() if hasattr(c, "isoformat") else str(c) for c in r] for r in s.iter_rows(values_only=True)]) for s in book.worksheets]


SHEETS = "source_file string, name string, rows array<array<string>>"


def read_csv_tables(spark: SparkSession, path: str, stem_as_name: bool = False) -> DataFrame:
    """Sheets of the CSV files, ragged rows as they are; a byte-order mark is dropped."""
    rows = _files(spark, path).filter(X.file_ext(F.col("filename")) == "csv").select("filename", "content")
    sheets = rows.mapInPandas(lambda it: _sheets(it, _csv_tables), SHEETS)
    return sheets.withColumn("name", F.regexp_replace("source_file", r"\.[^.]+$", "")) if stem_as_name else sheets


def read_excel_tables(spark: SparkSession, path: str) -> DataFrame:
    """Sheets of the Excel files: values, dates in ISO form. Needs openpyxl on the executors."""
    rows = _files(spark, path).filter(X.file_ext(F.col("filename")).isin("xlsx", "xls")).select("filename", "content")
    return rows.mapInPandas(lambda it: _sheets(it, _excel_tables), SHEETS)


def read_parsed(spark: SparkSession, path: str, parser) -> DataFrame:
    """(filename, content): what parser(name, bytes) -> dict gives for each file, its first part that isn't empty."""

    def run(batches):
        for pdf in batches:
            found = [parser(n, bytes(c)) or {} for n, c in zip(pdf["filename"], pdf["content"])]
            yield pd.DataFrame({"filename": pdf["filename"], "content": [next((f[k] for k in ("md_content", "markdown", "content") if f.get(k)), None) for f in found]})

    return _files(spark, path).select("filename", "content").mapInPandas(run, "filename string, content string")


def url_slug(url: Column) -> Column:
    """Up to 60 characters of host and path, lower case, other characters as -."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://", ""), r"[?#].*$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 60)


def web_text(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep, content): the main part of web pages (html) as Markdown."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for pdf in batches:
            yield pdf.assign(content=[html_markdown(h) for h in pdf["html"]]).drop(columns="html")

    return pages.select(*keep, "html").mapInPandas(run, f"{kinds}, content string")


def web_sources(pages: DataFrame) -> DataFrame:
    """(page_id, url, filename, content) of web pages (page_id, url, html).

    Names that several pages share are numbered, in groups of one name; the content has a header
    with the address.
    """
    numbered = Window.partitionBy("slug").orderBy("page_id", "url")
    rows = pages.withColumn("slug", url_slug(F.col("url"))).withColumn("n", F.row_number().over(numbered) - 1)
    rows = rows.withColumn("filename", F.concat("slug", F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n"))).otherwise(""), F.lit(".md")))
    return web_text(rows, "page_id", "url", "filename").withColumn("content", F.concat(F.lit("---\nsource: "), F.col("url"), F.lit("\n---\n\n"), F.col("content")))


def merge_topic(pages: DataFrame, topic: str, order: str, text: str, origin: str) -> DataFrame:
    """One text for each topic: its pages in order, each under a line that names its origin."""
    part = F.concat(F.lit("<!-- "), F.col(origin), F.lit(" -->\n"), F.col(text))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return pages.groupBy(topic).agg(F.array_join(F.transform(items, lambda x: x["p"]), "\n\n").alias("content"), F.count("*").alias("n_pages"))


def read_jsonl(spark: SparkSession, path: str, schema: str = FACT) -> DataFrame:
    """Records, one to a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Query traces; malformed lines are skipped."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)


def write_traces(traces: DataFrame, path: str, zone: str = "Asia/Shanghai") -> None:
    """Appends traces (ts a timestamp), a folder for each local day."""
    traces.withColumn("date", X.local_date(F.col("ts"), zone)).write.mode("append").partitionBy("date").json(path)


def read_questions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gold questions from a file {"questions": [...]}; schema describes one of them."""
    return spark.read.schema(f"questions array<struct<{schema}>>").option("multiLine", "true").json(path).select(F.inline("questions"))
