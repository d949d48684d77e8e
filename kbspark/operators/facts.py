"""Tables to facts: sheets of ragged rows become records, search texts and Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as X

HEADER_SCAN = 5


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c.isNotNull() & (c != "")))


def _headers(cells: Column) -> Column:
    """Names of columns: col_i for a blank one, name_2 and so on for a repeated one."""
    trimmed = F.transform(cells, lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("col_"), i + 1)))
    count = lambda names, i: F.size(F.filter(F.slice(names, 1, i + 1), lambda n: n == F.element_at(names, i + 1)))
    numbered = lambda names: F.transform(names, lambda n, i: F.when(count(names, i) > 1, F.concat(n, F.lit("_"), count(names, i))).otherwise(n))
    return F.element_at(F.transform(F.array(trimmed), numbered), 1)


def parse_sheets(sheets: DataFrame) -> DataFrame:
    """Sheets (source_file, name, rows) with headers and data rows; sheets without a filled cell go.

    Empty rows go first. Of the first five that are left, the one with the most filled cells is the
    header, the earlier of equal ones; the rows behind it are data.
    """
    kept = F.filter("rows", lambda r: r.isNotNull() & (_filled(r) > 0))
    out = sheets.withColumn("rows", kept).filter(F.size("rows") > 0)
    counts = F.transform(F.slice("rows", 1, HEADER_SCAN), lambda r: _filled(r))
    out = out.withColumn("__at", F.array_position(counts, F.array_max(counts)).cast("int"))
    out = out.withColumn("headers", _headers(F.element_at("rows", F.col("__at"))))
    return out.withColumn("rows", F.when(F.size("rows") > F.col("__at"), F.slice("rows", F.col("__at") + 1, F.size("rows"))).otherwise(F.array().cast("array<array<string>>"))).drop("__at")


def fact_text(source: Column, sheet: Column, row: Column, keys: Column, fields: Column) -> Column:
    pairs = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.element_at(fields, k)))
    head = F.concat(F.lit("来源="), source, F.lit("; 表="), sheet, F.lit("; 行="), row.cast("string"))
    return F.concat_ws("; ", head, F.nullif(F.array_join(pairs, "; "), F.lit("")))


def sheets_to_facts(sheets: DataFrame, markdown_name: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One record for each data row: fields without empty cells, numbered from 1 after the empty rows are gone; with the columns in keep."""
    parsed = parse_sheets(sheets.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Sheet1"))))
    rows = parsed.select(*keep, "source_file", F.col("name").alias("sheet"), "headers", F.posexplode("rows").alias("i", "cells"))
    width = F.size("headers")
    cells = F.transform(F.sequence(F.lit(1), width), lambda i: F.get(F.col("cells"), i - 1))
    names = F.array_distinct("headers")
    value = lambda k: F.get(cells, (F.array_position("headers", k) - 1).cast("int"))
    kept = F.filter(names, lambda k: F.coalesce(value(k), F.lit("")) != "")
    rows = rows.withColumn("keys", kept).withColumn("fields", F.map_from_arrays(kept, F.transform(kept, value))).withColumn("row_index", F.col("i") + 1)
    source_md = F.lit(None).cast("string") if markdown_name is None else markdown_name
    rows = rows.withColumn("record_id", F.concat(X.slugify(F.col("sheet")), F.lit(":"), F.col("row_index"))).withColumn("source_markdown_filename", F.coalesce(source_md, F.concat(F.regexp_replace("source_file", r"\.[^.]+$", ""), F.lit(".md"))))
    text = fact_text(F.col("source_file"), F.col("sheet"), F.col("row_index"), F.col("keys"), F.col("fields"))
    return rows.select(*keep, "record_id", "source_file", "source_markdown_filename", "sheet", "row_index", "fields", text.alias("fact_text"))


def sheets_to_markdown(sheets: DataFrame) -> DataFrame:
    """(source_file, sheet, markdown): a Markdown table of each sheet."""
    parsed = parse_sheets(sheets)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.transform("headers", lambda h: F.lit("---"))
    body = F.transform("rows", lambda r: line(F.transform(F.col("headers"), lambda h, i: F.coalesce(F.get(r, i), F.lit("")))))
    return parsed.select("source_file", F.col("name").alias("sheet"), F.array_join(F.concat(F.array(line(F.col("headers")), line(rule)), body), "\n").alias("markdown"))


def indexable(facts: DataFrame, limit: int = 800) -> DataFrame:
    """Records with a text, cut to what is stored."""
    return facts.filter(F.coalesce(F.trim("fact_text"), F.lit("")) != "").withColumn("fact_text", F.substring("fact_text", 1, limit))


def embed_text(source: Column, sheet: Column, row: Column, text: Column) -> Column:
    """The text behind a line that says where it is from."""
    parts = F.array_compact(F.array(F.nullif(source, F.lit("")), F.when(F.coalesce(sheet, F.lit("")) != "", F.concat(F.lit("表="), sheet)), F.when(row.isNotNull(), F.concat(F.lit("行="), row.cast("string")))))
    return F.when(F.size(parts) > 0, F.concat(F.lit("["), F.array_join(parts, " | "), F.lit("]\n"), text)).otherwise(text)


def search_text(facts: DataFrame, limit: int = 2000) -> DataFrame:
    """Adds fact_search_text: origin, sheet, row twice, each field as k=v and as k v, and the text."""
    pair = lambda e: F.when((F.trim(e["key"]) != "") & (F.trim(e["value"]) != ""), F.array(F.concat(F.trim(e["key"]), F.lit("="), F.trim(e["value"])), F.concat(F.trim(e["key"]), F.lit(" "), F.trim(e["value"])))).otherwise(F.filter(F.array(F.trim(e["key"]), F.trim(e["value"])), lambda v: v != ""))
    fields = F.flatten(F.transform(F.map_entries("fields"), pair))
    row = F.when(F.col("row_index").isNotNull(), F.array(F.concat(F.lit("row_index="), F.col("row_index")), F.concat(F.lit("行="), F.col("row_index")))).otherwise(F.array().cast("array<string>"))
    head = F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("source_file", "source_markdown_filename", "sheet")])
    parts = F.filter(F.concat(head, row, fields, F.array(F.trim(F.coalesce("fact_text", F.lit(""))))), lambda p: p != "")
    return facts.withColumn("fact_search_text", F.substring(F.array_join(parts, "\n"), 1, max(200, limit)))
