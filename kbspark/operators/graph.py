"""The pages' link graph, and what can be said about pages and sources from it and from names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as X

#: Pages that the system writes itself.
SYSTEM_PAGES = ("index.md", "overview.md", "log.md", "schema.md")
TYPE_ORDER = ("overview", "concept", "entity", "source", "analysis")


def edges(pages: DataFrame) -> DataFrame:
    """(repo_id, source, target): all links to pages, repeated ones and those to nowhere included."""
    return pages.select("repo_id", F.col("filename").alias("source"), F.explode(X.links(F.col("content"))).alias("target")).withColumn("target", F.concat("target", F.lit(".md")))


def link_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (repo_id, id, title, type), and the edges whose target exists."""
    nodes = pages.select("repo_id", F.col("filename").alias("id"), "title", "type")
    known = pages.select("repo_id", F.col("filename").alias("target"))
    return nodes, edges(pages).join(known, ["repo_id", "target"], "left_semi").select("repo_id", "source", "target")


def backlinks(pages: DataFrame) -> DataFrame:
    """(repo_id, target, filename, title): pages that link to a page, with or without .md in the address."""
    found = F.regexp_extract_all("content", F.lit(r"\]\(([^)\s]+?)(?:\.md)?\)"), F.lit(1))
    rows = pages.select("repo_id", "filename", "title", F.explode(F.array_distinct(found)).alias("target")).withColumn("target", F.concat("target", F.lit(".md")))
    return rows.join(pages.select("repo_id", F.col("filename").alias("target")), ["repo_id", "target"], "left_semi").select("repo_id", "target", "filename", "title")


def orphans(pages: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    linked = edges(pages).filter("source != target").select("repo_id", F.col("target").alias("filename"))
    return pages.select("repo_id", "filename").filter(~F.col("filename").isin(*SYSTEM_PAGES)).join(linked, ["repo_id", "filename"], "left_anti")


def broken_links(pages: DataFrame) -> DataFrame:
    """(repo_id, source, target) of links to pages that don't exist."""
    return edges(pages).join(pages.select("repo_id", F.col("filename").alias("target")), ["repo_id", "target"], "left_anti").select("repo_id", "source", "target").distinct()


def vocabulary(repos: DataFrame, templates: DataFrame) -> DataFrame:
    """(repo_id, type): the page types of each repository's template. repos: (repo_id, template); templates: (template, types)."""
    return repos.join(F.broadcast(templates), "template").select("repo_id", F.explode("types").alias("type"))


def lint(pages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(repo_id, type, page, description) of structural faults. vocabulary: (repo_id, type), the types that a repository's pages may have."""
    issue = lambda kind, page, text: F.struct(F.lit(kind).alias("type"), page.alias("page"), text.alias("description"))
    get = lambda c: F.try_element_at(F.col("f"), F.lit(c))
    page = F.col("filename")
    # a page's own faults in one pass over its leading block
    front = pages.filter(~page.isin(*SYSTEM_PAGES)).select("repo_id", "filename", X.frontmatter(F.col("content")).alias("f"))
    front = front.select("repo_id", "filename", get("title").alias("title"), get("type").alias("type"), get("updated").alias("updated"))
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("title", "type", "updated")])
    known = vocabulary.select("repo_id", "type").distinct().withColumn("__known", F.lit(True))
    own = F.array_compact(
        F.array(
            F.when(missing != "", issue("bad_frontmatter", page, F.concat(F.lit("lacks "), missing))),
            F.when(F.col("type").isNotNull() & F.col("__known").isNull(), issue("wrong_type", page, F.concat(F.lit("unknown type "), F.col("type")))),
        )
    )
    rows = [
        front.join(known, ["repo_id", "type"], "left").select("repo_id", F.inline(own)),
        orphans(pages).select("repo_id", F.inline(F.array(issue("orphan", page, F.lit("no page links here"))))),
        broken_links(pages).select("repo_id", F.inline(F.array(issue("broken_link", F.col("source"), F.concat(F.lit("links to "), F.col("target")))))),
    ]
    return reduce(DataFrame.unionByName, rows)


#: The part of a lint report that an issue belongs to, and the issues that can be mended.
REPORT_PARTS = {"contradiction": "contradictions", "orphan": "orphan_pages", "missing_link": "missing_refs", "bad_frontmatter": "missing_refs", "wrong_type": "missing_refs"}
FIXABLE = ("bad_frontmatter", "orphan", "missing_link", "wrong_type")


def report_part(kind: Column) -> Column:
    """The part of the report for an issue's type, missing_refs for any other."""
    named = F.create_map(*[F.lit(x) for pair in REPORT_PARTS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.coalesce(kind, F.lit(""))), F.lit("missing_refs"))


def lint_report(issues: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """(repo_id, part, page_slug, message, fixable) of structural issues and those that a model found (repo_id, type, page, description).

    suggestions: (repo_id, message), the model's advice that belongs to no page.
    """
    slug = F.nullif(F.replace(F.coalesce("page", F.lit("")), F.lit(".md"), F.lit("")), F.lit(""))
    rows = issues.select("repo_id", report_part(F.col("type")).alias("part"), slug.alias("page_slug"), F.col("description").alias("message"), F.coalesce(F.col("type").isin(*FIXABLE), F.lit(False)).alias("fixable"))
    if suggestions is None:
        return rows
    return rows.unionByName(suggestions.select("repo_id", F.lit("suggestions").alias("part"), F.lit(None).cast("string").alias("page_slug"), "message", F.lit(False).alias("fixable")))


def exact_duplicates(sources: DataFrame, key: str = "filename", content: str = "content") -> DataFrame:
    """(repo_id, key, kept): sources with the content of another one, and the first of these."""
    hashed = sources.select("repo_id", key, F.md5(F.col(content).cast("binary")).alias("md5"))
    firsts = hashed.groupBy("repo_id", "md5").agg(F.min(key).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    return hashed.join(firsts, ["repo_id", "md5"]).filter(F.col(key) != F.col("kept")).select("repo_id", key, "kept")


def similar_titles(pages: DataFrame, least: float = 0.6) -> DataFrame:
    """(repo_id, a, b, similarity): pages whose titles share words (Jaccard).

    Titles are grouped by their word sets first. Two sets that are alike enough share one of the first
    words of each, by rarity: those are the only ones that are joined.
    """
    words = F.array_sort(F.array_distinct(X.router_tokens(F.col("title"))))
    sets = pages.select("repo_id", "filename", words.alias("w")).filter(F.size("w") > 0)
    distinct = sets.groupBy("repo_id", "w").agg(F.min("filename").alias("one"))
    freq = distinct.select("repo_id", F.explode("w").alias("word")).groupBy("repo_id", "word").count()
    ordered = distinct.select("repo_id", "w", F.explode("w").alias("word")).join(freq, ["repo_id", "word"])
    rarest = Window.partitionBy("repo_id", "w").orderBy("count", "word")
    prefix = ordered.withColumn("i", F.row_number().over(rarest)).filter(F.col("i") <= F.size("w") - F.ceil(F.size("w") * F.lit(least)) + 1).select("repo_id", "w", "word")
    pairs = prefix.join(prefix.withColumnRenamed("w", "w2"), ["repo_id", "word"]).filter("w < w2").select("repo_id", "w", "w2").distinct()
    shared = F.size(F.array_intersect("w", "w2"))
    alike = pairs.withColumn("similarity", shared / (F.size("w") + F.size("w2") - shared)).filter(F.col("similarity") >= least)
    names = distinct.select("repo_id", "w", "one")
    found = alike.join(names.withColumnRenamed("one", "a"), ["repo_id", "w"]).join(names.select("repo_id", F.col("w").alias("w2"), F.col("one").alias("b")), ["repo_id", "w2"]).select("repo_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    same = sets.join(names, ["repo_id", "w"]).filter("filename != one").select("repo_id", F.col("one").alias("a"), F.col("filename").alias("b"), F.lit(1.0).alias("similarity"))
    return found.unionByName(same)


def pages_from_sources(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo_id, source_file, filename): pages made of a source, by frontmatter, by stem, or by stem and a suffix."""
    stem = F.regexp_replace("source_file", r"\.[^.]+$", "")
    s = sources.select("repo_id", "source_file", X.slugify(stem).alias("stem"))
    p = pages.filter(~F.col("filename").isin(*SYSTEM_PAGES)).select("repo_id", "filename", "source", F.regexp_replace("filename", r"\.md$", "").alias("name"))
    # every prefix of a name that ends before a -, and the name itself, may be a stem
    cuts = F.transform(F.sequence(F.lit(1), F.size(F.split("name", "-"))), lambda i: F.array_join(F.slice(F.split("name", "-"), 1, i), "-"))
    by_name = p.select("repo_id", "filename", F.explode(cuts).alias("stem")).join(s, ["repo_id", "stem"])
    by_source = p.select("repo_id", "filename", F.col("source").alias("source_file")).join(s, ["repo_id", "source_file"])
    return by_name.select("repo_id", "source_file", "filename").union(by_source.select("repo_id", "source_file", "filename")).distinct()


def fact_conflicts(facts: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """(repo_id, entity, field, values): entities for which sources give different values of a field."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.element_at("fields", f).alias("value")) for f in fields])).alias("x")
    rows = facts.select("repo_id", F.element_at("fields", entity).alias("entity"), one).select("repo_id", "entity", "x.field", "x.value").filter("entity is not null and value is not null")
    # values are made distinct before those of an entity meet
    return rows.distinct().groupBy("repo_id", "entity", "field").agg(F.array_sort(F.collect_list("value")).alias("values")).filter(F.size("values") > 1)


def ingest_log(logs: DataFrame) -> DataFrame:
    """(repo_id, source, pages) of log pages (repo_id, content): sections `## time — Ingested `file``; the last of a source counts."""
    parts = logs.select("repo_id", F.posexplode(F.split("content", r"(?m)^## ")).alias("i", "s"))
    named = parts.withColumn("source", F.regexp_extract("s", r"^[^\n]*Ingested `([^`]+)`", 1)).filter("source != ''")
    listed = F.flatten(F.transform(F.regexp_extract_all("s", F.lit(r"(?m)^- (?:Created|Updated): *(.*)$"), F.lit(1)), lambda x: F.split(x, ",")))
    pages = F.filter(F.transform(listed, lambda x: F.regexp_extract(x, r"([^\s\[\]()`]+\.md)", 1)), lambda x: (x != "") & ~F.array_contains(F.array(*[F.lit(p) for p in SYSTEM_PAGES]), x))
    last = Window.partitionBy("repo_id", "source").orderBy(F.desc("i"))
    return named.withColumn("pages", F.array_distinct(pages)).withColumn("n", F.row_number().over(last)).filter("n = 1").select("repo_id", "source", "pages")


def drop_log_sections(logs: DataFrame, gone: DataFrame) -> DataFrame:
    """Log pages without the sections of the sources in gone (repo_id, source)."""
    parts = logs.select("repo_id", F.posexplode(F.split("content", r"(?m)^(?=## )")).alias("i", "s"))
    parts = parts.withColumn("source", F.regexp_extract("s", r"^## [^\n]*Ingested `([^`]+)`", 1))
    kept = parts.join(gone, ["repo_id", "source"], "left_anti")
    return kept.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), "").alias("content"))


def affected_pages(state: DataFrame, log: DataFrame) -> DataFrame:
    """(repo_id, source, pages) of documents: what their state (repo_id, source, affected_pages, created, updated) lists, else the log's pages."""
    some = lambda c: F.when(F.size(c) > 0, c)
    both = F.array_union(F.coalesce("created", F.array().cast("array<string>")), F.coalesce("updated", F.array().cast("array<string>")))
    joined = state.join(log.withColumnRenamed("pages", "logged"), ["repo_id", "source"], "left")
    pages = F.coalesce(some(F.col("affected_pages")), some(both), F.col("logged"), F.array().cast("array<string>"))
    return joined.select("repo_id", "source", F.filter(pages, lambda p: ~p.isin(*SYSTEM_PAGES)).alias("pages"))


def delete_documents(gone: DataFrame, pages: DataFrame, chunks: DataFrame, facts: DataFrame, logs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without the given documents (repo_id, source_file), the pages made of them, and their chunks and facts.

    The index pages (repo_id, content) are made anew from the pages that stay. logs: (repo_id, content),
    the ingest logs, of which the documents' sections go.
    """
    made = pages_from_sources(pages, gone).select("repo_id", "filename")
    left = pages.join(made, ["repo_id", "filename"], "left_anti")
    out = {
        "pages": left,
        "chunks": chunks.join(made, ["repo_id", "filename"], "left_anti"),
        "facts": facts.join(gone.select("repo_id", "source_file"), ["repo_id", "source_file"], "left_anti"),
        "index": index_page(left),
    }
    if logs is not None:
        out["logs"] = drop_log_sections(logs, gone.select("repo_id", F.col("source_file").alias("source")))
    return out


def pages_by_type(pages: DataFrame) -> DataFrame:
    """(repo_id, type, place, n, titles): the pages of each type by title, types in a fixed order, others last."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("type")), F.lit(0)), F.lit(len(TYPE_ORDER) + 1)).cast("int")
    items = F.array_sort(F.collect_list(F.struct("title", "filename")))
    return pages.groupBy("repo_id", "type").agg(F.count("*").alias("n"), items.alias("items")).withColumn("place", place)


def index_page(pages: DataFrame) -> DataFrame:
    """(repo_id, content): a page that lists all others by type and title."""
    lines = F.array_join(F.transform("items", lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["filename"], F.lit(")"))), "\n")
    parts = pages_by_type(pages.filter(~F.col("filename").isin(*SYSTEM_PAGES))).select("repo_id", F.struct("place", "type", F.concat(F.lit("## "), F.col("type"), F.lit("\n"), lines).alias("text")).alias("part"))
    return parts.groupBy("repo_id").agg(F.concat(F.lit("# Index\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "\n\n")).alias("content"))


def cross_references(expected: DataFrame, pages: DataFrame) -> DataFrame:
    """expected (repo_id, source, target) with found: whether the graph has the edge."""
    have = edges(pages).distinct().withColumn("found", F.lit(True))
    asked = expected.withColumns({"source": X.norm_page(F.col("source")), "target": X.norm_page(F.col("target"))})
    return asked.join(have, ["repo_id", "source", "target"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def sample_pages(pages: DataFrame, sources: DataFrame | None = None, max_pages: int = 25, page_chars: int = 400, max_chars: int = 8000, max_names: int = 60) -> DataFrame:
    """(repo_id, sample, n_pages, truncated): excerpts of the first pages until the first that would not fit.

    Repositories without content pages get the names of their sources.
    """
    content = pages.filter(~F.col("filename").isin(*SYSTEM_PAGES))
    by_name = Window.partitionBy("repo_id").orderBy("filename")
    rows = content.select("repo_id", "filename", X.excerpt(F.col("content"), page_chars).alias("text")).withColumn("i", F.row_number().over(by_name)).withColumn("total", F.count("*").over(Window.partitionBy("repo_id"))).filter(F.col("i") <= max_pages)
    rows = rows.withColumn("sum", F.sum(F.length("text")).over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.filter(F.col("sum") <= max_chars)
    out = kept.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat("filename", F.lit(": "), "text").alias("t")))), lambda x: x["t"]), "\n").alias("sample"), F.count("*").cast("int").alias("n_pages"), F.max("total").alias("total"))
    out = out.select("repo_id", "sample", "n_pages", (F.col("n_pages") < F.col("total")).alias("truncated"))
    if sources is None:
        return out
    named = sources.join(out, "repo_id", "left_anti").withColumn("i", F.row_number().over(Window.partitionBy("repo_id").orderBy("source_file"))).filter(F.col("i") <= max_names)
    names = named.groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("source_file")), "\n").alias("sample"), F.lit(0).alias("n_pages"), F.lit(True).alias("truncated"))
    return out.unionByName(names)


def literal_search(queries: DataFrame, pages: DataFrame, around: int = 80) -> DataFrame:
    """(query_id, repo_id, filename, snippet, match_count) of pages that hold the query's text, any case.

    queries: (query_id, repo_id, q). A page meets the queries of its repository one by one.
    """
    rows = pages.select("repo_id", "filename", "content").join(queries, "repo_id").filter(F.contains(F.lower("content"), F.lower("q")) & (F.length("q") > 0))
    return rows.select("query_id", "repo_id", "filename", X.snippet(F.col("content"), F.col("q"), around).alias("snippet"), X.occurrences(F.col("content"), F.col("q")).alias("match_count"))
