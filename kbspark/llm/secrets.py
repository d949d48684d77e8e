"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule's pattern implies a Boolean query on trigrams (rules.trigram_query). The index lists, for
every trigram of those queries, the documents that hold it; its postings are intersected into the
candidates of each rule, and only candidates are verified with the pattern. Rules without mandatory
trigrams scan every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import free_name
from kbspark.llm.rules import BASE, RULES, Rule, trigram_query

SPAN = "array<struct<start:int,place:int,kind:string,end:int>>"


def postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The inverted index: (trigram, id), one row for each trigram of the list and document that holds it."""
    lower = F.lower(F.col(text_col))
    held = F.array_compact(F.array(*[F.when(F.contains("__lower", F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = docs.select(F.col(id_col).alias("__id"), lower.alias("__lower")).select("__id", F.explode(held).alias("trigram"))
    return rows.distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(id, kinds): the rules whose trigram queries a document's postings satisfy."""
    clauses = [(r.kind, f"{r.kind}/{i}", len(c), t) for r in rules for i, c in enumerate(trigram_query(r.pattern)) for t in sorted(c)]
    index = postings(docs, sorted({c[3] for c in clauses}), id_col, text_col)
    # as many rows as the rules have trigrams, whatever the documents
    asked = docs.sparkSession.createDataFrame(clauses, "kind string, clause string, size int, trigram string")
    met = index.join(F.broadcast(asked), "trigram").groupBy("__id", "kind", "clause", "size").count().filter("count = size")
    return met.groupBy("__id").agg(F.collect_set("kind").alias("__kinds"))


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Leftmost non-overlapping matches of one rule: start and end in code points, end exclusive.

    The pieces between the matches give their places.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    rows = F.arrays_zip(F.split(text, rule.pattern, -1).alias("p"), matches.alias("m"), judged.alias("g"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast(SPAN)
    # matches are fewer than pieces by one; the last piece has no match and adds nothing
    zipped = F.aggregate(F.filter(rows, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return F.when(F.rlike(text, pattern), zipped).otherwise(none)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "__spans") -> DataFrame:
    """docs with the column `spans_col`: all matches of all rules, by start, then by the order of the rules.

    One row for each row of docs, with all its columns; one that is called `spans_col` already is replaced.
    A null text counts as empty. Ids may be null or repeated: rows that share an id share their
    candidates, and each row's own text is verified. An empty table gives an empty one. Very long texts
    are searched whole.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    own, kinds = free_name(docs, "__id"), free_name(docs, "__kinds")
    found = candidates(docs, indexed, id_col, text_col).withColumnsRenamed({"__id": own, "__kinds": kinds})
    rows = docs.join(found, F.col(id_col).eqNullSafe(F.col(own)), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(SPAN)
    parts = []
    for place, rule in enumerate(rules):
        spans = rule_spans(text, rule, place)
        parts.append(F.when(F.array_contains(kinds, rule.kind), spans).otherwise(none) if rule in indexed else spans)
    return rows.withColumn(spans_col, F.array_sort(F.concat(*parts))).drop(own, kinds)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of their spans, and all spans; other columns play no part."""
    base = F.filter("__spans", lambda s: s["place"] < len(BASE))
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs.select("doc_id", "text")).select("doc_id", *[count(r.kind) for r in BASE], F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret in its text replaced by [kind]; what overlaps is replaced once.

    Null and empty texts stay as they are, and so do other columns, whatever they are called. Repeated
    rows fare alike; texts of any length are cleaned whole; an empty table gives an empty one.
    """
    text, spans_col = F.col(text_col), free_name(docs, "__spans")

    def step(state: Column, s: Column) -> Column:
        clear = F.substr(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        mark = F.when(s["start"] >= state["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], clear, mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(spans_col, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    rows = find_secrets(docs, id_col=id_col, text_col=text_col, spans_col=spans_col)
    return rows.withColumn(text_col, F.when(F.size(spans_col) > 0, cleaned).otherwise(text)).select(docs.columns)
