"""Column functions on text: Markdown, names, tokens, signals. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns below decide results and are stated as they must be.
FACT_WORDS = ("多少", "几", "名单", "列表", "占比", "百分比", "同比", "环比", "增长", "下降", "收入", "销量", "金额", "日期", "时间", "排名", "top", "分别", "各")
NARRATIVE_WORDS = ("总结", "概述", "趋势", "原因", "分析", "解读", "如何", "怎么", "介绍", "建议")
COMPARISON_WORDS = ("对比", "比较", "区别", "差异", "异同", "优缺点", "哪个更", "哪款更", "哪个好", "哪款好", "选哪", "怎么选", "选型", "vs")
UNCERTAIN_PHRASES = ("基于现有资料只能推测到", "现有证据不足以支持更确定的结论", "当前知识库中缺少直接证据")
STOPWORDS = ("的", "了", "和", "与", "及", "在", "是", "有", "这", "那", "哪", "帮我", "查询", "查一下", "查下", "看一下", "看下", "请", "我", "the", "a", "an", "of", "is", "are", "to", "and", "or", "for")
CITATION = r"([A-Za-z0-9_\-\x{4e00}-\x{9fff}]+\.(?:md|docx|doc|pdf|xlsx|xls|pptx|ppt|txt|csv))"
LINK = r"\[[^\]]+\]\(([^)]+)\.md\)"


def _in(*texts: str):
    return F.array(*[F.lit(t) for t in texts])


def any_of(text: Column, phrases) -> Column:
    """Whether text holds one of the phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(p))
    return F.coalesce(found, F.lit(False))


# -- Markdown


def strip_frontmatter(text: Column) -> Column:
    """Without a byte-order mark and a leading block between --- lines."""
    clean = F.regexp_replace(text, "\\A\ufeff", "")
    return F.regexp_replace(clean, r"(?s)\A---\n.*?\n---\n*", "")


def _once(value: Column, f) -> Column:
    """f(value), with the value worked out once: a lambda's argument is, a column that a lambda names is not."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']?\s*$""", "")


def frontmatter(text: Column) -> Column:
    """The `key: value` lines of a leading block as a map; empty if there is none or no such line.

    A list under a key, one `- item` to a line, becomes `[item, item]`, as it is written on one line;
    list_items() parts both. Of keys that are repeated the last one counts. A code fence around the
    whole text is tolerated.
    """
    body = F.regexp_replace(F.ltrim(text), r"\A```[^\n]*\n\s*", "")
    block = F.regexp_extract(body, r"(?s)\A---(.*?)---", 1)
    item = "\u0001"

    def listed(raw: Column) -> Column:
        items = F.transform(F.split(F.substring(raw, 2, 1 << 30), item), _bare)
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))

    def pair(line: Column) -> Column:
        value = F.regexp_replace(line, r"^[^:]*:[ \t\r]*", "")
        return F.struct(F.trim(F.substring_index(line, ":", 1)).alias("k"), F.when(F.startswith(value, F.lit(item)), listed(value)).otherwise(_bare(value)).alias("v"))

    def parsed(block: Column) -> Column:
        lines = F.split(F.regexp_replace(block, r"\r?\n[ \t]*-[ \t]+", item), "\n")
        return F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(r"^[A-Za-z_][A-Za-z0-9_-]*:\s*\S"))), pair)

    def mapped(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))

    return _once(_once(block, parsed), mapped)


def list_items(value: Column) -> Column:
    """The items of a frontmatter list `[a, b]`; any other value is one item, none of a null."""
    inner = F.regexp_extract(value, r"^\[(.*)\]$", 1)
    items = F.filter(F.transform(F.split(inner, ","), lambda x: _bare(F.trim(x))), lambda x: x != "")
    return F.when(value.isNull(), F.array().cast("array<string>")).when(F.rlike(value, F.lit(r"^\[.*\]$")), items).otherwise(F.array(value))


def frontmatter_body(text: Column) -> Column:
    """The text behind a leading block, whether or not a code fence is around it."""
    body = F.regexp_replace(F.ltrim(text), r"\A```[^\n]*\n\s*", "")
    cut = F.regexp_replace(body, r"(?s)\A---.*?---", "")
    unfenced = F.regexp_replace(cut, r"```\s*\z", "")
    return F.when(F.rlike(body, F.lit(r"(?s)\A---.*?---")), unfenced).otherwise(text)


def unwrap_fence(text: Column) -> Column:
    """A text that is one fenced block, without the fence."""
    inner = F.regexp_extract(text, r"(?s)\A\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*\z", 1)
    return F.when(F.rlike(text, F.lit(r"(?s)\A\s*```[a-zA-Z]*\s*\n.*?\n?```\s*\z")), inner).otherwise(F.trim(text))


def safe_json(text: Column, schema: str, default: Column) -> Column:
    """The JSON of a text or of its fenced block; default where it can't be parsed."""
    return F.coalesce(F.from_json(unwrap_fence(text), schema, {"mode": "PERMISSIVE"}), default)


def normalize_bullets(text: Column) -> Column:
    """Puts * bullets that follow one another inside a line on lines of their own, but not in fenced blocks."""
    outside = lambda p: F.regexp_replace(F.regexp_replace(p, r"([：:])\s+\*", "$1\n\n*"), r"(?<![\n*])[ \t]+\*\s+(?=[\x{4e00}-\x{9fff}A-Za-z0-9（(])", "\n* ")
    return F.array_join(F.transform(F.split(text, "```"), lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(p)), "```")


def rewrite_links(text: Column, base: Column) -> Column:
    """[t](x.md) becomes [t](base/x)."""
    return F.regexp_replace(text, F.lit(r"\[([^\]]+)\]\(([^)]+)\.md\)"), F.concat(F.lit("[$1]("), base, F.lit("/$2)")))


def links(text: Column) -> Column:
    """Targets of links to .md pages, without the extension."""
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(1))


def excerpt(text: Column, limit: int) -> Column:
    """The first characters of a page's prose: no frontmatter, fences or marks of headings, blanks folded."""
    lines = F.filter(F.split(strip_frontmatter(text), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("```")))
    prose = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*#{1,6}\s+", ""))
    return F.substring(F.trim(F.regexp_replace(F.array_join(prose, " "), r"\s+", " ")), 1, limit)


# -- names


def slugify(text: Column) -> Column:
    """Lower case; only letters, digits, _ and - stay, and runs of blanks and - become one -, none at the ends."""
    kept = F.regexp_replace(F.lower(text), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s-]+", "-"), r"^-+|-+$", "")


def safe_basename(name: Column) -> Column:
    """The last part of a path without characters that file systems refuse; "" for . and .."""
    base = F.element_at(F.split(F.regexp_replace(F.regexp_replace(name, "\\x00", ""), r"\\", "/"), "/"), -1)
    clean = F.regexp_replace(F.trim(F.regexp_replace(base, r"""[:*?"<>|\x00-\x1f]""", "_")), r"[ .]+$", "")
    return F.coalesce(F.when(base.isin(".", ".."), "").otherwise(clean), F.lit(""))


def norm_page(name: Column) -> Column:
    """The basename with .md; "" for an empty name."""
    base = F.element_at(F.split(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\\", "/"), "/"), -1)
    return F.when(base == "", base).when(F.endswith(base, F.lit(".md")), base).otherwise(F.concat(base, F.lit(".md")))


def file_ext(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def size_display(kb: Column) -> Column:
    return F.when(kb >= 1024, F.concat(F.format_number(kb / 1024, 1), F.lit(" MB"))).otherwise(F.concat(F.format_number(kb, 1), F.lit(" KB")))


def title_from_name(name: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), "[-_]", " "))


def point_id(text: Column) -> Column:
    """The first 64 bits of the MD5 as a whole number from 0."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def point_id63(text: Column) -> Column:
    """The same without the top bit."""
    digits = F.substring(F.md5(text.cast("binary")), 1, 16)
    top = F.translate(F.substring(digits, 1, 1), "89abcdef", "01234567")
    return F.conv(F.concat(top, F.substring(digits, 2, 15)), 16, 10).cast("long")


# -- tokens


def char_bigrams(text: Column) -> Column:
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(grams)


def tokens(text: Column, segmenter=None) -> Column:
    """Lower-case ASCII words, then the bigrams of all CJK characters together; or what a segmenter (such as segment.Lexicon.segmenter()) makes of these."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)
    cjk = F.array_join(F.regexp_extract_all(text, F.lit("[\\x{4e00}-\\x{9fff}]"), F.lit(0)), "")
    # a lambda's argument is computed once
    grams = F.flatten(F.transform(F.array(cjk), char_bigrams)) if segmenter is None else segmenter(cjk)
    return F.coalesce(F.concat(words, F.when(F.rlike(text, F.lit("[\\x{4e00}-\\x{9fff}]")), grams).otherwise(F.array().cast("array<string>"))), F.array().cast("array<string>"))


def router_tokens(text: Column) -> Column:
    """Words of two letters or more that aren't stopwords, and whole runs of CJK characters."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(text, F.lit("[\\x{4e00}-\\x{9fff}]+"), F.lit(0))
    kept = F.filter(F.concat(words, runs), lambda w: (F.length(w) >= 2) & ~F.array_contains(_in(*STOPWORDS), w))
    return F.coalesce(kept, F.array().cast("array<string>"))


def normalize_exact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", "")


def meaningful_exact(term: Column) -> Column:
    """Long enough, or with a digit, or ASCII: fit to be searched for inside a question."""
    return (term != "") & ((F.length(term) >= 2) | F.rlike(term, F.lit("[0-9]")) | F.rlike(term, F.lit(r"^[\x00-\x7f]+$")))


def stringify(value: Column, kind: str = "string") -> Column:
    """Null becomes ""; structures become JSON."""
    nested = kind.startswith(("array", "map", "struct"))
    return F.coalesce(F.to_json(value) if nested else value.cast("string"), F.lit(""))


# -- questions and answers


def query_mode(question: Column, fact_words=FACT_WORDS, narrative_words=NARRATIVE_WORDS) -> Column:
    """fact, narrative or hybrid, by signal words; narrative without any."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    fact, narrative = any_of(q, fact_words), any_of(q, narrative_words)
    return F.when(fact & narrative, "hybrid").when(fact, "fact").otherwise("narrative")


def query_intent(question: Column, words=COMPARISON_WORDS) -> Column:
    return F.when(any_of(F.lower(F.trim(question)), words), "comparison").otherwise("generic")


def uncertain(answer: Column, phrases=UNCERTAIN_PHRASES) -> Column:
    return any_of(answer, phrases)


def abstain_ok(answer: Column, level: Column, phrases=UNCERTAIN_PHRASES) -> Column:
    return uncertain(answer, (*phrases, "暂无相关")) | F.coalesce(level == "low", F.lit(False))


def citations(answer: Column) -> Column:
    """File names in an answer, each once, sorted."""
    return F.array_sort(F.array_distinct(F.coalesce(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), F.array().cast("array<string>"))))


def reasoning_mode(mode: Column) -> Column:
    return F.when(F.lower(mode).isin("deep", "react"), F.lower(mode)).otherwise("standard")


def history_block(messages: Column, last: int = 6, limit: int = 500) -> Column:
    """The last messages, one to a line, with the role before each."""
    tail = F.slice(messages, F.greatest(F.size(messages) - (last - 1), F.lit(1)), last)
    return F.array_join(F.transform(tail, lambda m: F.concat(m["role"], F.lit(": "), F.substring(m["content"], 1, limit))), "\n")


def occurrence(text: Column, query: Column) -> Column:
    """The place of the first occurrence from 1, 0 if there is none; any case."""
    return F.coalesce(F.position(F.lower(query), F.lower(text)), F.lit(0))


def snippet(text: Column, query: Column, around: int = 80) -> Column:
    """The text around the first occurrence on one line, with marks where it was cut; null if there is none."""
    at, n = occurrence(text, query), F.length(query)
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + n - 1 + around, F.length(text))
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, end - start + 1), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at > 0, F.regexp_replace(cut, "\n", " "))


def occurrences(text: Column, query: Column) -> Column:
    """How often the query occurs, without overlaps, any case."""
    t, q = F.lower(text), F.lower(query)
    return F.when(F.length(q) == 0, F.lit(0)).otherwise(((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).cast("int"))


def audit_detail(text: Column, limit: int = 480) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def clean_description(text: Column, limit: int = 260) -> Column:
    one = F.trim(F.regexp_replace(F.regexp_replace(text, r"""^[\s"'“”‘’]+|[\s"'“”‘’]+$""", ""), r"\s+", " "))
    return F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("…"))).otherwise(one)


def has_scope(scopes: Column, scope: str) -> Column:
    return F.array_contains(F.transform(F.split(scopes, ","), lambda s: F.trim(s)), scope)


def token_usable(active: Column, expires: Column, now: Column) -> Column:
    return active & (expires.isNull() | (expires > now))


def local_date(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")
