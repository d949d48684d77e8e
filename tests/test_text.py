"""Golden cases of the column functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as X


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values):
        df = spark.createDataFrame([values], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'array<struct<role:string,content:string>>' if isinstance(v, list) else 'double'}" for i, v in enumerate(values)))
        return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x

    return run


CASES = [
    (X.strip_frontmatter, "---\na: 1\n---\n\nbody", "body"),
    (X.strip_frontmatter, "﻿---\na: 1\n---\nbody", "body"),
    (X.strip_frontmatter, "--- no\nbody", "--- no\nbody"),
    (X.frontmatter, "---\ntitle: A: b\ntype: \"x\"\n---\nbody", {"title": "A: b", "type": "x"}),
    (X.frontmatter, "```md\n---\ntitle: A\n---\nbody\n```", {"title": "A"}),
    (X.frontmatter, "---\n- [bad\n---\nbody", {}),
    (X.frontmatter_body, "---\na: 1\n---\nbody", "\nbody"),
    (X.unwrap_fence, "```json\n{}\n```", "{}"),
    (X.unwrap_fence, " plain ", "plain"),
    (X.links, "[a](x.md) [b](y.txt) [c](z.md)", ["x", "z"]),
    (X.normalize_bullets, "Such as: * one * two", "Such as:\n\n* one\n* two"),
    (X.normalize_bullets, "```\nx: * one * two\n```", "```\nx: * one * two\n```"),
    (X.slugify, "  Hello, Wörld! -- x_y ", "hello-wörld-x_y"),
    (X.safe_basename, "..\\up/na:me?.md. ", "na_me_.md"),
    (X.safe_basename, "a/..", ""),
    (X.norm_page, "x/y", "y.md"),
    (X.norm_page, " ", ""),
    (X.file_ext, "A.b.PDF", "pdf"),
    (X.title_from_name, "my-first_page.md", "My First Page"),
    (X.tokens, "Ab-cd é 知识 x 库", ["ab", "cd", "x", "知识", "识库"]),
    (X.tokens, None, []),
    (X.char_bigrams, "知", ["知"]),
    (X.router_tokens, "Show the 知识库 of A bc", ["show", "bc", "知识库"]),
    (X.normalize_exact, " A b\tC ", "abc"),
    (X.meaningful_exact, "知", False),
    (X.meaningful_exact, "a", True),
    (X.query_mode, "收入多少？", "fact"),
    (X.query_mode, "请总结", "narrative"),
    (X.query_mode, "总结收入", "hybrid"),
    (X.query_mode, None, "narrative"),
    (X.query_intent, "A vs B", "comparison"),
    (X.query_intent, "A", "generic"),
    (X.citations, "b.md, a.pdf and b.md, 说明.docx", ["a.pdf", "b.md", "说明.docx"]),
    (X.reasoning_mode, "weird", "standard"),
    (X.clean_description, '  "A  b" ', "A b"),
]


@pytest.mark.parametrize("f, value, expected", CASES)
def test_cases(apply, f, value, expected):
    assert apply(f, value) == expected


def test_point_ids(apply):
    n = int(hashlib.md5(b"page:1").hexdigest()[:16], 16)
    assert int(apply(X.point_id, "page:1")) == n
    assert apply(X.point_id63, "page:1") == n & (2**63 - 1)


def test_search(apply):
    text = "x" * 100 + " Needle\nand needle " + "y" * 100
    assert apply(X.occurrences, text, "NEEDLE") == 2
    cut = apply(lambda t, q: X.snippet(t, q, 5), text, "needle")
    assert cut == "...xxxx Needle and ..."
    assert apply(X.snippet, text, "absent") is None


def test_history(apply):
    messages = [{"role": "user", "content": f"m{i}" + "z" * 600} for i in range(8)]
    lines = apply(X.history_block, messages).split("\n")
    assert len(lines) == 6 and lines[0].startswith("user: m2") and len(lines[0]) == 506


def test_signals(apply):
    assert apply(lambda a, c: X.abstain_ok(a, c), "当前知识库中缺少直接证据。", "high")
    assert apply(lambda a, c: X.abstain_ok(a, c), "sure", "low")
    assert not apply(lambda a, c: X.abstain_ok(a, c), "sure", "high")
