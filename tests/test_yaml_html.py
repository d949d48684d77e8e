"""Headers in YAML and the main text of web pages."""

import random

import pytest

from kbspark.functions import yaml as Y
from kbspark.plans.catalog import QUERIES
from kbspark.sources import files
from kbspark.sources.html import html_markdown

GOLDEN = {
    "title: A\ntype: concept\n": {"title": "A", "type": "concept"},
    "author:\n  name: Ann\n  mail:\n    work: a@x\n    home: 'b''s'\ntags: [a, \"b, c\", {k: v}]\n": {"author": {"name": "Ann", "mail": {"work": "a@x", "home": "b's"}}, "tags": ["a", "b, c", {"k": "v"}]},
    "tags:\n- a\n- b: 1\n  c: 2\n- - x\n  - y\n-\nn: ~\n": {"tags": ["a", {"b": 1, "c": 2}, ["x", "y"], None], "n": None},
    "s: |\n  one\n    two\n\n  three\n\nt: >-\n  one\n  two\n\n  three\nend: 1.5\n": {"s": "one\n  two\n\nthree\n", "t": "one two\nthree", "end": 1.5},
    'q: "one\n  two\\n\\u00e9\n\n  three"\nz: yes # note\nurl: http://x.y/z#k\n': {"q": "one two\né\nthree", "z": True, "url": "http://x.y/z#k"},
    "p: one\n  two\n  three\nk: 'a # b'\n\"quoted key\": 0x\n": {"p": "one two three", "k": "a # b", "quoted key": "0x"},
    "f: [\n  a,\n  b\n  ]\ng: {x: 1, y: [2, 3], z}\n": {"f": ["a", "b"], "g": {"x": 1, "y": [2, 3], "z": None}},
    "d: 2024-01-02\ni: -12\nb: False\ne: ''\nl: []\nm: {}\nr: 1\nr: 2\n": {"d": "2024-01-02", "i": -12, "b": False, "e": "", "l": [], "m": {}, "r": 2},
    "k: |+\n  a\n\nn: 1": {"k": "a\n\n", "n": 1},
    'a: "x \\\n   y"\nb: "t\\tq\\x41"\n': {"a": "x y", "b": "t\tqA"},
    'title: "a: b" # c\ncn: 中文：不\n': {"title": "a: b", "cn": "中文：不"},
    "a: x\n\n  y\nb: 1\n": {"a": "x\ny", "b": 1},
    "a:\n": {"a": None},
}
BAD = ["a: b: c\n", "a: [1, 2\n", "\ta: 1\n", "a: 'x\n", "- a\n- b\n", "just text\n", "a: 1\n   b: 2\n", "a: %x\n", "a: `x\n", "", "# only\n", "title: 中文: 不\n", "a: &x 1\n", "a: {[x]: 1}\n", "[" * 2000]


def test_golden_headers():
    assert {t: Y.parse(t) for t in GOLDEN} == GOLDEN
    assert [Y.parse(t) for t in BAD] == [{}] * len(BAD)


def test_headers_as_another_library_writes_them():
    yaml = pytest.importorskip("yaml")
    rng = random.Random(1)
    texts = ["a", "two words", "it's", "x: y", "a # b", "- d", "", "true", "12", "1.5", "line\nbreak", "para\n\n  indented\nend\n", "  lead", "trail ", "日本: 語", "[z]", "{k}", '"q"', "long " * 12, "tab\there", "null", "~", "#c", "a:b", "%p", "@m", "\n", "a\n\n\nb", "-", "? q", "!t", "&a", "*b", "> x", "k:", "'"]

    def value(depth):
        r = rng.random()
        if depth < 3 and r < 0.25:
            return {rng.choice(["a", "b c", "Ü", "n.m", "x'y", "12"]) + str(i): value(depth + 1) for i in range(rng.randint(0, 3))}
        if depth < 3 and r < 0.45:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([None, True, False, 3, -7, 2.25]) if r < 0.5 else rng.choice(texts)

    for _ in range(1500):
        data = {f"k{i}": value(0) for i in range(rng.randint(1, 4))}
        text = yaml.safe_dump(data, allow_unicode=rng.random() < 0.7, width=rng.choice([20, 80]), default_flow_style=rng.choice([None, True, False]), default_style=rng.choice([None, None, '"', "'", "|", ">"]), indent=rng.choice([2, 4]))
        if "!!" not in text:
            assert Y.parse(text) == yaml.safe_load(text), text


def test_header_columns(spark):
    pages = ["---\na:\n  b: [x, {c: 1.5}]\n  t: true\nn:\n---\nbody", "```yaml\n---\na: 'q'\n---\n```", "no header", None, "---\na: [\n---\nx"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, content string")
    found = {r.i: dict(r.header) for r in Y.with_header(df).collect()}
    assert found == {0: {"a.b[0]": "x", "a.b[1].c": "1.5", "a.t": "true"}, 1: {"a": "q"}, 2: {}, 3: {}, 4: {}}
    assert df.select(Y.header_json("content").alias("j")).first().j == '{"a": {"b": ["x", {"c": 1.5}], "t": true}, "n": null}'


CASES = [
    ("<article>one <article>two</article> three four</article> tail", "one\ntwo\nthree four"),
    ("<p>a<p>b<ul><li>1<li>2<ol><li>x<li>y</ol></ul>", "a\n\nb\n\n- 1\n- 2\n\n  1. x\n  2. y"),
    ("<pre>a\n  b</pre>x", "```\na\n  b\n```\n\nx"),
    ("<table><tr><th>a<th>b<tr><td>1<td>2</table>", "a | b\n1 | 2"),
    ("<b>x &amp; y &copy;", "x & y ©"),
    ("a<!-- c -->b<script>if(a</b>)</script>c", "ab c"),
    ("", ""),
    (None, ""),
    ("<main>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</main>", "deep"),
    ("<p>see <a href='/x'>this <b>page</b></a> or <a href='/y'><img src=z></a> not <a>that</a>.</p><p hidden>no</p>", "see [this page](/x) or not that."),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages_as_markdown(page, text):
    assert html_markdown(page) == text


def test_the_main_part_is_where_the_text_is():
    menu = "<div class=m>" + "".join(f"<a href=/{i}>entry {i}</a> " for i in range(30)) + "</div>"
    text = [f"Sentence number {i} of a text that goes on and links <a href=/s>somewhere</a> once." for i in range(12)]
    body = "".join(f"<p>{t}</p>" for t in text)
    page = f"<html><body>{menu}<div id=w><div class=side><p>Teaser with some words.</p>{menu}</div><div id=c>{body}{menu}</div></div><div><p>Imprint and other notes.</p></div></body></html>"
    found = html_markdown(page)
    assert found.count("Sentence number") == 12 and "entry" not in found and "Imprint" not in found and "Teaser" not in found
    assert "[somewhere](/s)" in found


def test_planted_articles_are_found(spark):
    rows = QUERIES["page_text"](spark, "/root/testdata/sf0.001").collect()
    planted, found, right = (sum(r[i] for r in rows) for i in (1, 2, 3))
    assert len(rows) == 50 and right >= 0.98 * planted and right >= 0.98 * found


def test_page_text_keeps_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x"), (2, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in files.web_text(df, "page_id", "url").orderBy("page_id").collect()] == [(1, "u", "x"), (2, None, "")]
