"""License scans by patience alignment.

A text is compared with a license template in windows. Words that occur once in the window and once
in the template are anchors; the longest run of anchors that stand in the same order in both is kept,
and the gaps between them are aligned in the same way, until no word is unique in both. The share of
the template's words that are aligned is the coverage. A template stands for its license only if the
phrases that tell it from other versions and variants (notices.TOLD) are aligned too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import in_arrow, slices
from kbspark.llm.notices import MENTIONS, TEMPLATES, TOLD

COVERAGE = 0.8
_words = re.compile(r"[^\W_]+").findall


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both: patience alignment of two lists of words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b[w] == 1}
        anchors = [(place[w], j) for j, w in enumerate(b[b0:b1], b0) if w in place]
        chain = _longest_rise(anchors)
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        if chain:
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(out)


def _longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """pairs rise in the second place; the longest part that rises in the first one too."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, (x, _) in enumerate(pairs):
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
        last[k : k + 1] = [i]
        before.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def windows(n: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a text of n words to compare with a template of `size` words.

    Those of twice the size overlap by one size: each stretch of the template's size is whole in one of
    them. Those of the size itself part notices that stand next to each other, where a longer stretch
    would hold each word twice.
    """
    long = [(i, min(n, i + 2 * size)) for i in range(0, max(1, n - size), size)]
    short = [(i, min(n, i + size)) for i in range(0, max(1, n - size + 1), max(1, size // 8))]
    return long + short if n else []


def _places(words: list[str], phrase: tuple[str, ...]) -> list[int]:
    return [i for i, w in enumerate(words) if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]


#: Words by which a phrase that could not be aligned may be off from its aligned neighbour.
_DRIFT = 3


def told_apart(pairs: list[tuple[int, int]], words: list[str], template: list[str], phrases: tuple[str, ...]) -> bool:
    """Whether every phrase stands in the text where the template has it, and none with a ! between the first and last aligned words or just after.

    A phrase may hold words that occur twice, which are never anchors: it counts if it fits between the
    aligned pairs, next to the nearest of them, and no word of it is aligned with anything else.
    """
    for phrase in phrases:
        wanted = _phrase_words(phrase)
        n = len(wanted)
        if phrase.startswith("!"):
            if _places(words[pairs[0][0] : pairs[-1][0] + 1 + n], wanted):
                return False
            continue
        found = _places(words, wanted)
        for j in _places(template, wanted) if found else ():
            lo, hi = bisect_left(pairs, j, key=lambda p: p[1]), bisect_left(pairs, j + n, key=lambda p: p[1])
            near = [p for p in pairs[max(0, lo - 1) : hi + 1]]
            if any(
                all((x < i) if y < j else (x >= i + n) if y >= j + n else (x - i == y - j) for x, y in near)
                and (lo < hi or any(abs((x - i) - (y - j)) <= _DRIFT for x, y in near))
                for i in found
            ):
                break
        else:
            return False
    return True


def best_match(words: list[str], template: list[str], hits: list[int] | None = None, least: float = 0.0, phrases: tuple[str, ...] = ()) -> tuple[int, int, int]:
    """(aligned words, first, last place) in the best window that phrases allow, the first of equal ones; (0, -1, -1) if none.

    hits: places of the template's words in the text, rising. With it, windows that hold too few of
    them to reach `least` of the template are passed over.
    """
    best = (0, -1, -1)
    for a, b in windows(len(words), len(template)):
        if hits is not None and bisect_left(hits, b) - bisect_left(hits, a) < least * len(template):
            continue
        pairs = align(words[a:b], template)
        # what bars a template may follow the window
        if len(pairs) > best[0] and len(pairs) >= least * len(template) and told_apart(pairs, words[a : b + 12], template, phrases):
            best = (len(pairs), a + pairs[0][0], a + pairs[-1][0])
    return best


def by_key(templates: dict[str, list[str]], told: dict[str, tuple[str, ...]]) -> dict[str | None, list[tuple[str, set[str], set[str]]]]:
    """(name, words that its phrases need, distinct words) of the templates, by the longest of the words needed."""
    out: dict[str | None, list[tuple[str, set[str], set[str]]]] = {}
    for name, template in sorted(templates.items()):
        needed = {w for p in told.get(name, ()) if not p.startswith("!") for w in _phrase_words(p)}
        out.setdefault(max(needed, key=lambda w: (len(w), w), default=None), []).append((name, needed, set(template)))
    return out


def scan_text(text: str, templates: dict[str, list[str]], coverage: float = COVERAGE, told: dict[str, tuple[str, ...]] = TOLD, keyed: dict | None = None) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first, last word) of each license of which the text covers a template: by the largest coverage, then the longest template, then the first by name. keyed: by_key(templates, told)."""
    words = words_of(text)
    present, found = set(words), {}
    keyed = by_key(templates, told) if keyed is None else keyed
    for name, needed, distinct in [x for k in keyed if k is None or k in present for x in keyed[k]]:
        template = templates[name]
        # a word that is missing costs at least one of the template's words
        if not needed <= present or len(template) - len(distinct - present) < coverage * len(template):
            continue
        n, first, last = best_match(words, template, [i for i, w in enumerate(words) if w in distinct], coverage, told.get(name, ()))
        if n and n >= coverage * len(template):
            license = name.partition(":")[0] if name in told else name
            found.setdefault(license, []).append((-n / len(template), -len(template), name, first, last))
    best = {k: min(v) for k, v in found.items()}
    for k, inside in MENTIONS.items() if told else ():
        whole = next((v for v in found.get(k, ()) if v[2] == f"{k}:text"), None)
        for x in inside & best.keys() if whole else ():
            if whole[3] <= best[x][3] and best[x][4] <= whole[4]:
                del best[x]
    return [(k, -v[0], v[3], v[4]) for k, v in sorted(best.items())]


@cache
def _phrase_words(phrase: str) -> tuple[str, ...]:
    return tuple(words_of(phrase))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, license, coverage, n_licenses, licenses.

    licenses holds (license, coverage, first_word, last_word) of every license of which the text covers
    a template to the given share and holds the phrases that tell it apart, by name; license is the one
    with the largest coverage, of equal ones that with the longest stretch, then the first by name.
    templates: others than the whole texts and notices in notices.TEMPLATES, each a license by itself. A null or empty text, or one that covers
    none, has a null license, coverage 0 and an empty list. Ids may be null or repeated; other columns
    play no part. An empty table gives an empty one. Works on each partition alone.
    """
    wanted = {k: words_of(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    told = TOLD if templates is None else {}
    item = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("first_word", T.IntegerType()), T.StructField("last_word", T.IntegerType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_licenses", T.IntegerType()), T.StructField("licenses", T.ArrayType(item))])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

    def run(batches):
        keyed = by_key(wanted, told)
        for batch in slices(batches, 1):
            found = [scan_text(t or "", wanted, coverage, told, keyed) for t in batch.column(1).to_pylist()]
            best = [min(f, key=lambda x: (-x[1], x[2] - x[3], x[0])) if f else (None, 0.0) for f in found]
            rows = [[dict(zip(("license", "coverage", "first_word", "last_word"), x)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64()), pa.array([len(f) for f in found], pa.int32()), pa.array(rows, arrow)],
                names=schema.names,
            )

    return in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)
