"""Language identification by a linear-chain conditional random field over words.

Each word has affix, n-gram and lexicon features; their learned weights and the learned transitions
between the languages of neighbouring words give, by forward-backward, every word's probability of
each language. A chain is a line of text. A document's shares are the means over its words.

The field is fitted on a bounded sample of labelled rows, SAMPLE_ROWS of each language at most, and on
their whole texts, cut into short runs of words. Runs of different documents are strung together, so
that changes of language are learned too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import in_arrow, slices
from kbspark.llm.hashing import mix

#: Labelled rows of each language that are learned from, at most.
SAMPLE_ROWS = 80
#: Bytes of texts that are told at once, unless one is longer.
SLICE_BYTES = 1 << 19
#: Words of a run.
SEGMENT_WORDS = 12
BUCKETS = 1 << 16
CHAIN, EPOCHS, RATE = 60, 10, 0.3

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


@dataclass
class Words:
    """The distinct words of some texts, and where they stand."""

    points: np.ndarray  # code points of the distinct words, one after the other
    starts: np.ndarray  # of the distinct words in points
    lengths: np.ndarray
    hashes: np.ndarray
    which: np.ndarray  # of each word of the texts, the distinct word
    text: np.ndarray  # of each word, its text
    line: np.ndarray  # of each word, its line (numbered over all texts)


def find_words(texts: list[str]) -> Words:
    """Words are runs of letters, in lower case. A word's hash depends on its letters alone, and words are told apart by their letters."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _is_letter()[points]
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    # a hash of each word: the sum of a number for each letter at its place in the word
    letters = points[inside]
    begin = np.cumsum(lengths) - lengths  # of each word in letters
    place = np.arange(len(letters), dtype=np.uint64)
    place -= np.repeat(begin.astype(np.uint64), lengths)
    place <<= np.uint64(21)
    place |= letters
    sums = np.r_[np.uint64(0), np.cumsum(mix(place, 61))]
    hashes = mix(sums[begin + lengths] - sums[begin], 62)
    del place, sums
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    known = first[which]
    moved = np.repeat(begin[known] - begin, lengths)  # to the letter of the word that comes first
    moved += np.arange(len(letters))
    if not (np.array_equal(lengths[known], lengths) and np.array_equal(letters[moved], letters)):
        # two words with one hash: they stay apart
        ids: dict[bytes, int] = {}
        which = np.array([ids.setdefault(points[s : s + k].tobytes(), len(ids)) for s, k in zip(starts, lengths)])
        _, first = np.unique(which, return_index=True)
    n = lengths[first]
    at = np.repeat(starts[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    ends = np.cumsum([len(t) + 1 for t in lowered])
    lines = np.cumsum(points == 10)
    return Words(points[at], (np.cumsum(n) - n).astype(np.int64), n, hashes[first], which, np.searchsorted(ends, starts, "right"), lines[starts] if len(starts) else starts)


def features(words: Words, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words: word, feature, value. Features from BUCKETS on are entries of the lexicon, the last one for words outside."""
    out = []
    ids = np.arange(len(words.starts))
    owner = np.repeat(ids, words.lengths)
    left = np.repeat(words.starts + words.lengths, words.lengths) - np.arange(len(words.points))  # letters to the word's end
    for n in (1, 2, 3):  # the mean over a word's n-grams
        fits = np.flatnonzero(left >= n)
        key = np.full(len(fits), n, np.uint64)
        for j in range(n):
            key = mix(key + words.points[fits + j], 64)
        count = np.maximum(words.lengths - n + 1, 1)
        out.append((owner[fits], key % np.uint64(BUCKETS), 1.0 / count[owner[fits]]))
    for side, lengths in ((1, (2, 3)), (2, (1, 2, 3, 4))):
        for n in lengths:
            has = ids[words.lengths >= n]
            begin = words.starts[has] + (0 if side == 1 else words.lengths[has] - n)
            key = np.full(len(has), 16 * side + n, np.uint64)
            for j in range(n):
                key = mix(key + words.points[begin + j], 65)
            out.append((has, key % np.uint64(BUCKETS), np.ones(len(has))))
    at = np.minimum(np.searchsorted(lexicon, words.hashes), max(0, len(lexicon) - 1))
    known = lexicon[at] == words.hashes if len(lexicon) else np.zeros(len(ids), bool)
    out.append((ids, BUCKETS + np.where(known, at, len(lexicon)), np.ones(len(ids))))
    w, f, v = (np.concatenate([x[i] for x in out]) for i in range(3))
    order = np.argsort(w, kind="stable")
    return w[order], f[order].astype(np.int64), v[order].astype(np.float32)


def _times(rows: np.ndarray, step: np.ndarray) -> np.ndarray:
    """rows @ step, each row worked out alike however many rows there are."""
    out = rows[:, :1] * step[0]
    for k in range(1, len(step)):
        out += rows[:, k : k + 1] * step[k]
    return out


@dataclass
class Field:
    """The fitted model."""

    langs: list[str]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # (from, to), logarithms
    lexicon: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        w, f, v = features(words, self.lexicon)
        if not len(w):
            return np.zeros((0, len(self.langs)), np.float32)
        return np.add.reduceat(self.weights[f] * v[:, None], np.searchsorted(w, np.arange(len(words.starts))), axis=0)

    def marginals(self, words: Words) -> np.ndarray:
        """Of each word of the texts, the probability of each language."""
        scores = self.emissions(words)
        scores = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        step = np.exp(self.transitions - self.transitions.max())
        n = len(words.which)
        first = np.flatnonzero(np.r_[True, np.diff(words.line) != 0][:n])
        length = np.diff(np.r_[first, n])
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        alive = np.searchsorted(-length, -np.arange(length[0] if n else 0), "left")  # chains longer than t
        forward = np.empty((n, len(self.langs)), np.float32)
        for t, k in enumerate(alive):
            at = first[:k] + t
            now = scores[words.which[at]]
            if t:
                now = now * _times(forward[at - 1], step)
            forward[at] = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
        message = np.ones((len(first), len(self.langs)), np.float32)
        out = np.empty_like(forward)
        for t in range(len(alive) - 1, -1, -1):
            k = alive[t]
            at = first[:k] + t
            both = forward[at] * message[:k]
            out[at] = both / np.maximum(both.sum(axis=1, keepdims=True), 1e-30)
            back = _times(scores[words.which[at]] * message[:k], step.T)
            message[:k] = back / np.maximum(back.sum(axis=1, keepdims=True), 1e-30)
        return out


def fit(segments: list[tuple[str, str, int]], seed: int = 5) -> Field | None:
    """Maximum likelihood by AdaGrad. segments: (text of a few words, language, document)."""
    langs = sorted({lang for _, lang, _ in segments})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    # neighbours in the string: mostly runs of one document, then a change
    by_doc: dict[int, list[int]] = {}
    for i, s in enumerate(segments):
        by_doc.setdefault(s[2], []).append(i)
    groups = [g[i : i + 3] for g in by_doc.values() for i in range(0, len(g), 3)]
    order = [i for g in rng.permutation(len(groups)) for i in groups[g]]
    words = find_words([segments[i][0] for i in order])
    label = np.array([langs.index(segments[i][1]) for i in order])[words.text]
    seen = np.bincount(words.which, minlength=len(words.starts))
    lexicon = np.sort(words.hashes[seen > 1])
    count, size = len(words.which), len(langs)
    if not count:
        return None
    # chains of CHAIN words, the last of which may begin within the one before, so that every word is learned from
    length = min(CHAIN, count)
    chains = np.append(np.arange(0, count - length, length), count - length)[:, None] + np.arange(length)
    n = len(chains)
    field = Field(langs, np.zeros((BUCKETS + len(lexicon) + 1, size), np.float32), np.zeros((size, size), np.float32), lexicon)
    which, label = words.which[chains], label[chains]
    w, f, v = features(words, lexicon)
    begin = np.r_[np.searchsorted(w, np.arange(len(words.starts))), len(w)]
    g2w, g2t = np.full_like(field.weights, 1e-3), np.full_like(field.transitions, 1e-3)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(n), max(1, n // 64)):
            used, local = np.unique(which[part], return_inverse=True)
            count = begin[used + 1] - begin[used]
            rows = np.repeat(begin[used] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            fs, vs = f[rows], v[rows][:, None] * np.where((f[rows] >= BUCKETS) & (rng.random(len(rows)) < 0.4), 0, 1)[:, None]
            edge = np.r_[0, np.cumsum(count)[:-1]]
            scores = np.add.reduceat(field.weights[fs] * vs, edge, axis=0)
            e = np.exp(scores - scores.max(axis=1, keepdims=True))[local.reshape(len(part), length)]
            step = np.exp(field.transitions)
            a, b = np.empty_like(e), np.ones_like(e)
            a[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                x = e[:, t] * (a[:, t - 1] @ step)
                a[:, t] = x / x.sum(axis=1, keepdims=True)
            for t in range(length - 2, -1, -1):
                x = (e[:, t + 1] * b[:, t + 1]) @ step.T
                b[:, t] = x / x.sum(axis=1, keepdims=True)
            p = a * b
            p /= p.sum(axis=2, keepdims=True)
            pair = a[:, :-1, :, None] * step * (e * b)[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            y = np.eye(size, dtype=np.float32)[label[part]]
            seen_pairs = np.zeros((size, size), np.float32)
            np.add.at(seen_pairs, (label[part][:, :-1].ravel(), label[part][:, 1:].ravel()), 1)
            gt = (seen_pairs - pair.sum(axis=(0, 1))) / len(part) - 1e-3 * field.transitions
            gw = np.zeros((len(used), size), np.float32)
            np.add.at(gw, local.ravel(), (y - p).reshape(-1, size))
            touched, inverse = np.unique(fs, return_inverse=True)
            grad = np.zeros((len(touched), size), np.float32)
            np.add.at(grad, inverse, np.repeat(gw, count, axis=0) * vs)
            grad = grad / len(part) - 1e-4 * field.weights[touched]
            g2w[touched] += grad**2
            g2t += gt**2
            field.weights[touched] += RATE * grad / np.sqrt(g2w[touched])
            field.transitions += RATE * gt / np.sqrt(g2t)
    return field


def sample_segments(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str, int]]:
    """Runs of words of at most SAMPLE_ROWS rows of each language, labelled, with an id and not held out."""
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(17), id_col).alias("h"), (F.col(id_col).isNotNull() & ~held_out(id_col)).alias("use"))
    labelled = labelled.filter("use and lang is not null and text is not null").drop("use")
    # a broadcast of a name and a number for each language; the field has a column of weights for each
    # about three times as many rows as are wanted of each language, then the first of them; small languages stay whole
    counts = labelled.groupBy("lang").agg(F.least(F.lit(1 << 30), F.lit((1 << 30) * 3.0 * SAMPLE_ROWS) / F.count("*")).alias("__bound"))
    near = labelled.join(F.broadcast(counts), "lang").filter(F.pmod("h", F.lit(1 << 30)) <= F.col("__bound"))
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("r") <= SAMPLE_ROWS)

    def cut(batches):
        for batch in slices(batches, 0):
            out = []
            for text, lang, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = find_words([text])
                n = len(words.which)
                distinct = ["".join(map(chr, words.points[a : a + k])) for a, k in zip(words.starts, words.lengths)]
                out += [(" ".join(distinct[w] for w in words.which[i : i + SEGMENT_WORDS]), lang, h) for i in range(0, n, SEGMENT_WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], names=["run", "lang", "h"])

    return sorted(tuple(r) for r in in_arrow(ranked.select("text", "lang", "h"), cut, "run string, lang string, h bigint").collect())


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: the id, the columns in `keep`, held_out, lang_pred, score, shares.

    shares maps each language to the mean probability over the words; lang_pred is the language with
    the largest share (of equal ones the first by name), score that share. A text that is null or has
    no letter, and any text if nothing could be learned, gets `und` and 0. Without a field, one is
    fitted on docs' own labelled rows whose crc32(id) mod 3 isn't 1; predictions see the text alone.
    Ids may be null (never learned from) or repeated; other columns play no part. Whole texts are told,
    SLICE_BYTES of them at a time unless one is longer. A kept column that has a result's name comes out with
    an underscore in front. An empty table gives an empty one.
    """
    if field is None:
        field = fit(sample_segments(docs, id_col, text_col, lang_col))
    kept = [id_col, *[c for c in keep if c != id_col]]
    place = kept.index(text_col) if text_col in kept else len(kept) + 1
    results = [T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))]
    clash = {f.name for f in results}
    schema = T.StructType([*[T.StructField(f"_{c}" if c.lower() in clash else c, docs.schema[c].dataType) for c in kept], *results])

    def run(batches):
        for batch in slices(batches, place, SLICE_BYTES):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            lang, score, shares = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if field is not None:
                words = find_words(texts)
                count = np.bincount(words.text, minlength=len(texts))
                sums = np.zeros((len(texts), len(field.langs)))
                has = np.flatnonzero(count)
                if len(has):
                    ends = np.cumsum(count)[has]
                    sums[has] = np.add.reduceat(field.marginals(words).astype(np.float64), ends - count[has], axis=0)
                for i in has:
                    share = sums[i] / sums[i].sum()
                    best = int(share.argmax())
                    lang[i], score[i] = field.langs[best], min(1.0, float(share[best]))
                    shares[i] = list(zip(field.langs, share.tolist()))
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept) + 1)] + columns, names=schema.names)

    text = [F.col(text_col).alias("__text")] if place > len(kept) else []
    return in_arrow(docs.select(*kept, held_out(id_col).alias("__held_out"), *text), run, schema)
