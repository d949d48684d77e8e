"""BPE encoding and decoding by tree concatenation.

A text longer than a leaf is cut into halves, again and again, wherever the middle falls. The leaves
are encoded on their own, all those of a batch of texts together. On the way up, the text around each
join is encoded anew by the library, in a window that grows until its outermost words have exactly the
tokens that stand on both sides; the window's tokens then replace those that the cut had spoiled. A run
without blanks that is longer than `run_chars` is itself encoded as a tree, with windows that agree
token by token.

A blank is never part of a token (which is checked), so a leaf is encoded word by word, and a part of a
text is a list of words whose ids are known: words that come again have those of the last batches, new
ones are handed to the library many at a time.

Why agreement suffices: a sequence of tokens is the BPE encoding of a run if every two neighbours are
the encoding of their own characters. A token that both sides hold at the same place brings the
neighbours on its left from one encoding and those on its right from the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import in_arrow, slices

#: Code points of a leaf of a text, and of a leaf of a run without blanks.
LEAF_CHARS, RUN_CHARS = 2048, 256
#: Words whose encodings a Python worker keeps from one slice of texts to the next, at most, and words that are handed to the library as one text.
KEPT_WORDS, LIBRARY_WORDS = 150_000, 100
_encoders: dict[str, TreeEncoder] = {}


class TreeEncoder:
    """Encodes and decodes with the tokenizer in a file of the tokenizers library."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, run_chars: int = RUN_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf_chars, self.run_chars = max(2, leaf_chars), max(2, run_chars)
        # this kind of tokenizer has no decoder: decode() joins the tokens by one space
        self.token = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.decimal = [str(i) for i in range(len(self.token))]
        #: joins of texts made so far, and those of them that no side had right
        self.joins = self.mended = 0
        # of each word: its ids in decimal, joined by one space, and its decoded text
        self.ids_of: dict[str, str] = {}
        self.decoded_of: dict[str, str] = {}

    # -- a text: a sequence of words between blanks

    @staticmethod
    def _words(text: str) -> list[str]:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    @staticmethod
    def _leaves(a: int, b: int, most: int) -> list[tuple[int, int]]:
        spans = [(a, b)]
        while spans[0][1] - spans[0][0] > most or spans[-1][1] - spans[-1][0] > most:
            spans = [s for x, y in spans for s in ((x, (x + y) // 2), ((x + y) // 2, y)) if s[0] < s[1]]
        return spans

    def _library(self, lists: list[list[str]]) -> list[list[list[int]]]:
        """Of each list of words, joined by blanks and encoded as one text, the ids of each word."""
        out = []
        for words, e in zip(lists, self.tokenizer.encode_batch([" ".join(w) for w in lists], add_special_tokens=False)):
            found, j, end = [[] for _ in words], 0, len(words[0])
            for i, (at, _) in zip(e.ids, e.offsets):
                while at > end:
                    j += 1
                    end += 1 + len(words[j])
                found[j].append(i)
            out.append(found)
        return out

    def _windows(self, lists: list[list[str]]) -> list[list[str]]:
        """The ids of the words of windows, encoded anew by the library. Runs that are too long for it are trees of their own."""
        short = [i for i, words in enumerate(lists) if max(map(len, words)) <= self.run_chars]
        out: list[list[str]] = [[] for _ in lists]
        for i, found in zip(short, self._library([lists[i] for i in short])):
            out[i] = [" ".join([self.decimal[x] for x in ids]) for ids in found]
            for word, ids, shown in zip(lists[i], found, out[i]):
                if self.ids_of.get(word, shown) != shown:
                    raise ValueError("this tokenizer doesn't encode words by themselves")
                self._keep(word, ids)
        for i, words in enumerate(lists):
            if not out[i]:
                self.encode_words(set(words))
                out[i] = [self.ids_of[w] for w in words]
        return out

    def _join(self, pairs: list[tuple[list[str], list[str]]]) -> list[list[str]]:
        """Joins neighbouring parts of texts, lists of words whose ids are known.

        Of each pair the words around the join are encoded anew, more and more of them until the
        outermost ones have on both sides exactly the tokens that they had.
        """
        out: list[list[str]] = [[] for _ in pairs]
        todo, n = list(range(len(pairs))), 2
        while todo:
            windows = [self._words(" ".join(pairs[i][0][-n:]) + " ".join(pairs[i][1][:n])) for i in todo]
            open_ = []
            for i, w, ids in zip(todo, windows, self._windows(windows)):
                a, b = pairs[i]
                k, m = min(n, len(a)), min(n, len(b))
                # a window that reaches the other end of a side needs no agreement there
                left = k == len(a) or w[0] == a[-k] and ids[0] == self.ids_of[a[-k]]
                right = m == len(b) or w[-1] == b[m - 1] and ids[-1] == self.ids_of[b[m - 1]]
                if left and right:
                    self.joins += 1
                    self.mended += [x for x in ids if x] != [x for x in map(self.ids_of.get, a[-k:] + b[:m]) if x]
                    out[i] = a[: len(a) - k] + w + b[m:]
                else:
                    open_.append(i)
            todo, n = open_, 2 * n
        return out

    # -- a run without blanks: a sequence of tokens

    def _tokens(self, run: str, spans: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
        found = self.tokenizer.encode_batch([run[a:b] for a, b in spans], add_special_tokens=False)
        return [[(i, a + x, a + y) for i, (x, y) in zip(e.ids, e.offsets)] for e, (a, _) in zip(found, spans)]

    def run_ids(self, run: str) -> list[int]:
        """The ids of a run, from the encodings of its halves."""
        spans = self._leaves(0, len(run), self.run_chars)
        parts = self._tokens(run, spans)
        while len(parts) > 1:
            joined, ends = [], []
            for i in range(0, len(parts) - 1, 2):
                joined.append(self._join_tokens(run, spans[i], spans[i + 1], parts[i], parts[i + 1]))
                ends.append((spans[i][0], spans[i + 1][1]))
            if len(parts) % 2:
                joined.append(parts[-1])
                ends.append(spans[-1])
            parts, spans = joined, ends
        return [t[0] for t in parts[0]]

    def _join_tokens(self, run, first, second, left, right):
        lo, at, hi, w = first[0], first[1], second[1], 64
        while True:
            a, b = max(lo, at - w), min(hi, at + w)
            window = self._tokens(run, [(a, b)])[0]
            known_left = {t: i for i, t in enumerate(left[-4 * w :], max(0, len(left) - 4 * w)) if t[1] > a}
            known_right = {t: i for i, t in enumerate(right[: 4 * w]) if t[2] < b}
            both = [(known_left[t], i) for i, t in enumerate(window) if t in known_left and t[2] <= at]
            last = [(known_right[t], i) for i, t in enumerate(window) if t in known_right and t[1] >= at]
            if (a == lo or len(both) >= 4) and (b == hi or len(last) >= 4):
                i, x = (0, 0) if a == lo else both[len(both) // 2]
                j, y = (len(right), len(window)) if b == hi else last[len(last) // 2]
                return left[:i] + window[x:y] + right[j:]
            w *= 2

    # -- both

    def encode_words(self, words: set[str]) -> None:
        """Encodes and decodes the words that aren't known yet: all short ones in one batch."""
        new = [w for w in words if w not in self.ids_of]
        short = [w for w in new if len(w) <= self.run_chars]
        lists = [short[i : i + LIBRARY_WORDS] for i in range(0, len(short), LIBRARY_WORDS)]
        for words_, found in zip(lists, self._library(lists)):
            for w, ids in zip(words_, found):
                self._keep(w, ids)
        for w in new:
            if len(w) > self.run_chars:
                self._keep(w, self.run_ids(w))

    def _keep(self, word: str, ids: list[int]) -> None:
        self.ids_of[word] = " ".join([self.decimal[i] for i in ids])
        self.decoded_of[word] = " ".join([self.token[i] for i in ids])

    def texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text the ids in decimal joined by one space, and the decoded text."""
        if len(self.ids_of) > KEPT_WORDS:  # here alone: the words of texts at work stay known until these are done
            self.ids_of.clear()
            self.decoded_of.clear()
        parts = [[self._words(t[a:b]) for a, b in self._leaves(0, len(t), self.leaf_chars)] for t in texts]
        self.encode_words(set().union(*(w for text in parts for w in text)))
        while any(len(p) > 1 for p in parts):  # one level of all trees at a time
            joined = iter(self._join([(p[i], p[i + 1]) for p in parts for i in range(0, len(p) - 1, 2)]))
            parts = [[next(joined) for _ in range(0, len(p) - 1, 2)] + p[len(p) - len(p) % 2 :] for p in parts]
        one, two = self.ids_of.__getitem__, self.decoded_of.__getitem__
        return [(" ".join(filter(None, map(one, p[0]))), " ".join(filter(None, map(two, p[0])))) for p in parts]


def _encoder(path: str) -> TreeEncoder:
    if path not in _encoders:
        _encoders[path] = TreeEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns one row for each row of docs: the id, the columns in `keep`, n_tokens, ids_sha256 (of the
    decimal ids joined by one space), decoded_sha256, and if asked for `ids` and `decoded`. A null
    text counts as empty: no tokens. Ids may be null or repeated; other columns of docs play no part. A
    kept column that has a result's name comes out with an underscore in front.
    An empty table gives an empty one. Works on each partition alone, without a shuffle; one text is
    held at a time, and 1 MB of texts at most unless one is longer.

    The tokenizer must drop blanks and have no decoder (its decode() joins tokens by a space), which
    is checked: others aren't encoded blank by blank.
    """
    kept = [id_col, *[c for c in keep if c != id_col]]
    results = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    results += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded
    clash = {f.name for f in results}
    schema = T.StructType([*[T.StructField(f"_{c}" if c.lower() in clash else c, docs.schema[c].dataType) for c in kept], *results])

    def run(batches):
        encoder = _encoder(tokenizer_path)
        if encoder.tokenizer.decoder is not None or encoder.tokenizer.encode("a a", add_special_tokens=False).ids != 2 * encoder.tokenizer.encode("a", add_special_tokens=False).ids:
            raise ValueError("this tokenizer keeps blanks or has a decoder")
        for batch in slices(batches, len(kept)):
            rows = encoder.texts([t or "" for t in batch.column(len(kept)).to_pylist()])
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array([r[0].count(" ") + (r[0] != "") for r in rows], pa.int64())]
            columns += [pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string()) for k in (0, 1)]
            if ids:
                columns.append(pa.array([np.fromstring(r[0], np.int32, sep=" ") for r in rows], pa.list_(pa.int32())))
            if decoded:
                columns.append(pa.array([r[1] for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_arrow(docs.select(*[F.col(c) for c in kept], F.col(text_col).alias("__text")), run, schema)
