"""Quality classifier by compression.

One zstandard dictionary is built from texts labelled good, one from texts labelled bad. A text is
compressed with each of them, and the normalised difference of the sizes says which kind it resembles.
Since texts that repeat themselves compress alike with any dictionary, the sizes themselves, over the
text's length, are read too; a logistic model over pieces of these numbers, fitted on other labelled
texts than the dictionaries, turns them into a calibrated score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import in_arrow, slices

#: Labelled rows of each class that are learned from, and bytes of their texts, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 12 << 20
DICTIONARY_BYTES, LEVEL = 32 << 10, 1
#: Bytes of the pieces that a dictionary is built from: many short ones, so that no text outweighs others.
PIECE_BYTES = 4096
#: Scores from here on count as good.
GOOD_FROM = 0.3
#: Shares of the calibrating texts between which each number has a slope of its own; strength of the prior on slopes.
KNOTS, PRIOR = (0.01, 0.03, 0.06, 0.14, 0.22, 0.3, 0.38, 0.46, 0.54, 0.62, 0.7, 0.78, 0.86, 0.94, 0.97, 0.99), 0.1


@dataclass
class Sizes:
    """Compressed sizes of texts with dictionaries of good and bad texts, and without one."""

    good: bytes
    bad: bytes

    def compressors(self) -> list:
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        out = []
        for content in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=held, **plain))
        return [*out, zstandard.ZstdCompressor(**plain)]

    @staticmethod
    def numbers(compressors: list, texts: list[bytes]) -> np.ndarray:
        """Of each text: normalised difference (bad less good), size without and with the better dictionary by length, length."""
        sizes = np.array([[*(len(c.compress(t)) for c in compressors), len(t)] for t in texts], np.float64).reshape(len(texts), 4)
        good, bad, plain, length = sizes.T
        most = np.maximum(np.maximum(good, bad), 1)
        return np.stack([(bad - good) / most, np.log((plain + 8) / (length + 24)), np.log((np.minimum(good, bad) + 4) / (length + 16)), np.log(length + 1)], axis=1)


def _dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts, of DICTIONARY_BYTES at most; of too few texts for the library to choose from, the texts' own last bytes."""
    pieces = [t[i : i + PIECE_BYTES] for t in texts for i in range(0, len(t), PIECE_BYTES)]
    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, total // 8)), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def _pieces(numbers: np.ndarray, knots: list[np.ndarray]) -> np.ndarray:
    """A one, each number, and how far each number lies beyond each of its knots."""
    out = [np.ones(len(numbers))]
    for x, k in zip(numbers.T, knots):
        width = max(k[-1] - k[0], 1e-9)
        out += [(x - k[0]) / width, *[np.maximum(0, x - at) / width for at in k]]
    return np.stack(out, axis=1)


@dataclass
class Classifier:
    sizes: Sizes | None
    knots: list[np.ndarray]
    slopes: np.ndarray
    #: Score of every text if only one class, or none, could be learned from.
    always: float

    def scores(self, compressors: list, texts: list[bytes]) -> np.ndarray:
        if self.sizes is None:
            return np.full(len(texts), self.always)
        return 1 / (1 + np.exp(-np.clip(_pieces(Sizes.numbers(compressors, texts), self.knots) @ self.slopes, -40, 40)))


def fit(samples: list[tuple[bytes, int]], counts: dict[int, int]) -> Classifier:
    """samples: (text, label 0 or 1) in no particular order; counts: how many labelled rows each class has in all.

    Every second text of a class makes its dictionary, the others calibrate. They are weighed so that the
    classes count as they do among all labelled rows.
    """
    by = {y: [t for t, label in samples if label == y] for y in (0, 1)}
    total = counts.get(0, 0) + counts.get(1, 0)
    share = (counts.get(1, 0) + 1) / (total + 2)
    if min(len(by[0]), len(by[1])) < 2:
        return Classifier(None, [], np.zeros(0), share)
    sizes = Sizes(_dictionary(by[1][::2]), _dictionary(by[0][::2]))
    rest = {y: by[y][1::2] for y in (0, 1)}
    x = Sizes.numbers(sizes.compressors(), rest[0] + rest[1])
    y = np.r_[np.zeros(len(rest[0])), np.ones(len(rest[1]))]
    weight = np.r_[np.full(len(rest[0]), counts[0] / len(rest[0])), np.full(len(rest[1]), counts[1] / len(rest[1]))]
    weight *= len(y) / weight.sum()
    knots = [np.unique(np.quantile(column, KNOTS)) for column in x.T]
    rows = _pieces(x, knots)
    prior = np.full(rows.shape[1], PRIOR)
    prior[0] = 1e-4
    slopes = np.zeros(rows.shape[1])

    def loss(s: np.ndarray) -> float:
        z = rows @ s
        return float(weight @ (np.logaddexp(0, z) - y * z) + prior @ (s * s) / 2)

    for _ in range(50):  # Newton's method; halved steps keep it from overshooting
        p = 1 / (1 + np.exp(-np.clip(rows @ slopes, -40, 40)))
        slope = rows.T @ (weight * (y - p)) - prior * slopes
        move = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag(prior), slope)
        rate, now = 1.0, loss(slopes)
        while rate > 1e-4 and loss(slopes + rate * move) > now:
            rate /= 2
        slopes = slopes + rate * move
        if np.abs(rate * move).max() < 1e-8:
            break
    return Classifier(sizes, knots, slopes, share)


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Fits on labelled rows that aren't held out: SAMPLE_ROWS of each class and SAMPLE_BYTES of their whole texts, at most.

    The rows are those with the least hashes of their ids; a text that no longer fits into the bytes is
    passed over, with all after it.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).filter(~held_out(id_col))
    usable = usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    first = Window.partitionBy("label").orderBy("h", "__id")
    chosen = usable.withColumn("h", F.xxhash64(F.lit(29), "__id")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLE_ROWS)
    # 2 * SAMPLE_ROWS ids at most
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "__id")
    order = Window.partitionBy("label").orderBy("h", "__id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.filter(F.octet_length("text") <= SAMPLE_BYTES)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "__id", "text"))).filter(F.col("n") <= SAMPLE_ROWS)
    rows = rows.withColumn("total", F.sum(F.octet_length("text")).over(order)).filter(F.col("total") <= SAMPLE_BYTES)
    samples = sorted((r.n, r.label, bytes(r.text)) for r in rows.select("n", "label", "text").collect())
    return fit([(text, label) for _, label, text in samples], counts)


def classify(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: the id, the columns in `keep`, held_out, score, predicted.

    score, from 0 to 1, is the chance that a text like this is labelled good; predicted is 1 from
    GOOD_FROM on. Only the text is looked at, as a whole; a null text counts as empty, and an empty one
    has the score that its sizes give. If fewer than two texts of a class could be learned from, every
    text has the (smoothed) share of good labels. Ids may be null or repeated; other columns play no
    part. A kept column that has a result's name comes out with an underscore in front. An empty table
    gives an empty one. Works on each partition alone; 1 MB of texts is held at a time, or a single one.
    """
    kept = [id_col, *[c for c in keep if c != id_col]]
    results = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    clash = {f.name for f in results}
    schema = T.StructType([*[T.StructField(f"_{c}" if c.lower() in clash else c, docs.schema[c].dataType) for c in kept], *results])

    def run(batches):
        compressors = classifier.sizes.compressors() if classifier.sizes else []
        for batch in slices(batches, len(kept) + 1):
            score = classifier.scores(compressors, [t or b"" for t in batch.column(len(kept) + 1).to_pylist()])
            found = [pa.array(score, pa.float64()), pa.array((score >= GOOD_FROM).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept) + 1)] + found, names=schema.names)

    return in_arrow(docs.select(*kept, held_out(id_col).alias("__held_out"), F.col(text_col).cast("binary").alias("__text")), run, schema)
