"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios, trained on labelled text.

A text's features are the distinct n-grams (4 to 6 code points, A-Z lower-cased, white space as one blank each, blanks
around the text), hashed to 2^HASH_BITS. On the labelled sample, document frequencies by class give each n-gram its
log-count ratio; the FEATURES n-grams with the largest likelihood-ratio statistic stay, each feature's value is its ratio,
and an L2-regularised logistic regression weighs them. The score is its probability.

The fit reads at most `sample` labelled rows (those of the least hash of doc_id); everything else covers all rows.
Null or empty texts score as a text without n-grams. Several labels of a document count as their largest; null labels
are left out. Without labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices, ship, slices, texts

SIZES = (4, 5, 6)
HASH_BITS = 22
FEATURES = 1024
#: Documents a feature must occur in.
LEAST = 8
SAMPLE = 16_000
THRESHOLD = 0.3
_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_PAD = max(SIZES)


def _ngrams(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the hash at every place of the batch's joined texts, and the document of every place."""
    joined = (" " * _PAD).join(["", *batch, ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 128, _LOWER[np.minimum(code, 127)], code).astype(np.uint64)
    ends = np.cumsum(np.array([len(t) + _PAD for t in batch], np.int64)) + 1
    doc = np.repeat(np.arange(len(batch), dtype=np.int32), np.diff(ends, prepend=0))
    value = np.zeros(len(code), np.uint64)
    for n in range(1, _PAD + 1):
        shifted = code[n - 1 :]
        value = value[: len(shifted)] * np.uint64(1_000_003) + shifted
        if n in SIZES:
            h = ((value + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)
            m = min(len(h), len(doc))
            yield h[:m].astype(np.int32), doc[:m]


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """doc_id, text and y of at most `sample` labelled documents; the ids, so bounded, are broadcast."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    return texts(docs).join(F.broadcast(ids), "doc_id")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((2, 1 << HASH_BITS), np.int32)
    some = False
    for b in slices(batches, "text", 500_000):
        y = b.column("y").to_numpy(zero_copy_only=False)
        for h, doc in _ngrams(b.column("text").to_pylist()):
            seen = np.unique(doc.astype(np.int64) << HASH_BITS | h)
            cls = y[seen >> HASH_BITS]
            for c in (0, 1):
                np.add.at(both[c], seen[cls == c] & ((1 << HASH_BITS) - 1), 1)
            some = True
    if some:
        at = np.flatnonzero(both.any(axis=0))
        for s in range(0, len(at), 100_000):
            x = at[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(both[0, x]), pa.array(both[1, x])], ["h", "n0", "n1"])


@dataclass
class Model:
    """hashes: sorted, of the features kept; weight: of each, its ratio times its coefficient; bias: the intercept."""

    hashes: np.ndarray
    weight: np.ndarray
    bias: float

    def margins(self, batch: list[str]) -> np.ndarray:
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[self.hashes] = np.arange(len(self.hashes), dtype=np.int32)
        return self._margins(batch, place)

    def _margins(self, batch: list[str], place: np.ndarray) -> np.ndarray:
        out = np.full(len(batch), self.bias)
        seen = _present(batch, place, len(self.hashes))
        if len(seen):
            np.add.at(out, seen // len(self.hashes), self.weight[seen % len(self.hashes)])
        return out


def _present(batch: list[str], place: np.ndarray, n: int) -> np.ndarray:
    """document * n + feature, once each, of the features present."""
    found = []
    for h, doc in _ngrams(batch):
        f = place[h]
        at = np.flatnonzero(f >= 0)
        found.append(doc[at].astype(np.int64) * n + f[at])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """The classifier of a 0/1 column of labels (doc_id, label), learned from documents (doc_id, text) that have one."""
    train = labelled(docs, labels, label, sample)
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        share = min(max(n1 / (n0 + n1), 1e-6), 1 - 1e-6) if n0 + n1 else 0.5
        return Model(np.zeros(0, np.int32), np.zeros(0), float(np.log(share / (1 - share))))

    def gain(k, n, p):  # a term of the likelihood-ratio statistic
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log((n - k) / (n * (1 - p)))).otherwise(0.0)

    c0, c1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    p = (c0 + c1 + 0.5) / (n0 + n1 + 1.0)
    top = (
        train.mapInArrow(_counts, "h int, n0 int, n1 int").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n0") + F.col("n1") >= min(LEAST, n0 + n1))
        .orderBy((gain(c0, F.lit(float(n0)), p) + gain(c1, F.lit(float(n1)), p)).desc(), "h").limit(FEATURES).collect()
    )
    top.sort(key=lambda r: r["h"])
    hashes = np.array([r["h"] for r in top], np.int32)
    pos, neg = (np.array([r[k] for r in top], float) + 1 for k in ("n1", "n0"))
    ratio = np.log((pos / (n1 + 2)) / (neg / (n0 + 2)))
    if not len(hashes):
        return Model(hashes, ratio, float(np.log(n1 / n0)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[hashes] = np.arange(len(hashes), dtype=np.int32)
        for b in slices(batches, "text", 500_000):
            seen = _present(b.column("text").to_pylist(), place, len(hashes))
            cut = np.searchsorted(seen, np.arange(b.num_rows + 1) * len(hashes))
            packed = [(seen[i:j] % len(hashes)).astype("<u2").tobytes() for i, j in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "x"])

    schema = T.StructType([train.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    got = train.mapInArrow(rows, schema).toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    x = [np.frombuffer(v, "<u2") for v in got.column("x").to_pylist()]
    weight, bias = _logistic(x, got.column("y").to_numpy().astype(float), ratio)
    return Model(hashes, weight * ratio, bias)


def _logistic(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, l2: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Coefficients over features of value ratio, and the intercept, by full-batch Adam."""
    row = np.repeat(np.arange(len(x)), [len(v) for v in x])
    col = np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64)
    val, n, k = ratio[col], len(x), len(ratio)
    w = np.zeros(k + 1)
    w[k] = np.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for i in range(1, rounds + 1):
        e = (1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], n) + w[k], -40, 40))) - y) / n
        g = np.append(np.bincount(col, val * e[row], k) + l2 * w[:k], e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return w[:k], float(w[k])


def scores(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, score (0 to 1; higher: label 1 is likelier) and the columns named, for each row of docs (doc_id, text)."""
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[model.hashes] = np.arange(len(model.hashes), dtype=np.int32)
        for b in slices(batches, "text", 500_000):
            p = 1 / (1 + np.exp(-np.clip(model._margins(b.column("text").to_pylist(), place), -40, 40)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(p)], [*kept, "score"])

    d = texts(docs, *keep)
    return d.mapInArrow(run, T.StructType([*(d.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""

    ship(docs.sparkSession)

    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = np.full(1 << HASH_BITS, -1, np.int32)
        place[model.hashes] = np.arange(len(model.hashes), dtype=np.int32)
        least = np.log(threshold / (1 - threshold))
        for texts_ in batches:
            yield by_slices(texts_, lambda part: model._margins(part, place) < least, pa.bool_(), 500_000)

    return docs.where(F.arrow_udf(keep, "boolean")(F.coalesce(F.col("text").cast("string"), F.lit(""))))
