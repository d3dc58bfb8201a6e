"""Quality of documents: histogram gradient-boosted trees over statistics of whole texts.

Trees are grown level by level on binned statistics and flattened into arrays, and a batch of documents walks all trees at
once in numpy. The model is fitted on at most ``SAMPLE`` labelled rows, which are picked by a hash of the id; only their
statistics, some 30 numbers each, reach the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, ship, table, texts_of

SAMPLE = 20_000
THRESHOLD = 0.3
_CLASSES = np.zeros((256, 12), np.int64)
for _k, _chars in enumerate((
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b"\n", b"|", b"!?", b"#*$%&@^~=+_\\/<>{}[]",
    b".,;:", b"'\"()-", bytes(range(32)), bytes(range(128, 256)),
)):
    _CLASSES[list(_chars), _k] = 1


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text; all zero for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * 28
    each = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = each[each > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.split(b"\n")
    counted = Counter(words)
    most = counted.most_common(1)[0][1]
    line_count = Counter(lines)
    pairs = len(set(pairwise(words))) / max(1, len(words) - 1)
    return [
        *(each @ _CLASSES / n).tolist(), float(-(share * np.log2(share)).sum()), np.log1p(n), np.log1p(len(words)),
        lengths.mean(), lengths.std(), float(lengths.max()), len(counted) / len(words), most / len(words), pairs,
        sum(a == b for a, b in pairwise(words)) / len(words), sum(map(bytes.isupper, words)) / len(words), sum(map(bytes.isalpha, words)) / len(words),
        len(lines) / len(words), len(line_count) / len(lines), sum(v for v in line_count.values() if v > 1) / len(lines), text[0:1].isupper() * 1.0,
    ]


class Trees:
    """Boosted trees for the probability of label 1."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.base, size = 0.0, (2 << depth) - 1
        #: One row for each tree, in heap order: node k's children are 2k+1 (value <= limit) and 2k+2.
        self.feature, self.limit, self.value = np.zeros((0, size), np.int32), np.zeros((0, size)), np.zeros((0, size))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(mean / (1 - mean)))
        if len(y) == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
        n, features = x.shape
        cell = binned + np.arange(features) * self.bins
        score = np.full(n, self.base)
        size, trees = (2 << self.depth) - 1, []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, limit, value = np.zeros(size, np.int32), np.full(size, np.inf), np.zeros(size)
            for level in range(self.depth):
                first, wide = (1 << level) - 1, 1 << level
                at = ((node - first)[:, None] * (features * self.bins) + cell).ravel()
                shape = (wide, features, self.bins)
                gs = np.bincount(at, np.repeat(g, features), wide * features * self.bins).reshape(shape).cumsum(2)
                hs = np.bincount(at, np.repeat(h, features), wide * features * self.bins).reshape(shape).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                gain = np.where((hs >= self.least) & (ht - hs >= self.least), gain, 0).reshape(wide, -1)
                best = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(wide), best] > 1e-6):
                    f, b = divmod(int(best[k]), self.bins)
                    feature[first + k], limit[first + k] = f, edges[f][b] if b < len(edges[f]) else np.inf
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
            leaves = np.bincount(node, g, size) / (np.bincount(node, h, size) + self.l2)
            value = -self.rate * leaves
            score += value[node]
            trees.append((feature, limit, value))
        self.feature, self.limit, self.value = (np.stack(c) for c in zip(*trees))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; every row walks all trees at once, a level at a time."""
        score = np.full(len(x), self.base)
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth if len(trees) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        return 1 / (1 + np.exp(-score - self.value[trees, node].sum(1)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Trees:
    """Trees from at most so many labelled rows of docs whose id's crc32 is not divisible by 5.

    Rows without an id or a label are left out. An id counts once for each of its labels, with the smallest statistics where
    several rows have it, so repeated ids don't make the sample larger. Very long texts count whole.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("label")).where((crc32_mod("doc_id", 5) != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()).distinct()
    picked = known.orderBy(F.xxhash64("id", F.lit("quality")), "id", "label").limit(sample)  # so few rows that they can be sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in texts_of(b, 0)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(rows, pa.list_(pa.float64()))], ["id", "label", "x"])

    found = docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id")).join(F.broadcast(picked), "id").select("text", "id", "label")
    told = found.mapInArrow(run, "id long, label double, x array<double>").groupBy("id", "label").agg(F.min("x").alias("x"))
    rows = sorted(map(tuple, told.collect()))
    x = np.array([r[2] for r in rows]).reshape(len(rows), len(statistics(b"")))
    return Trees().fit(x, np.array([r[1] for r in rows]))


def score(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """docs, all columns kept, with the probability of label 1 for every text as a further column, whose name docs must not have yet.

    Null texts count as empty, very long ones whole; repeated rows stay; an empty table gives none.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # under 0.2 MB
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.zeros(0)]
            for a in range(0, len(b), 1024):
                out.append(sent.value.predict(np.array([statistics(t) for t in texts_of(b.slice(a, 1024), at)])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], [*b.schema.names, name])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{names}, `{name}` double")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Repeated rows stay; a null id counts as held out; no rows: none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
