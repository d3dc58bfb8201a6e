"""Language of whole texts: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights come from the follow-the-regularised-leader rule with elastic-net penalties, which leaves most of them zero; a
temperature, fitted on rows that the weights have not seen, turns their sums into probabilities. Document frequencies are
counted over all rows with a language that may be learned from; weights are fitted on some ``SAMPLE`` of them, or fewer if
they are long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, ship, table

#: n-grams of 1 to GRAMS characters are hashed to so many features.
GRAMS, FEATURES = 3, 1 << 15
#: What weights and temperature are fitted on: so many rows, and bytes of text, over all languages on average, evenly dealt.
SAMPLE, SAMPLE_BYTES = 12_000, 64 << 20
#: Characters whose grams are counted at a time.
PART = 1 << 20
SLOT = 512


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs; a very long text is counted in parts that overlap by a gram."""
    text, count = f" {text.lower()} ", np.zeros(FEATURES, np.int64)
    for begin in range(0, len(text), PART):
        c = np.frombuffer(text[begin : begin + PART + GRAMS - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, GRAMS + 1):
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ c[n - 1 :]
            mixed = (h[:PART] + np.uint32(n)) * np.uint32(0x9E3779B1)
            count += np.bincount(mixed >> np.uint32(17), minlength=FEATURES)
    at = np.flatnonzero(count)
    return at.astype(np.uint16), count[at]


class Model:
    """Weights by feature and language, the features' IDF, and a temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-5):
        self.languages, self.idf, self.temperature = languages, idf.astype(np.float32), 1.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.weights = np.zeros((FEATURES + 1, len(languages)), np.float32)

    def values(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = (1 + np.log(count)) * self.idf[at]
        return (v / max(float(np.sqrt((v * v).sum())), 1e-9)).astype(np.float32)

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.values(at, count) @ self.weights[at] + self.weights[FEATURES]

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 4, batch: int = 32) -> None:
        shape = self.weights.shape
        z, n = np.zeros(shape, np.float64), np.zeros(shape, np.float64)
        told = [(np.append(at, FEATURES).astype(np.int64), np.append(self.values(at, c), np.float32(1))) for at, c in rows]
        for epoch in range(epochs):
            order = np.random.default_rng(epoch).permutation(len(told))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                at = np.concatenate([told[i][0] for i in part])
                v = np.concatenate([told[i][1] for i in part])
                begins = np.cumsum([0, *(len(told[i][0]) for i in part[:-1])])
                p = _softmax(np.add.reduceat(self.weights[at] * v[:, None], begins))
                p[np.arange(len(part)), labels[part]] -= 1
                row = np.repeat(np.arange(len(part)), np.diff(np.append(begins, len(at))))
                g = np.stack([np.bincount(at, v * p[row, k], FEATURES + 1) for k in range(shape[1])], 1) / len(part)
                z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * self.weights
                n += g * g
                kept = np.abs(z) > self.l1
                self.weights = np.where(kept, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0).astype(np.float32)

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Picks the temperature under which rows that were not fitted are likeliest."""
        if rows:
            logits = np.stack([self.logits(at, c) for at, c in rows])
            loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(rows)), labels] + 1e-12).mean()
            self.temperature = float(min(np.geomspace(0.02, 5, 120), key=loss))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = _softmax(self.logits(*grams(text))[None] / self.temperature)[0]
        return self.languages[int(p.argmax())], float(p.max())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many rows of the first column each feature occurs. Tasks send one array each, in slots that are summed side by side."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                df[grams(t or "")[0]] += 1
        parts = df.reshape(-1, SLOT)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts])], ["slot", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"slot": group.column("slot")[:1], "counts": pa.array([total.tobytes()])})

    summed = texts.mapInArrow(count, "slot int, counts binary").groupBy("slot").applyInArrow(add, "slot int, counts binary")
    out = np.zeros((FEATURES // SLOT, SLOT), np.int64)
    for slot, counts in summed.collect():  # 64 rows, whatever the input
        out[slot] = np.frombuffer(counts, np.int64)
    return out.ravel()


def train(docs: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """A model of the languages in docs; rows without text or language are left out. Every language that is left is learned.

    Repeated rows count each time; without rows the model knows no language. Very long texts count whole.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id")).where("text is not null and lang is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    counts = {r["lang"]: (r["n"], r["size"]) for r in found.collect()}
    languages = sorted(counts)
    idf = np.log((1 + sum(n for n, _ in counts.values())) / (1 + document_frequencies(rows.select("text")))) + 1
    model = Model(languages, idf)
    if not languages:
        return model
    # a Bernoulli sample by a hash of the id and text: the bounds hold on average, to some hundredths; a row for each language
    shares = [(name, int(min(1.0, sample / len(languages) / n, SAMPLE_BYTES / len(languages) / max(size, 1)) * (1 << 30))) for name, (n, size) in counts.items()]
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang"), F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 30))
    picked = rows.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share long")), "lang").where(draw < F.col("share"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grams(t) for t in b.column(0).to_pylist()]
            packed = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(zip(*found), (np.uint16, np.uint32))]
            yield pa.RecordBatch.from_arrays([b.column(1), *(packed or [pa.array([], pa.binary())] * 2)], ["lang", "at", "count"])

    told = picked.select("text", "lang").mapInArrow(extract, "lang string, at binary, count binary").collect()
    told.sort()
    found = [(np.frombuffer(a, np.uint16), np.frombuffer(c, np.uint32)) for _, a, c in told]
    labels = np.array([languages.index(name) for name, _, _ in told], np.int64)
    held = np.arange(len(found)) % 5 == 0
    model.fit([x for x, h in zip(found, held) if not h], labels[~held])
    model.calibrate([x for x, h in zip(found, held) if h], labels[held])
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``; `und` and 0 for null texts and those without a letter.

    Columns of these names, and the text, give way; other columns and repeated rows stay. Very long texts count whole. An empty table
    gives none.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 0.13 MB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [sent.value.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            columns = [*b.columns[:-1], pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "lang_pred", "score"])

    kept = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    told = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return told.mapInArrow(run, f"{names}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Repeated rows stay; a null id counts as learned from; no rows: none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc32_mod("doc_id", 3) == 1).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model)
