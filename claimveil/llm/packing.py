"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

Each piece of a document goes where the sum, over residual gaps, of the squared number of open sequences with that gap
becomes smallest, longer pieces first; a new one is opened for what fits none. Pieces are dealt by a hash into groups of bounded
size that are packed side by side on the executors; only lengths travel there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, slices, table
from .tokens import encoder, with_end

CAPACITY = 2048
#: Pieces that one group packs on average.
GROUP = 200_000
#: Bytes of text that are encoded together; a longer text alone.
SLICE = 8 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, longer pieces placed first; equal lengths stay in the order given.

    Putting a piece of length s into a gap g changes the sum by 2 (N[g-s] - N[g] + 1), where N counts open sequences by gap;
    filling a gap changes it by 1 - 2 N[s]. Among equals the smallest gap is taken. A sequence is opened only for a piece that
    fits none: the rule alone opens some early to even out the counts, which costs sequences when all lengths are known.
    """
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        fits = np.flatnonzero(count[s:capacity])
        if len(fits):
            change = 2 * (count[fits] - count[fits + s] + 1)
            if fits[0] == 0:
                change[0] = 1 - 2 * count[s]
            gap = s + int(fits[change.argmin()])
            sequence[i] = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap = capacity
            sequence[i] = made
            made += 1
        offset[i] = capacity - gap
        if gap > s:
            open_at[gap - s].append(int(sequence[i]))
            count[gap - s] += 1
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each row's ids and its end id, cut into pieces of capacity ids from the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in slices(pc.binary_length(whole.column(1)).fill_null(0).to_pylist(), SLICE):
                b = whole.slice(low, high - low)
                ids, ends = with_end(*encoder(tokenizer).column(b.column(1)), end)
                sizes = np.diff(ends, prepend=0)
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = (sizes - (count - 1) * capacity)[doc]
                start, length = np.where(piece > 0, first + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, first)
                at = 4 * ((ends - sizes)[doc] + start)
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist())]
                columns = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def pack(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Where each piece of each document goes: the pieces' columns, ``sequence_id`` and ``offset``.

    Null and empty texts are one piece, the end id. Rows without a doc_id, repeated ids and repeated rows are documents of
    their own; an empty table gives none. Other columns are not read. Very long texts are encoded whole and cut into as many
    pieces as they need. Sequence numbers are unique, not gapless.
    """
    ship(docs.sparkSession)
    cutting = cut(pieces(docs, tokenizer, end, capacity, text, doc_id))
    groups = max(1, -(-cutting.count() // GROUP))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        sequence, offset = sum_of_squares(group.column("length").to_numpy(), capacity)
        number = sequence * groups + group.column("grouped")[0].as_py()
        return group.drop(["grouped"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    # pieces are read from the shared folder, where their order is fixed; so equal rows, and those without an id, spread as well
    dealt = cutting.withColumn("grouped", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grouped").applyInArrow(place, PIECE + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(sequence_id, ids)``: the sequences themselves, each of at most capacity ids. Needs distinct, non-null ids of documents."""
    wanted = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            rows = []
            for places, data in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(b.column(1).to_pylist())):
                ids = np.frombuffer(data + tail, "<u4").astype(np.int32)
                rows += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]]) for p in places]
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["sequence_id", "offset", "ids"])

    told = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id").select("places", "text")
    parts = told.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    return parts.groupBy("sequence_id").agg(whole.alias("ids"))


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
