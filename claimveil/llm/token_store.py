"""Token ids of a corpus as binary shards, with Elias-Fano document boundaries.

A shard is one file: a fixed head, the ids of its documents one after the other in the narrowest unsigned integers that hold
the vocabulary, then the Elias-Fano code of where each document ends and that of the documents' ids (as steps from the
first). Where documents begin and end is read by select, through the directory that is stored with the code. Shards follow
each other in ascending order of doc_id, documents without one last, so a document's place in the whole corpus is its place
in the shard plus the ids of all shards before it; the manifest has one small row for each shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import elias_fano
from .common import cut, fresh_dir, ship, shuffles, slices, table
from .tokens import encoder, with_end

#: Magic, bytes an id, documents, those of them without a doc_id, ids, first doc_id, crc32 of the ids.
HEAD = struct.Struct("<4sBQQQqI")
MAGIC = b"TOK2"
#: Bytes of text that one shard holds on average, and documents and bytes of ids at most.
SHARD, MOST_DOCS, MOST_BYTES = 16 << 20, 1 << 16, 32 << 20
#: Documents whose places are read together, and bytes of text that are encoded together.
BLOCK, SLICE = 4096, 8 << 20
MANIFEST = "first_id long, last_id long, n_docs long, n_ids long, path string"


def pack_shard(doc_ids: np.ndarray, ids: list[bytes], width: int) -> bytes:
    """Bytes of a shard from documents in ascending order and their ids as unsigned 32-bit integers; the last may lack a doc_id."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    body = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    first = int(doc_ids[0]) if len(doc_ids) else 0
    head = HEAD.pack(MAGIC, width, len(ids), len(ids) - len(doc_ids), int(lengths.sum()), first, zlib.crc32(body))
    steps = doc_ids.astype(np.int64).view(np.uint64) - np.int64(first).view(np.uint64)
    return head + body + elias_fano.encode(np.cumsum(lengths)) + elias_fano.encode(steps)


class Shard:
    """Reads a shard's bytes; where documents begin and end is found by select, without a table of offsets."""

    def __init__(self, data: bytes):
        magic, self.width, self.n_docs, self.n_null, self.n_ids, self.first, crc = HEAD.unpack_from(data)
        body = memoryview(data)[HEAD.size : HEAD.size + self.width * self.n_ids]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a whole shard")
        self.ids = np.frombuffer(body, f"<u{self.width}")
        at = HEAD.size + self.width * self.n_ids
        self.ends = elias_fano.EliasFano(memoryview(data)[at:])
        self.steps = elias_fano.EliasFano(memoryview(data)[at + self.ends.size :])

    def places(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Where documents a to b begin and end."""
        ends = self.ends.selects(np.arange(a, b))
        return np.concatenate(([self.ends.select(a - 1) if a else 0], ends[:-1])), ends

    def document(self, i: int) -> np.ndarray:
        (begin,), (end,) = self.places(i, i + 1)
        return self.ids[begin:end]

    def doc_ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids of documents a to b, as far as they have one."""
        known = self.n_docs - self.n_null
        return self.steps.selects(np.arange(min(a, known), known if b is None else min(b, known))) + self.first


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes all documents' ids, each with its end id, to shards in folder; returns the manifest, in the shared folder.

    Null and empty texts are the end id alone. Repeated ids are documents of their own, side by side; rows without a doc_id
    come after all others. An empty table gives no shards. Other columns are not read. Very long texts are encoded whole,
    alone in their batch; a shard is closed after the document that fills it. A task that runs again writes new files under
    names of its own, and the manifest names those of the run that counted.
    """
    ship(docs.sparkSession)
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD), shuffles(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _place(folder)
        store.create_dir(at, recursive=True)
        encode = encoder(tokenizer)
        width = 2 if max(encode.vocabulary, end + 1) <= 1 << 16 else 4
        numbers, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            path = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.bin"
            known = [x for x in numbers if x is not None]
            with store.open_output_stream(f"{at}/{path}") as out:
                out.write(pack_shard(np.array(known, np.int64), ids, width))
            row = {"first_id": pa.array([numbers[0]], pa.int64()), "last_id": pa.array([numbers[-1]], pa.int64()), "n_docs": [len(numbers)], "n_ids": [held // 4], "path": [path]}
            numbers.clear(), ids.clear()
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            texts = b.column(1)
            for low, high in slices(pc.binary_length(texts).fill_null(0).to_pylist(), SLICE):
                told, ends = with_end(*encode.column(texts.slice(low, high - low)), end)
                data, begin = told.astype("<u4").tobytes(), 0
                for number, stop in zip(b.column(0).slice(low, high - low).to_pylist(), (4 * ends).tolist()):
                    if numbers and (len(numbers) >= MOST_DOCS or held * width // 4 >= MOST_BYTES):
                        yield flush()
                        held = 0
                    numbers.append(number)
                    ids.append(data[begin:stop])
                    held += stop - begin
                    begin = stop
        if numbers:
            yield flush()

    # the second key deals out rows without an id, however many there are
    order = [F.asc_nulls_last("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
    return cut(wanted.repartitionByRange(shards, *order).sortWithinPartitions(order[0]).mapInArrow(run, MANIFEST))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files; start counts the ids of all before it.

    The running sum over shards is the one step in one task: a row for each shard, some 30 MB of ids.
    """
    ship(manifest.sparkSession)
    before = Window.orderBy(F.asc_nulls_last("first_id"), F.asc_nulls_last("last_id"), "path").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _place(folder)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_stream(f"{at}/{path}") as f:
                    shard = Shard(f.read())
                for low in range(0, shard.n_docs, BLOCK):
                    starts, ends = shard.places(low, min(low + BLOCK, shard.n_docs))
                    ids = memoryview(shard.ids[starts[0] : ends[-1]].astype("<u4").tobytes())
                    crcs = [zlib.crc32(ids[x:y]) for x, y in zip((4 * (starts - starts[0])).tolist(), (4 * (ends - starts[0])).tolist())]
                    known = shard.doc_ids(low, low + len(ends))
                    numbers = pa.concat_arrays([pa.array(known, pa.int64()), pa.nulls(len(ends) - len(known), pa.int64())])
                    yield pa.RecordBatch.from_arrays([numbers, pa.array(base + starts), pa.array(ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = shards.select("path", "base").repartition(shuffles(manifest.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_output(spark, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest, folder)
