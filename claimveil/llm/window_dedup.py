"""Repeated passages of words: Rabin-Karp hashes of every window of WINDOW words, counted over the corpus.

Documents are cut by doc_id into chunks, so chunks follow each other like their documents, and a window is a repeat if an earlier
chunk has it, or an earlier place of its own chunk. (1) Chunks send the distinct hashes of their windows, 32 bits beside the
part, to parts of the hash space, which count in how many chunks each occurs and answer with a bit for each. (2) Windows that
occur in several chunks go once more, with 64 further bits, and parts answer whether an earlier chunk has them. (3) Chunks
merge the repeated windows into maximal intervals. Equal means equal in 96 bits of two hashes and in the part; the first count
only chooses what is compared in full.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, shuffles, slices, table
from .hash_parts import ANSWERS, LOW, answer, by_part, flags_of, numbers_of, steps_of

WINDOW = 20
#: Bytes of text in a chunk and in a part of the hash space, on average; bytes that are hashed at a time.
CHUNK, PART, SLICE = 12 << 20, 24 << 20, 1 << 20
#: Bases of the words' and windows' polynomials, modulo 2^64; the second pair tells apart what the first finds equal.
BASES = [(0x100000001B3, 0x9E3779B97F4A7C15), (0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F)]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of some texts that lie side by side, a space after each: their first and last bytes, and each text's words."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = np.ones(len(self.data) + 2, bool)
        space[1:-1] = IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.first, self.last = edge[::2], edge[1::2]
        self.begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.upto = np.searchsorted(self.first, self.begins)

    def windows(self, which: int, length: int) -> np.ndarray:
        """A hash of the words from each word on, by Rabin and Karp; those near a text's end are not windows."""
        of_bytes, of_words = BASES[which]
        n = len(self.first)
        if n < length:
            return np.zeros(0, np.uint64)
        size = len(self.data)
        power, inverse = np.full(size, of_bytes, np.uint64), np.full(size, pow(of_bytes, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power), out=total[1:])
        h = _mixed((total[self.last] - total[self.first]) * np.multiply.accumulate(inverse)[self.first] + (self.last - self.first).astype(np.uint64))
        done, reach, width = np.zeros(0, np.uint64), 0, 1  # done: hashes of the last `reach` words of a window
        while True:
            if length & width:
                m = n - reach - width + 1
                done = h[:m] * np.uint64(pow(of_words, reach, 1 << 64)) + done[width : width + m] if reach else h
                reach += width
            if 2 * width > length:
                return _mixed(done[: n - length + 1])
            h = h[:-width] * np.uint64(pow(of_words, width, 1 << 64)) + h[width:]
            width *= 2

    def places(self, length: int) -> np.ndarray:
        """The words at which a window starts."""
        last = np.repeat(self.upto[1:], np.diff(self.upto))  # of each word, the end of its text
        return np.flatnonzero(np.arange(len(last)) + length <= last)


def _rows(chunk: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and bytes of a chunk's rows by doc_id, rows of one id by their bytes, those without an id last."""
    rows = sorted(zip(chunk.column("doc_id").to_pylist(), (x or b"" for x in chunk.column("text").to_pylist())), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int, Words]]:
    for a, b in slices([len(t) + 1 for t in texts], SLICE):
        yield a, b, Words(texts[a:b])


def _hashed(texts: list[bytes], parts: int, length: int) -> np.ndarray:
    """Of all windows in order: the part in the upper half, 32 bits of the hash in the lower."""
    told = [np.zeros(0, np.uint64)]
    for _, _, w in _slices(texts):
        h = w.windows(0, length)
        told.append(h[w.places(length)] if len(h) else h)
    h = np.concatenate(told)
    return (h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | h & LOW


def _second(texts: list[bytes], length: int) -> np.ndarray:
    told = [np.zeros(0, np.uint64)]
    for _, _, w in _slices(texts):
        h = w.windows(1, length)
        told.append(h[w.places(length)] if len(h) else h)
    return np.concatenate(told)


def in_chunks(docs: DataFrame, chunks: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, text binary, chunk)``: documents in so many chunks whose numbers follow the ids, rows without an id in further ones.

    Bounds are approximate quantiles of the ids; a row's chunk depends on its id alone, or without an id on its text.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    steps = [(k + 1) / chunks for k in range(chunks - 1)]
    bounds = rows.agg(F.percentile_approx("doc_id", steps, max(10000, 4 * chunks)).alias("b")).first()[0] if steps else None
    bounds = np.unique(np.array(bounds or [], np.int64))
    nowhere = F.pmod(F.xxhash64("text"), F.lit(chunks)).cast("int") + len(bounds) + 1

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    return rows.withColumn("chunk", F.when(F.col("doc_id").isNull(), nowhere).otherwise(place(F.coalesce("doc_id", F.lit(0)))))


def remove_repeated_windows(docs: DataFrame, length: int = WINDOW, text: str = "text", doc_id: str = "doc_id", output: str = "text") -> DataFrame:
    """docs' texts without each word covered by a window of ``length`` words that also starts earlier.

    Words are what lies between ASCII spaces, unchanged; a null text has none. Earlier is a smaller doc_id or, in one document, an
    earlier word; windows are judged on the input. Returns ``(doc_id, kept, spans array<struct<start, end>>)``, kept words
    joined by one space and spans the maximal removed intervals of words, or for output "digest" ``(doc_id, n_words,
    n_removed, kept_sha256)``, for every row. Rows of one id are taken in the order of their bytes, those without an id after
    all others, so the first of several equal rows stays. A text is hashed whole by one task, and rows of one id share a chunk.
    An empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    chunks = max(1, shuffles(spark), -(-size // CHUNK))
    parts = max(1, shuffles(spark), -(-size // PART))
    dealt = in_chunks(docs, chunks, text, doc_id).repartition(chunks, "chunk")

    def send(group: pa.Table) -> pa.Table:
        """The chunk's distinct hashes by part."""
        here = group.column("chunk")[0].as_py()
        keys = np.unique(_hashed(_rows(group)[1], parts, length))
        full, ends = by_part(keys, parts)
        blobs = [steps_of(keys[ends[p] : ends[p + 1]] & LOW) for p in full]
        return pa.table({"part": pa.array(full, pa.int32()), "chunk": pa.array([here] * len(full), pa.int32()), "hashes": pa.array(blobs, pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        """For each chunk's hashes, whether several chunks have them."""
        sent = [numbers_of(x) for x in group.column("hashes").to_pylist()]
        told, n = np.unique(np.concatenate(sent), return_counts=True)
        many = np.append(told[n > 1], np.uint64(1 << 40))  # no hash
        return answer(group, [many[np.searchsorted(many, x)] == x for x in sent])

    def send_again(group: pa.Table, answers: pa.Table) -> pa.Table:
        """The chunk's windows that several chunks have, with both hashes, by part."""
        here = answers.column("chunk")[0].as_py() if len(answers) else -1
        keys, more = _distinct(*_repeated(_rows(group)[1], answers)[:2])[:2]
        full, ends = by_part(keys, parts)
        blobs = [zlib.compress(steps_of(keys[ends[p] : ends[p + 1]] & LOW), 1) for p in full]
        tails = [more[ends[p] : ends[p + 1]].tobytes() for p in full]
        return pa.table({"part": pa.array(full, pa.int32()), "chunk": pa.array([here] * len(full), pa.int32()), "hashes": pa.array(blobs, pa.binary()), "more": pa.array(tails, pa.binary())})

    def _repeated(texts: list[bytes], answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the windows that several chunks have, and which these are."""
        keys = _hashed(texts, parts, length)
        told, back = np.unique(keys, return_inverse=True)
        flags = np.concatenate([np.zeros(0, bool), *flags_of(answers, "bits")])
        which = np.flatnonzero(flags[back]) if len(told) else np.zeros(0, np.int64)
        return keys[which], _second(texts, length)[which], which

    def decide(group: pa.Table) -> pa.Table:
        """For each chunk's windows, whether an earlier chunk has them."""
        chunk = np.array(group.column("chunk").to_pylist())
        low = [numbers_of(zlib.decompress(x)) for x in group.column("hashes").to_pylist()]
        more = [np.frombuffer(x, np.uint64) for x in group.column("more").to_pylist()]
        sizes = [len(x) for x in low]
        owner = np.repeat(chunk, sizes)
        low, more = np.concatenate(low), np.concatenate(more)
        order = np.lexsort((owner, more, low))
        again = np.zeros(len(order), bool)
        same = (low[order][1:] == low[order][:-1]) & (more[order][1:] == more[order][:-1])
        again[order[1:]] = same
        return answer(group, np.split(again, np.cumsum(sizes)[:-1]))

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts = _rows(group)
        first = answers.filter(answers.column("again").is_valid())
        told = answers.filter(answers.column("bits").is_valid())
        keys = _hashed(texts, parts, length)
        more = _second(texts, length)
        gone = ~_distinct(keys, more)[3]  # an earlier place of this chunk
        sent, other, which = _repeated(texts, first.drop_columns("bits").rename_columns(["chunk", "part", "bits", "n"]))
        _, _, number, _ = _distinct(sent, other)
        flags = np.concatenate([np.zeros(0, bool), *flags_of(told, "bits")])
        gone[which] |= flags[number] if len(number) else False
        out, at = [], 0
        for a, b, w in _slices(texts):
            places = w.places(length)
            bad = places[gone[at : at + len(places)]]
            at += len(places)
            n = len(w.first) + 1
            edge = np.bincount(bad, minlength=n) - np.bincount(bad + length, minlength=n)
            removed = np.cumsum(edge)[:-1] > 0
            kept = np.flatnonzero(~removed)
            mark = np.zeros(len(w.data) + 1, np.int8)
            mark[w.first[kept]] += 1
            mark[np.minimum(w.last[kept] + 1, len(w.data))] -= 1
            mask = np.cumsum(mark, dtype=np.int8)[:-1] > 0
            data = np.where(IS_SPACE[w.data], np.uint8(0x20), w.data)[mask].tobytes()
            until = np.concatenate(([0], np.cumsum(mask)))[w.begins]
            for d in range(b - a):
                left = data[until[d] : max(until[d], until[d + 1] - 1)]
                mine = removed[w.upto[d] : w.upto[d + 1]]
                if output == "digest":
                    out.append((ids[a + d], len(mine), int(mine.sum()), hashlib.sha256(left).hexdigest()))
                else:
                    step = np.diff(np.concatenate(([False], mine, [False])).astype(np.int8))
                    out.append((ids[a + d], left.decode(errors="replace"), [{"start": x, "end": y} for x, y in zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist())]))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=columns)

    if output == "digest":
        columns, kinds = ["doc_id", "n_words", "n_removed", "kept_sha256"], [pa.int64()] * 3 + [pa.string()]
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns, kinds = ["doc_id", "kept", "spans"], [pa.int64(), pa.string(), span]
        schema = "doc_id long, kept string, spans array<struct<start:long,end:long>>"
    sent = dealt.groupBy("chunk").applyInArrow(send, "part int, chunk int, hashes binary")
    several = cut(sent.groupBy("part").applyInArrow(count, ANSWERS))
    again = dealt.groupBy("chunk").cogroup(several.groupBy("chunk")).applyInArrow(send_again, "part int, chunk int, hashes binary, more binary")
    earlier = again.groupBy("part").applyInArrow(decide, ANSWERS)
    none = F.lit(None).cast("binary")
    told = several.select("chunk", "part", F.col("bits").alias("again"), none.alias("bits"), "n").union(earlier.select("chunk", "part", none, "bits", "n"))
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, schema)


def _distinct(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order; of each row its pair's number, and whether it is the first of its pair."""
    order = np.lexsort((more, keys))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
    mine, number, first = order[fresh], np.empty(len(order), np.int64), np.zeros(len(order), bool)
    number[order] = np.cumsum(fresh) - 1
    first[mine] = True  # lexsort is stable
    return keys[mine], more[mine], number, first


def op13_window_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), output="digest")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d) x
), bad AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) x WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM bad
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS rest, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i
  WHERE gone.i IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
