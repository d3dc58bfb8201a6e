"""SimHash near-duplicates with deletion-variant signatures.

64 bits are cut into two halves. Of two fingerprints that differ in at most three bits, one half differs in at most one;
with that bit's place left out, the halves are equal. So each half is indexed 32 times, each time without one of its
bits, and equal variants are the only candidates; all 64 bits are then compared. Only distinct fingerprints take part, as
packed arrays of eight bytes a variant, so copies cost nothing.

Three bits of 64 only find texts that are nearly the same. ``similar_documents`` finds those whose shingles agree to a given
similarity: its fingerprints are longer, so that the share of bits that differ tells the similarity. The first LONG words of 64 bits
are cut into segments of SEGMENT bits, of which two similar texts' fingerprints have some that differ by at most one bit.
Two segments that do have one half in common: a segment goes to the index twice, by either half, and there the other half's
variants, each without one bit, give the candidates. All FULL words are then compared, and where they leave a doubt the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Forest, cut, packed, ship, table, texts_of, unused
from .components import connected_components

HALF = 32
#: Fingerprints that one index part holds at most, on average.
PART = 1 << 20
SEED = 42


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    """SimHash of a text: words of its lower-cased (A-Z) bytes, shingles of so many words with repeats, XXH64 of each.

    A bit is one if over half the shingles' hashes have it. Fewer words: the whole sequence; none: zero.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(b" ".join(parts), seed)]
    else:
        hashes = [digest(b" ".join(x), seed) for x in zip(*(parts[k:] for k in range(words)))]
    n = len(hashes)
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint)``, the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t) for t in texts_of(b, 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def _drop_bit(half: np.ndarray, at: int) -> np.ndarray:
    low = np.uint64((1 << at) - 1)
    return (half & low) | ((half >> np.uint64(1)) & ~low)


def _spread(x: np.ndarray) -> np.ndarray:
    """Mixes bits, so that parts of an index come out even."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _masks(bits: int, most: int) -> np.ndarray:
    """All patterns of at most so many ones."""
    one = [np.uint64(1 << k) for k in range(bits)]
    out, last = [np.zeros(1, np.uint64)], [(np.uint64(0), -1)]
    for _ in range(most):
        last = [(m | one[k], k) for m, j in last for k in range(j + 1, bits)]
        out.append(np.array([m for m, _ in last], np.uint64))
    return np.concatenate(out)


def links_in(values: np.ndarray, keys: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints that share a variant key: ``(member, smallest member of its set)``.

    Small runs of a key are compared pair by pair; in a run of over 2 x 6,018 members each member looks up all patterns of
    at most three bits among the 33 that may differ, so work stays in proportion to the run.
    """
    order = np.lexsort((values, keys))
    values, keys = values[order], keys[order]
    same = keys[1:] == keys[:-1]
    starts = np.flatnonzero(np.concatenate(([True], ~same)))
    lengths = np.diff(np.append(starts, len(values)))
    sets = Forest(len(values))
    wide = 2 * 6018
    usual = np.repeat(lengths <= wide, lengths)
    reach = np.repeat(starts + lengths, lengths)
    at = np.flatnonzero(usual & (reach - np.arange(len(values)) > 1))
    step = 1
    while len(at):
        near = at[np.bitwise_count(values[at] ^ values[at + step]) <= most]
        sets.join(near, near + step)
        step += 1
        at = at[at + step < reach[at]]
    for s, n in zip(starts[lengths > wide], lengths[lengths > wide]):
        run = values[s : s + n]
        differ = np.bitwise_or.reduce(run ^ run[0])
        places = np.flatnonzero(np.unpackbits(np.array([differ], "<u8").view(np.uint8), bitorder="little"))
        for m in _masks(len(places), most)[1:]:
            mask = np.uint64(sum(1 << int(places[k]) for k in range(len(places)) if int(m) >> k & 1))
            other = run ^ mask
            found = np.minimum(np.searchsorted(run, other), n - 1)
            hit = np.flatnonzero((run[found] == other) & (found > np.arange(n)))
            sets.join(s + hit, s + found[hit])
    root = sets.roots()
    member = np.flatnonzero(root != np.arange(len(root)))
    return values[member], values[root[member]]


def fingerprint_links(prints: DataFrame, n: int, most: int = 3) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (longs) of at most three differing bits; enough of them to connect all.

    n: about how many fingerprints there are; it sets the number of index parts.
    """
    if most != 3:
        raise ValueError("two halves with one wildcard hold for three bits")
    parts = max(1, -(-n // PART))

    def variants(values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for side in range(2):
            half = (values >> np.uint64(HALF * side)) & np.uint64(0xFFFFFFFF)
            for bit in range(HALF):
                yield side * HALF + bit, half, _drop_bit(half, bit)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array(b.column(0)).view(np.uint64)
            keys, blobs = [], []
            for place, _, key in variants(values):
                part = _spread(key) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                for p in range(parts):
                    if ends[p + 1] > ends[p]:
                        keys.append(place * parts + p)
                        blobs.append(values[order[ends[p] : ends[p + 1]]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), packed(blobs)], ["part", "prints"])

    def verify(group: pa.Table) -> pa.Table:
        place = group.column("part")[0].as_py() // parts
        values = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("prints").to_pylist()])
        half = (values >> np.uint64(HALF * (place // HALF))) & np.uint64(0xFFFFFFFF)
        u, v = links_in(values, _drop_bit(half, place % HALF), most)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return prints.mapInArrow(deal, "part long, prints binary").groupBy("part").applyInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of docs.

    fingerprint: 16 hexadecimal digits; component_id: the smallest doc_id reachable over links of at most three differing
    bits, its own included. Null and empty texts, and those of spaces alone, have fingerprint zero and are linked like any
    other. Rows without a doc_id take part as well and get their component's smallest doc_id (null if all lack one);
    repeated ids and rows stay as they are; an empty table gives none. Other columns are not read.
    """
    ship(docs.sparkSession)
    prints = cut(with_fingerprints(docs, text, doc_id))
    distinct = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(distinct.select("fingerprint"), distinct.count())
    sets = connected_components(links)
    named = sets.join(distinct, sets.node == distinct.fingerprint).select("node", "component", "least")
    names = cut(named.groupBy("component").agg(F.min("least").alias("component_id")))
    other = cut(named.join(names, "component").select(F.col("node").alias("fingerprint"), "component_id"))
    alone = distinct.join(other, "fingerprint", "left").select(
        "fingerprint", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")
    )
    return prints.join(cut(alone), "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


#: Words of 64 bits that the index of long fingerprints looks at, and that all of one has; bits of a segment; fingerprints that one part of the index holds at most, on average.
LONG, FULL, SEGMENT, LONG_PART = 8, 32, 20, 1 << 16
#: Fingerprints with the same variant that are compared pair by pair; more are compared with those that others are close to.
RUN = 32
#: Candidates whose bits say that much more similarity than asked for are links; the others' shingles are compared. Standard deviations for chance.
SURE, CHANCE = 0.06, 3.0


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """A hash of each shingle of so many words of the lower-cased (A-Z) bytes, with repeats: a polynomial of its words' XXH64. Fewer words: the whole sequence."""
    parts = text.lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(w) - words + 1) if len(w) else 0
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return h


def long_fingerprint(text: bytes, words: int = 5, longs: int = LONG) -> bytes:
    """SimHash of 64 bits for each of ``longs``: a bit is one if over half the shingles, with repeats, have it in their hash, mixed once more for each 64 bits. No words: zero."""
    h = shingle_hashes(text, words)
    ones = np.zeros(64 * longs, np.int64)
    for a in range(0, len(h), 255):  # counts of so many shingles fit in a byte
        z = h[a : a + 255, None] + np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def bits_apart(similarity: float, bits: int = 64 * LONG, chance: float = 2.0) -> int:
    """Up to how many bits two long fingerprints of texts that similar (Jaccard) differ, with so many standard deviations for chance.

    Shingle sets of Jaccard similarity s have a cosine of 2 s / (1 + s), and a bit differs with the angle's share of 180 degrees.
    """
    share = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(bits * share + chance * np.sqrt(bits * share * (1 - share)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def long_links_in(values: np.ndarray, keys: np.ndarray, most: int, sets: Forest, pairs: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
    """Joins fingerprints (rows of 64-bit words) that share a key and differ by at most so many bits; pairs: gets those that were not in one set before.

    Short runs of a key are compared pair by pair. In a longer one, each fingerprint is close to a pivot or becomes one, so a
    large group costs little more than its size; where several sets are left, members of all but the largest are compared
    with every other.
    """

    def join(x: np.ndarray, y: np.ndarray) -> None:
        if pairs is not None and len(x):
            apart = sets.find(x) != sets.find(y)
            pairs.append((x[apart], y[apart]))
        sets.join(x, y)

    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    lengths = np.diff(np.append(starts, len(order)))
    reach = np.repeat(np.where(lengths <= RUN, starts + lengths, 0), lengths)
    at, step = np.flatnonzero(reach - np.arange(len(order)) > 1), 1
    while len(at):
        a, b = order[at], order[at + step]
        near = _apart(values[a], values[b]) <= most
        join(a[near], b[near])
        step += 1
        at = at[at + step < reach[at]]
    for s, n in zip(starts[lengths > RUN], lengths[lengths > RUN]):
        run = order[s : s + n]
        mine, open_ = values[run], np.ones(n, bool)
        while open_.any():
            pivot = int(open_.argmax())
            near = np.flatnonzero(_apart(mine, mine[pivot]) <= most)
            join(np.full(len(near), run[pivot]), run[near])
            open_[near] = False
        root = sets.find(run)
        names, where, count = np.unique(root, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(where != count.argmax()):
            near = np.flatnonzero(_apart(mine, mine[k]) <= most)
            join(np.full(len(near), run[k]), run[near])


def _text_keys(text: str) -> list[Column]:
    """128 bits of hashes that tell a row's text, null being empty."""
    told = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(told).alias("h1"), F.xxhash64(told, F.lit("second")).alias("h2")]


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, h1, h2, group, component_id)`` for every row of docs: hashes of its text, its group's number and smallest doc_id.

    Candidates come from the index of segments over the first LONG words of the fingerprints. Those whose FULL words leave no doubt are
    links; of the others, down to CHANCE standard deviations below the similarity asked for, the sets of shingles are compared.
    """
    spark = docs.sparkSession
    ship(spark)
    most, segments = bits_apart(similarity), 64 * LONG // SEGMENT

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([long_fingerprint(t, words, FULL) for t in texts_of(b, 3)], pa.binary())], ["doc_id", "h1", "h2", "print"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *_text_keys(text), F.col(text).alias("text")).mapInArrow(prints_of, "doc_id long, h1 long, h2 long, print binary")
    rows = cut(rows.withColumn("node", F.xxhash64("print")))
    distinct = cut(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("print").alias("print")))
    parts = max(1, -(-distinct.count() // LONG_PART))
    record = np.dtype([("node", "<i8"), ("words", "<u8", (LONG,))])

    def segment(data: np.ndarray, k: int) -> np.ndarray:
        """The k-th segment of each fingerprint."""
        begin, shift = divmod(k * SEGMENT, 8)
        at = np.ascontiguousarray(data["words"]).view(np.uint8).reshape(len(data), -1)[:, begin : begin + 4]
        return np.ascontiguousarray(at).view("<u4").ravel().astype(np.uint64) >> np.uint64(shift) & np.uint64((1 << SEGMENT) - 1)

    half, low = np.uint64(SEGMENT // 2), np.uint64((1 << SEGMENT // 2) - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = np.zeros(len(b), record)
            data["node"] = b.column(0).to_numpy()
            data["words"] = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, LONG)
            keys, blobs = [], []
            for k in range(segments):
                value = segment(data, k)
                for side, common in enumerate((value & low, value >> half)):
                    part = _spread(common) % np.uint64(parts)
                    order = np.argsort(part, kind="stable")
                    ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                    for p in np.flatnonzero(np.diff(ends)).tolist():
                        keys.append((2 * k + side) * parts + p)
                        blobs.append(data[order[ends[p] : ends[p + 1]]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), packed(blobs)], ["part", "prints"])

    def candidates(group: pa.Table) -> pa.Table:
        k, side = divmod(group.column("part")[0].as_py() // parts, 2)
        data = np.concatenate([np.frombuffer(x, record) for x in group.column("prints").to_pylist()])
        data = data[np.argsort(data["node"])]
        values, sets = np.ascontiguousarray(data["words"]), Forest(len(data))
        value = segment(data, k)
        common, other = (value & low, value >> half) if side == 0 else (value >> half, value & low)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for bit in range(SEGMENT // 2):
            long_links_in(values, common << half | _drop_bit(other, bit), most, sets, pairs)
        a, b = (np.concatenate(x) for x in zip(*pairs))
        return pa.table({"u": pa.array(data["node"][np.minimum(a, b)]), "v": pa.array(data["node"][np.maximum(a, b)])})

    dealt = distinct.select("node", F.substring("print", 1, 8 * LONG)).mapInArrow(deal, "part long, prints binary")
    pairs = dealt.groupBy("part").applyInArrow(candidates, "u long, v long").distinct()
    told = cut(_compared(pairs, distinct.select("node", "print"), similarity))
    links, doubt = told.where("sure").select("u", "v"), told.where("not sure").select("u", "v")
    if not doubt.isEmpty():
        links = links.union(_by_shingles(doubt, docs.select(*_text_keys(text), F.col(text).alias("text")), rows, similarity, words))
    return _named(rows.select("doc_id", "h1", "h2", "node"), distinct.select("node", "least"), links)


def _beside(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """pairs ``(u, v)`` with both nodes' values, ``a`` and ``b``."""
    told = pairs.join(values.select(F.col("node").alias("u"), F.col(name).alias("a")), "u")
    return told.join(values.select(F.col("node").alias("v"), F.col(name).alias("b")), "v").select("u", "v", "a", "b")


def _compared(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """``(u, v, sure)`` of the pairs that may be so similar, by all bits of their fingerprints."""
    bits = 64 * FULL
    sure, most = bits_apart(min(1.0, similarity + SURE), bits, 0.0), bits_apart(similarity, bits, CHANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.frombuffer(b"".join(x.column(k).to_pylist()), "<u8").reshape(-1, FULL) for k in (2, 3))
            apart = _apart(a, b)
            near = pa.array(apart <= most)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(near), x.column(1).filter(near), pa.array(apart <= sure).filter(near)], ["u", "v", "sure"])

    return _beside(pairs, prints, "print").mapInArrow(run, "u long, v long, sure boolean")


def _by_shingles(pairs: DataFrame, texts: DataFrame, rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """Pairs whose sets of shingles are so similar; each node's text is read once."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    one = rows.join(nodes, "node").groupBy("node").agg(F.min(F.struct("h1", "h2")).alias("h")).select("node", "h.*")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), packed([np.unique(shingle_hashes(t, words)) for t in texts_of(b, 1)])], ["node", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            near = []
            for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([x.column(k).filter(pa.array(near, pa.bool_())) for k in (0, 1)], ["u", "v"])

    sets = texts.join(one, ["h1", "h2"]).select("node", "text").mapInArrow(shingles, "node long, shingles binary")
    sets = cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))
    return _beside(pairs, sets, "shingles").mapInArrow(run, "u long, v long")


def _named(rows: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """rows with their node's component and its smallest id; a node without links is a component."""
    sets = connected_components(links).withColumnRenamed("node", "linked")
    known = cut(distinct.join(sets, F.col("node") == F.col("linked"), "left").select("node", "least", F.coalesce("component", "node").alias("group")))
    names = known.groupBy("group").agg(F.min("least").alias("component_id"))
    return rows.join(cut(known.select("node", "group").join(names, "group")), "node").drop("node")


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, component_id)`` for every row of docs: the smallest doc_id reachable over links of texts at least that similar.

    Similarity is that of sets of shingles; see the README for what is found at which. Null and empty texts, and those of spaces
    alone, are one group. Rows without a doc_id take part as well and get their component's smallest doc_id (null if all lack
    one); repeated ids and rows stay as they are; very long texts count whole; an empty table gives none. Other columns are not read.
    """
    return similar_groups(docs, similarity, words, text, doc_id).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of ``similar_documents``, with all its columns: that with the smallest doc_id.

    Rows without a doc_id come after all others, so of a group that has none with an id one row stays as well; among rows of one id
    the hash of the text decides, and of rows equal in both one stays, whichever. An empty table gives none.
    """
    groups = cut(similar_groups(docs, similarity, words, text, doc_id))
    own = [unused(docs, f"_{c}") for c in ("doc_id", "h1", "h2", "times")]
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h1", "h2")).alias("best")).select("best.*")
    times = groups.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("times")).toDF(*own)
    best = cut(best.join(times, F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.col("h1") == F.col(own[1])) & (F.col("h2") == F.col(own[2]))).select(*own))
    h1, h2 = _text_keys(text)

    def of(rows: DataFrame) -> DataFrame:
        return docs.join(rows, F.col(doc_id).cast("long").eqNullSafe(F.col(own[0])) & (h1 == F.col(own[1])) & (h2 == F.col(own[2])))

    kept = of(best.where(F.col(own[3]) == 1)).select(*docs.columns)
    again = best.where(F.col(own[3]) > 1)
    if again.isEmpty():
        return kept
    return kept.union(of(again).dropDuplicates(own[:3]).select(*docs.columns))


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
