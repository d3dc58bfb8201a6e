"""Repeated strings across documents, by a run-length index over the passages that may repeat.

Every window of LENGTH bytes is named by the smallest hash of its KEY-byte strings, so equal windows have equal names, and
neighbouring windows mostly share theirs: a run of windows of one name is a segment. (1) Documents, dealt into chunks,
send their segments' names to parts of a name table, which (2) answers with the names that occur in several documents.
(3) Segments of these names go, each distinct one once a chunk, to index parts. There (4) they form run-length indexes, which
tell for each window the smallest document that holds it. (5) Chunks remove what starts in a smaller document. Names and
segments travel as packed arrays; documents are dealt once. Segments count as equal by their bytes, fingerprints only bring
them together.

A name whose segments come to over HOT bytes would make one part large. The name table, where all chunks meet, finds these
names, and their segments fall into windows, each a segment named by its own fingerprint. So they spread over all parts, equal
windows still meet, and they go through the index with their bytes like all others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, shuffles, slices, table
from .rindex import RunLengthIndex

LENGTH, KEY = 50, 24
#: Bytes of text in a chunk, in a part of the name table and in an index part, on average.
CHUNK, NAMES, PART = 6 << 20, 32 << 20, 4 << 20
#: Bytes of one name's segments, those of all chunks, from which its windows go by themselves. Chunks tell what a name has there only from
#: HOT / chunks or a longest segment on; else the usual bytes of a segment count, so a name may reach some four times that unnoticed.
HOT = 1 << 20
#: Windows in a segment at most, and bytes of documents that are hashed, or of names that are indexed, at a time: what a core's cache holds.
WINDOWS, SLICE, INDEX = 200, 1 << 17, 1 << 16
BASE = 0x100000001B3
LAST = np.iinfo(np.int64).max


class Segments:
    """Segments of some documents, which lie side by side in one array: name, document, first byte, number of windows."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.name, self.doc, self.first, self.windows = none.astype(np.uint64), none, none, none
        if n < length:
            return
        key = min(KEY, length)
        h = self.data.astype(np.uint64)
        done = np.zeros(n, np.uint64)
        size, reach = 1, 0  # h: hashes of `size` bytes; done: of the last `reach` bytes of the key
        while True:
            if key & size:
                done = h[: n - reach - size + 1] * np.uint64(pow(BASE, reach, 1 << 64)) + done[size : size + n - reach - size + 1] if reach else h
                reach += size
            if 2 * size > key:
                break
            h = h[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + h[size:]
            size *= 2
        v = done * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(29)
        wide, step = length - key + 1, 1
        while 2 * step <= wide:
            v = np.minimum(v[:-step], v[step:])
            step *= 2
        if step < wide:
            v = np.minimum(v[: len(v) - (wide - step)], v[wide - step :])
        fresh = np.concatenate(([True], v[1:] != v[:-1]))
        fresh[self.begins[self.begins < len(v)]] = True
        starts = np.flatnonzero(fresh)
        run = np.diff(np.append(starts, len(v)))
        if run.max() > WINDOWS:  # long repeats within a document
            parts = -(-run // WINDOWS)
            k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            starts, run = np.repeat(starts, parts) + WINDOWS * k, np.minimum(np.repeat(run, parts) - WINDOWS * k, WINDOWS)
        doc = np.searchsorted(self.ends, starts, side="right")
        windows = np.minimum(run, self.ends[doc] - length + 1 - starts)  # windows don't reach into the next document
        kept = windows > 0
        self.name, self.doc, self.first, self.windows = v[starts[kept]], doc[kept], starts[kept], windows[kept]

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        """64-bit fingerprints of some segments' whole texts, with their names and lengths mixed in."""
        return self.prints(self.first[at], self.windows[at] + length - 1, self.name[at])

    def prints(self, first: np.ndarray, size: np.ndarray, name: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of strings, with their names and lengths mixed in."""
        n = len(self.data)
        power, inverse = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power)[:n], out=total[1:])
        h = (total[first + size] - total[first]) * np.multiply.accumulate(inverse)[first]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + name
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
        return h ^ (h >> np.uint64(32))


def _documents(chunk: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """Ids and bytes of a chunk's rows, always in the same order."""
    rows = sorted(zip(chunk.column("doc_id").to_pylist(), (x or b"" for x in chunk.column("text").to_pylist())), key=lambda r: (r[0] is None, r[0], r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def _in_slices(ids: list, texts: list[bytes], length: int, parts: int) -> Iterator[tuple[int, np.ndarray, Segments]]:
    for a, b in slices([len(t) for t in texts], SLICE):
        found = Segments(texts[a:b], length)
        found.name = _placed(found.name, parts)
        yield a, np.array([LAST if x is None else x for x in ids[a:b]], np.int64), found


def _placed(names: np.ndarray, parts: int) -> np.ndarray:
    """Names as their index part and 32 more bits; two that fall together only mean candidates that prove none."""
    return (names >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | names & np.uint64(0xFFFFFFFF)


class _Repeats:
    """A chunk's segments of repeated names: its distinct ones, by index part and fingerprint, and where each occurs."""

    def __init__(self, ids: list, texts: list[bytes], repeated: np.ndarray, hot: np.ndarray, parts: int, length: int):
        self.slices, keys, names, owners = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, own, s in _in_slices(ids, texts, length, parts):
            at = np.minimum(np.searchsorted(repeated, s.name), max(len(repeated) - 1, 0))
            mine = np.flatnonzero(repeated[at] == s.name) if len(repeated) else np.zeros(0, np.int64)
            alone = np.isin(s.name[mine], hot)
            mine, alone = mine[~alone], mine[alone]
            windows = _spread(s.first[alone], s.windows[alone]).astype(np.int64)
            unnamed = np.zeros(len(windows), np.uint64)
            prints = s.prints(windows, np.full(len(windows), length), unnamed) if len(windows) else unnamed
            keys += [s.keys(mine, length), prints]
            names += [s.name[mine], _placed(prints, parts)]
            doc, first = np.concatenate([s.doc[mine], np.repeat(s.doc[alone], s.windows[alone])]), np.concatenate([s.first[mine], windows])
            owners.append(own[doc])
            self.slices.append((a, own, s.data, s.begins, s.ends, doc, first, np.concatenate([s.windows[mine], np.ones(len(windows), np.int64)])))
        keys, names, owners = np.concatenate(keys), np.concatenate(names), np.concatenate(owners)
        data = np.concatenate([np.zeros(0, np.uint8), *(x[2] for x in self.slices)])
        bases = np.cumsum([0, *(len(x[2]) for x in self.slices)])
        first = np.concatenate([np.zeros(0, np.int64), *(x[6] + base for x, base in zip(self.slices, bases))])
        sizes = np.concatenate([np.zeros(0, np.int64), *(x[7] for x in self.slices)]) + length - 1
        #: Of each distinct segment: an occurrence, fingerprint, name and smallest document; of each occurrence its segment.
        self.occurrence, self.number, keys = _distinct(names >> np.uint64(32), keys, owners, first, sizes, data)
        self.key, self.name, self.least = keys[self.occurrence], names[self.occurrence], owners[self.occurrence]
        self.ends = np.searchsorted(self.name >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))

    def texts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the distinct segments, and their bytes side by side."""
        sizes, bodies, at = [np.zeros(0, np.int64)], [], 0
        place = np.argsort(self.occurrence)
        found = self.occurrence[place]
        for _, _, data, _, _, _, first, windows in self.slices:
            low, high = np.searchsorted(found, (at, at + len(first)))
            mine = found[low:high] - at
            sizes.append(windows[mine] + length - 1)
            bodies.append(data[_spread(first[mine], sizes[-1])])
            at += len(first)
        sizes, body = np.concatenate(sizes), np.concatenate([np.zeros(0, np.uint8), *bodies])
        begin = np.cumsum(sizes) - sizes
        back = np.argsort(place)  # from the order of occurrence to that of parts
        return sizes[back], body[_spread(begin[back], sizes[back])]


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... up to each size, one after the other."""
    kind = np.int32 if len(begins) == 0 or max(int(begins.max()), int(sizes.sum())) < 1 << 30 else np.int64
    out = np.repeat((begins - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    out += np.arange(len(out), dtype=kind)
    return out


def _distinct(names: np.ndarray, keys: np.ndarray, least: np.ndarray, begins: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings told apart by name and fingerprint, and equal ones compared by their bytes.

    Returns of each distinct string the place of its least occurrence, in order of name and fingerprint; of each occurrence
    its string's number; and the fingerprints, changed where strings that differ had the same.
    """
    while True:
        order = np.lexsort((least, keys, names))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (names[order][1:] != names[order][:-1])
        mine, number = order[fresh], np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        again = order[~fresh]
        like = mine[number[again]]
        bad = sizes[again] != sizes[like]
        told = np.flatnonzero(~bad & (sizes[again] > 0))
        for a, b in slices(sizes[again[told]].tolist(), SLICE):
            x, y = again[told[a:b]], like[told[a:b]]
            same = data[_spread(begins[x], sizes[x])] == data[_spread(begins[y], sizes[y])]
            bad[told[a:b]] = ~np.logical_and.reduceat(same, np.cumsum(sizes[x]) - sizes[x])
        if not bad.any():
            return mine, number, keys
        keys = keys.copy()
        for k in again[bad].tolist():
            keys[k] ^= np.uint64(int.from_bytes(hashlib.blake2b(data[begins[k] : begins[k] + sizes[k]].tobytes(), digest_size=8).digest(), "little") | 1)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays after their lengths in bytes, pressed."""
    raw = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zlib.compress(np.array([len(raw), *map(len, raw)], "<i8").tobytes() + b"".join(raw), 1)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    at, out = 8 * (n + 1), []
    for size, kind in zip(np.frombuffer(data, "<i8", n, 8).tolist(), kinds):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


def _heavy(names: np.ndarray, sizes: np.ndarray, found: list[Segments], least: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names, in order, whose distinct segments in a chunk have at least so many bytes, and how many; names are sorted, found has them all."""
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
    many = names[first][(np.add.reduceat(sizes, first) >= least) & (np.diff(np.append(first, len(names))) > 1)] if len(first) else names
    if not len(many):
        return many, np.zeros(0, np.int64)
    told = []
    for s in found:
        mine = np.flatnonzero(many[np.minimum(np.searchsorted(many, s.name), len(many) - 1)] == s.name)
        told.append(np.stack([s.name[mine], s.keys(mine, length), (s.windows[mine] + length - 1).astype(np.uint64)]))
    name, key, size = np.concatenate(told, axis=1)
    order = np.lexsort((key, name))
    name, key, size = name[order], key[order], size[order]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (key[1:] != key[:-1])
    total = np.bincount(np.searchsorted(many, name[fresh]), size[fresh].astype(np.int64), len(many)).astype(np.int64)
    return many[total >= least], total[total >= least]


def _hot(names: np.ndarray, count: np.ndarray, heavy: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Of the names that all chunks sent, those of several documents whose segments come to HOT bytes.

    names: sorted, with how often each was sent, at most twice a chunk; heavy: names, once for each chunk that told their bytes there.
    A segment around one key is at most 2 length - KEY bytes long.
    """
    told = np.bincount(np.searchsorted(names, heavy), weight, len(names)).astype(np.int64)
    return names[(count > 1) & (told + count * (2 * length - min(KEY, length)) >= HOT)]


def _owners(names: np.ndarray, least: np.ndarray, sizes: np.ndarray, body: np.ndarray, length: int) -> np.ndarray:
    """For the windows of distinct segments, which lie side by side in the order of their names, the smallest document each.

    Equal windows have equal names, so whole names are indexed together, as many as make some INDEX of bytes.
    """
    windows = sizes - length + 1
    out = np.repeat(least, windows)
    before, begin = np.cumsum(windows) - windows, np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(names)))
    longest = np.maximum.reduceat(sizes, first) if len(first) else first
    groups = np.argsort(longest, kind="stable")  # few long segments don't make the others' ranks dearer
    total = np.add.reduceat(sizes, first) if len(first) else sizes
    for a, b in slices(total[groups].tolist(), INDEX):
        at = _spread(first[groups[a:b]], count[groups[a:b]])
        index = RunLengthIndex([body[begin[k] : begin[k] + sizes[k]].tobytes() for k in at.tolist()])
        owner = index.least(least[at], length)
        out[_spread(before[at], windows[at])] = owner[_spread(index.starts, windows[at])]
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id", output: str = "text") -> DataFrame:
    """docs' texts without each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id.

    Texts are UTF-8 bytes (null: empty), strings don't cross documents, and are judged on the input. Returns for every row
    ``(doc_id, kept binary, spans array<struct<start, end>>)``, spans being the maximal removed runs of bytes, or, for output
    "digest", ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``. Rows of one id don't remove from each other; rows
    without an id come after all others and remove from none. Very long texts are read whole, by one task each. An empty
    table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(shuffles(spark), -(-size // CHUNK))
    tables = max(1, -(-size // NAMES))
    parts = tables * max(NAMES // PART, -(-shuffles(spark) // tables))
    chunk = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(chunks)).cast("int")
    dealt = rows.withColumn("chunk", chunk).repartition(chunks, "chunk")

    def name(group: pa.Table) -> pa.Table:
        """The chunk's names, those of several documents twice, by part of the name table."""
        ids, texts = _documents(group)
        names, owners, sizes, found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for a, _, s in _in_slices(ids, texts, length, parts):
            names.append(s.name)
            owners.append(s.doc + a)
            sizes.append(s.windows + length - 1)
            found.append(s)
        names, owners, sizes = np.concatenate(names), np.concatenate(owners), np.concatenate(sizes)
        order = np.lexsort((owners, names))
        names, owners = names[order], owners[order]
        heavy, weight = _heavy(names, sizes[order], found, max(HOT // chunks, WINDOWS + length), length)
        fresh = np.ones(len(names), bool)
        fresh[1:] = (names[1:] != names[:-1]) | (owners[1:] != owners[:-1])
        names = names[fresh]
        third = np.zeros(len(names), bool)
        third[2:] = names[2:] == names[:-2]
        names = names[~third]
        ends = np.searchsorted(names, np.arange(tables + 1, dtype=np.uint64) * np.uint64(parts // tables) << np.uint64(32))
        full = np.flatnonzero(np.diff(ends))
        blobs = [_tight(names[ends[p] : ends[p + 1]]) for p in full]
        at = np.searchsorted(heavy, np.arange(tables + 1, dtype=np.uint64) * np.uint64(parts // tables) << np.uint64(32))
        weights = [_pack(heavy[at[p] : at[p + 1]], weight[at[p] : at[p + 1]]) for p in full]
        here = [group.column("chunk")[0].as_py()] * len(full)
        return pa.table({"part": pa.array(full, pa.int32()), "chunk": pa.array(here, pa.int32()), "names": pa.array(blobs, pa.binary()), "heavy": pa.array(weights, pa.binary())})

    def repeated(group: pa.Table) -> pa.Table:
        """For each chunk, those of its names that occur in several documents, and which of them are hot."""
        sent = [_loose(x) for x in group.column("names").to_pylist()]
        told, count = np.unique(np.concatenate(sent), return_counts=True)
        heavy, weight = (np.concatenate(x) for x in zip(*(_unpack(x, np.uint64, np.int64) for x in group.column("heavy").to_pylist())))
        hot = _hot(told, count, heavy, weight, length)
        told = np.append(told[count > 1], np.uint64(0xFFFFFFFFFFFFFFFF))  # no name
        back = [x[told[np.searchsorted(told, x)] == x] for x in map(np.unique, sent)]
        burnt = [_tight(x[np.isin(x, hot)]) for x in back]
        return pa.table({"chunk": group.column("chunk"), "names": pa.array([_tight(x) for x in back], pa.binary()), "hot": pa.array(burnt, pa.binary())})

    def names_of(flags: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sent = [[_loose(x) for x in flags.column(c).to_pylist()] for c in ("names", "hot")]
        return tuple(np.sort(np.concatenate([np.zeros(0, np.uint64), *x])) for x in sent)

    def send(group: pa.Table, flags: pa.Table) -> pa.Table:
        """The chunk's distinct segments of repeated names, by index part."""
        repeats = _Repeats(*_documents(group), *names_of(flags), parts, length)
        sizes, body = repeats.texts(length)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        full, blobs = np.flatnonzero(np.diff(repeats.ends)), []
        for a, b in zip(repeats.ends[full], repeats.ends[full + 1]):
            blobs.append(_pack(repeats.name[a:b], repeats.key[a:b], repeats.least[a:b], sizes[a:b].astype(np.int32), body[upto[a] : upto[b]]))
        here = group.column("chunk")[0].as_py() if len(group) else -1
        return pa.table({"part": pa.array(full, pa.int32()), "chunk": pa.array([here] * len(full), pa.int32()), "segments": pa.array(blobs, pa.binary())})

    def index(group: pa.Table) -> pa.Table:
        """For each chunk's segments, in its order, the smallest documents of their windows, in runs."""
        sent = [_unpack(blob, np.uint64, np.uint64, np.int64, np.int32, np.uint8) for blob in group.column("segments").to_pylist()]
        counts = [len(x[0]) for x in sent]
        names, keys, least, sizes, body = (np.concatenate(x) for x in zip(*sent))
        sizes, sent = sizes.astype(np.int64), None
        begin = np.cumsum(sizes) - sizes
        mine, number, _ = _distinct(names, keys, least, begin, sizes, body)
        body = body[_spread(begin[mine], sizes[mine])]
        windows = sizes[mine] - length + 1
        owner = _owners(names[mine], least[mine], sizes[mine], body, length)
        starts = np.cumsum(windows) - windows
        change = np.ones(len(owner), bool)
        change[1:] = owner[1:] != owner[:-1]
        change[starts] = True
        runs = np.flatnonzero(change)
        wide, owner = np.diff(np.append(runs, len(owner))).astype(np.uint16), owner[runs]
        begin = np.searchsorted(runs, starts)
        count = np.diff(np.append(begin, len(runs)))
        blobs, at = [], 0
        for n in counts:
            k = number[at : at + n]
            at += n
            told = _spread(begin[k], count[k])
            blobs.append(_pack(count[k].astype(np.uint16), wide[told], owner[told]))
        return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "owners": pa.array(blobs, pa.binary())})

    def finish(group: pa.Table, answer: pa.Table) -> pa.Table:
        ids, texts = _documents(group)
        repeats = _Repeats(ids, texts, *names_of(answer.filter(answer.column("names").is_valid())), parts, length)
        answer = answer.filter(answer.column("owners").is_valid())
        # of each segment: how many runs of windows it has, and where they begin among all runs
        count, begin = np.zeros(len(repeats.key), np.int64), np.zeros(len(repeats.key), np.int64)
        windows, owners, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for p, blob in zip(answer.column("part").to_pylist(), answer.column("owners").to_pylist()):
            c, w, o = _unpack(blob, np.uint16, np.uint16, np.int64)
            mine = slice(repeats.ends[p], repeats.ends[p + 1])
            count[mine] = c
            begin[mine] = at + np.cumsum(c.astype(np.int64)) - c
            at += len(w)
            windows.append(w.astype(np.int64))
            owners.append(o)
        windows, owners = np.concatenate(windows), np.concatenate(owners)
        before = np.cumsum(windows) - windows
        out, seen = [], 0
        for a, own, _, begins, stops, doc, first, _ in repeats.slices:
            numbers = repeats.number[seen : seen + len(doc)]
            seen += len(doc)
            c = count[numbers]
            k = np.repeat(np.arange(len(numbers)), c)
            run = np.arange(len(k)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[numbers], c)
            bad = owners[run] < own[doc[k]]
            k, run = k[bad], run[bad]
            low = first[k] + before[run] - before[begin[numbers[k]]]
            size = int(stops[-1]) + 1
            edge = np.bincount(low, minlength=size) - np.bincount(low + windows[run] - 1 + length, minlength=size)
            covered = np.cumsum(edge)[:-1] > 0
            touched = set(doc[k].tolist())
            for d in range(len(own)):
                text, spans = texts[a + d], []
                if d in touched:
                    cover = covered[begins[d] : stops[d]]
                    step = np.diff(np.concatenate(([False], cover, [False])).astype(np.int8))
                    spans = list(zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist()))
                    text = np.frombuffer(text, np.uint8)[~cover].tobytes()
                if output == "digest":
                    n = len(texts[a + d])
                    out.append((ids[a + d], n, n - len(text), len(spans), hashlib.sha256(text).hexdigest()))
                else:
                    out.append((ids[a + d], text, [{"start": x, "end": y} for x, y in spans]))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=columns)

    if output == "digest":
        columns, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]
        schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    else:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns, kinds = ["doc_id", "kept", "spans"], [pa.int64(), pa.binary(), span]
        schema = "doc_id long, kept binary, spans array<struct<start:long,end:long>>"
    names = dealt.groupBy("chunk").applyInArrow(name, "part int, chunk int, names binary, heavy binary")
    flags = names.groupBy("part").applyInArrow(repeated, "chunk int, names binary, hot binary").repartition(chunks, "chunk")
    segments = dealt.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(send, "part int, chunk int, segments binary")
    owners = segments.groupBy("part").applyInArrow(index, "chunk int, part int, owners binary")
    answers = flags.select("chunk", "names", "hot", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("owners")).union(
        owners.select("chunk", F.lit(None).cast("binary").alias("names"), F.lit(None).cast("binary").alias("hot"), "part", "owners")
    )
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def _tight(names: np.ndarray) -> bytes:
    """Sorted names as the steps between them, in as few bytes each as the largest needs."""
    steps = np.diff(np.concatenate((names[:1], names))).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + names[:1].astype("<u8").tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _loose(data: bytes) -> np.ndarray:
    width, steps = data[0], np.frombuffer(data, np.uint8, offset=min(9, len(data)))
    wide = np.zeros((len(steps) // width, 8), np.uint8)
    wide[:, :width] = steps.reshape(-1, width)
    first = np.frombuffer(data, "<u8", 1, 1) if len(wide) else np.zeros(1, np.uint64)
    return np.cumsum(wide.view("<u8").ravel()) + first[0]


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), output="digest")


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, 500 * q AS base, substr(h, 1000 * q + 1, {1000 + 2 * (LENGTH - 1)}) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS q FROM d) x
), w AS (
  SELECT doc_id, base + r AS p, md5(substr(part, 2 * r + 1, {2 * LENGTH})) AS s
  FROM (SELECT doc_id, base, part, unnest(range(0, greatest(length(part) // 2 - {LENGTH - 1}, 0))) AS r FROM c) x
), owner AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN owner ON w.s = owner.s AND least < doc_id
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM (
    SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM gone) x
  GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM runs
), told AS (
  SELECT k.doc_id, count(*) AS n, sum(b - a) AS removed, concat(string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a), max(CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END)) AS rest
  FROM kept k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN told ON told.doc_id = d.doc_id
"""
