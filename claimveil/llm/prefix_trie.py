"""The trie of conversations by their first turns, from a sorted stream.

(1) Each turn becomes a digest; conversations are rows of digests. (2) A run is what one task can sort: its distinct sequences in
order, each with the number of turns it shares with the one before (LCP) and only the turns after those, cut at splitters
into ranges. (3) A range merges its slices of all runs by a loser tree that compares no shared turn again, and sends finished nodes from
a stack of open ones. (4) Nodes above a splitter may go on in another range: they leave a range unfinished, and are added up.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship, shuffles, table

#: Bytes of a digest; turns of a splitter at most, and sampled sequences for each range; bytes of digests in a run, and in a range on average.
WIDE, DEEP, SAMPLES, RUN, RANGE = 16, 8, 24, 32 << 20, 16 << 20
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "own binary, above binary, n_bytes long"
)
KINDS = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int64()]
NAMES = [x.split()[0] for x in NODES.split(", ")]
NONE = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns array<struct<digest, n_bytes>>)`` in the order of turn (null first), equal ones by digest; rows without a conv_id go."""
    said = F.coalesce(F.col(text), F.lit("")).cast("binary")
    by = F.coalesce(F.col(role), F.lit("")).cast("binary")
    told = F.concat(F.octet_length(by).cast("string").cast("binary"), F.lit(b":"), by, said)
    digest = F.substring(F.unhex(F.sha2(told, 256)), 1, WIDE)
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes")).alias("t")
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["n_bytes"].alias("n_bytes"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation with its first h turns taken from conversation c - c % every, h = crc32(c) % heads; fewer if that one has fewer."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    mine = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("host"))
    hosts = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("host"), F.slice("turns", 1, heads - 1).alias("first"))
    joined = mine.join(hosts, "host", "left")
    head = F.slice(F.coalesce("first", F.array().cast("array<struct<digest:binary,n_bytes:bigint>>")), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


@dataclass
class Entry:
    """A sequence of a run: its digests, bytes of its turns' texts, and the conversations that are just it; lcp: turns shared with the run's last."""

    digests: bytes
    sizes: np.ndarray
    convs: np.ndarray
    lcp: int = 0

    def __len__(self) -> int:
        return len(self.sizes)


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Number of turns that two sequences share; the first ``start`` are known to be the same."""
    most = min(len(a), len(b)) // WIDE
    step = 1
    while start < most:  # wider and wider steps, then narrow ones
        end = min(most, start + step)
        if a[start * WIDE : end * WIDE] == b[start * WIDE : end * WIDE]:
            start, step = end, 2 * step
        elif end == start + 1:
            break
        else:
            step = 1 if step == 2 else step // 4 or 1
    return start


def sorted_run(rows: list[tuple[bytes, np.ndarray, int]]) -> list[Entry]:
    """Distinct sequences in order, each with its conversations in order and what it shares with the one before."""
    out: list[Entry] = []
    for digests, sizes, conv in sorted(rows, key=lambda r: (r[0], r[2])):
        if out and out[-1].digests == digests:
            out[-1].convs.append(conv)
        else:
            out.append(Entry(digests, sizes, [conv], shared(out[-1].digests, digests) if out else 0))
    for e in out:
        e.convs = np.array(e.convs, np.int64)
    return out


class LoserTree:
    """Merges runs of entries in order. A player's lcp is what it shares with the last winner, so of two players the one that shares
    more comes first, and only those that share as much are compared, from there on."""

    def __init__(self, runs: list[Iterator[Entry]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[Entry | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.lcp = [0] * self.size
        self.losers = [0] * self.size
        self.compared = 0
        winners = {self.size + k: k for k in range(self.size)}
        for at in range(self.size - 1, 0, -1):
            winners[at], self.losers[at] = self._play(winners[2 * at], winners[2 * at + 1])
        self.best = winners[1]

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """Winner and loser, the loser's lcp being with the winner from now on."""
        a, b = self.heads[x], self.heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if self.lcp[x] != self.lcp[y]:
            return (x, y) if self.lcp[x] > self.lcp[y] else (y, x)
        start = self.lcp[x]
        n = shared(a.digests, b.digests, start)
        self.compared += n - start + 1
        at = n * WIDE
        if a.digests[at : at + WIDE] > b.digests[at : at + WIDE] or (a.digests[at:] == b.digests[at:] and x > y):
            x, y = y, x
        self.lcp[y] = n
        return x, y

    def __iter__(self) -> Iterator[tuple[Entry, int]]:
        """Entries in order, and what each shares with the one before."""
        while (entry := self.heads[self.best]) is not None:
            player = self.best
            yield entry, self.lcp[player]
            self.heads[player] = next(self.runs[player], None)
            self.lcp[player] = self.heads[player].lcp if self.heads[player] else 0
            at = (self.size + player) // 2
            while at:
                player, self.losers[at] = self._play(player, self.losers[at])
                at //= 2
            self.best = player


@dataclass
class Open:
    """A node whose members are still coming."""

    n_bytes: int
    border: bool
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[np.ndarray] = field(default_factory=list)
    below: list[list] = field(default_factory=list)


def ends_digest(convs: list[np.ndarray]) -> str:
    """SHA-256 of all ids in ascending order, comma-joined, made piece by piece."""
    digest, held, first = hashlib.sha256(), [], True
    for c in heapq.merge(*(x.tolist() for x in convs)):
        held.append(str(c))
        if len(held) == 8192:
            digest.update((("" if first else ",") + ",".join(held)).encode())
            held, first = [], False
    if held:
        digest.update((("" if first else ",") + ",".join(held)).encode())
    return digest.hexdigest()


def nodes(stream: Iterator[tuple[Entry, int]], borders: set[bytes]) -> Iterator[list]:
    """Rows of NODES for a sorted stream. Nodes in ``borders`` carry their own sequence and what is theirs alone; others are finished,
    those right below a border with that one's sequence as ``above``."""
    stack: list[Open] = []
    path = b""

    def close() -> Iterator[list]:
        node, depth = stack.pop(), len(stack)
        if not node.border:
            node.saved += (node.n - 1) * node.n_bytes
            node.leaves += not node.children
        row = [node.least, depth, None, node.n, node.children, node.leaves, node.saved, ends_digest(node.ends) if node.ends else NONE, path[: depth * WIDE] if node.border else None, None, node.n_bytes]
        if not node.border:
            for r in node.below:
                r[2] = node.least
                yield r
        if stack:
            up = stack[-1]
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
            if not node.border:
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
                if up.border:
                    row[9] = path[: (depth - 1) * WIDE]
                else:
                    up.below.append(row)
                    return
        yield row

    for entry, lcp in stream:
        while len(stack) > lcp + 1:
            yield from close()
        path = entry.digests
        for depth in range(len(stack), len(entry) + 1):
            stack.append(Open(int(entry.sizes[depth - 1]) if depth else 0, path[: depth * WIDE] in borders))
        top = stack[-1]
        if len(entry.convs):
            top.n += len(entry.convs)
            top.least = int(entry.convs[0]) if top.least is None else min(top.least, int(entry.convs[0]))
            top.ends.append(entry.convs)
    while stack:
        yield from close()


def _cut_run(entries: list[Entry], splitters: list[bytes]) -> Iterator[tuple[int, list[Entry]]]:
    """The run's entries by range."""
    begin = 0
    for k in range(len(splitters) + 1):
        end = begin
        while end < len(entries) and (k == len(splitters) or entries[end].digests < splitters[k]):
            end += 1
        if end > begin:
            yield k, entries[begin:end]
        begin = end


def prefix_trie(sequences: DataFrame, conv_id: str = "conv_id", turns: str = "turns") -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``, a row for each distinct beginning.

    sequences: a row for each conversation, with its turns as ``array<struct<digest, n_bytes>>``. A conversation without turns is a
    member of the root alone. Conversations of equal turns share all nodes; ids that repeat count each time. A task holds one conversation's digests,
    and the ids of those conversations that are equal turn for turn, which are hashed in order piece by piece. An empty table gives none.
    """
    spark = sequences.sparkSession
    ship(spark)
    digests, sizes = F.transform(F.col(turns), lambda x: x["digest"]), F.transform(F.col(turns), lambda x: x["n_bytes"])
    rows = cut(sequences.select(F.col(conv_id).alias("conv_id"), digests.alias("digests"), sizes.alias("sizes")))
    told = rows.agg(F.sum(F.size("digests") * (WIDE + 8) + 16).alias("bytes"), F.count("*").alias("n")).first()
    ranges = max(1, shuffles(spark), -(-(told.bytes or 0) // RANGE))
    splitters = _splitters(rows, told.n, ranges)
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            nonlocal number
            out = []
            for k, mine in _cut_run(sorted_run(held), splitters):
                mine[0].lcp = 0
                tails = [e.digests[e.lcp * WIDE :] for e in mine]
                out.append((k, number, [e.lcp for e in mine], tails, [e.sizes[e.lcp :].tobytes() for e in mine], [e.convs.tobytes() for e in mine]))
            number += 1
            held.clear()
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int32())] + [pa.list_(pa.binary())] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 6, kinds)], ["range", "run", "lcp", "digests", "sizes", "convs"])

        for b in batches:
            for conv, digests, sizes in zip(*(b.column(k).to_pylist() for k in range(3))):
                held.append((b"".join(digests), np.array(sizes, np.int64), conv))
                size += len(digests) * (WIDE + 8) + 64
                if size >= RUN:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        def run(lcps, tails, sizes, convs) -> Iterator[Entry]:
            digests, lengths = b"", np.zeros(0, np.int64)
            for lcp, tail, size, ids in zip(lcps, tails, sizes, convs):
                digests, lengths = digests[: lcp * WIDE] + tail, np.concatenate((lengths[:lcp], np.frombuffer(size, np.int64)))
                yield Entry(digests, lengths, np.frombuffer(ids, np.int64), lcp)

        k = group.column("range")[0].as_py()
        near = splitters[max(0, k - 1) : k + 1]  # a node with members on both sides of any splitter is above one of the range's own two
        borders = {s[: d * WIDE] for s in near for d in range(len(s) // WIDE + 1)} | {b""}
        slices = [run(*r) for r in zip(*(group.column(c).to_pylist() for c in ("lcp", "digests", "sizes", "convs")))]
        out = list(nodes(LoserTree(slices), borders))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * len(KINDS), KINDS)], names=NAMES)

    sliced = rows.mapInArrow(runs, "range int, run long, lcp array<int>, digests array<binary>, sizes array<binary>, convs array<binary>")
    found = cut(sliced.groupBy("range").applyInArrow(merge, NODES))
    return _joined(found)


def _splitters(rows: DataFrame, n: int, ranges: int) -> list[bytes]:
    """Beginnings of at most DEEP turns that part the sequences into about so many ranges, from a sample of at most twice SAMPLES for each range."""
    if ranges == 1 or not n:
        return []
    share = max(1, n // (SAMPLES * ranges))
    first = F.array_join(F.transform(F.slice("digests", 1, DEEP), lambda x: F.hex(x)), "")
    sample = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(share)) == 0).select(first.alias("s")).limit(2 * SAMPLES * ranges).collect()
    told = sorted(bytes.fromhex(r.s) for r in sample)
    return sorted({told[k * len(told) // ranges] for k in range(1, ranges)} - {b""}) if told else []


def _joined(found: DataFrame) -> DataFrame:
    """Finished nodes, and those above splitters put together from all ranges."""
    columns = NAMES[:8]
    whole = found.where("own is null")
    total = lambda c: F.sum(c).alias(c)
    border = found.where("own is not null").groupBy("own").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"),
        F.max(F.nullif("ends_sha256", F.lit(NONE))).alias("ends_sha256"), F.first("n_bytes").alias("n_bytes"),
    )
    border = cut(border.withColumn("above", F.when(F.col("depth") > 0, F.substring(F.col("own"), F.lit(1), (F.col("depth").cast("int") - 1) * WIDE))))
    kids = border.where("depth > 0").groupBy(F.col("above").alias("own")).agg(F.count("*").alias("kids"))
    border = border.join(kids, "own", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    leaves = F.col("n_leaves") + (F.col("n_children") == 0).cast("long")
    border = cut(border.withColumns({"n_leaves": leaves, "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")}))
    over = border.select(F.explode(F.sequence(F.lit(0), F.col("depth").cast("int"))).alias("d"), "own", "n_leaves", "saved_tokens")
    sums = over.groupBy(F.substring(F.col("own"), F.lit(1), F.col("d") * WIDE).alias("own")).agg(total("n_leaves"), total("saved_tokens"))
    least = border.select(F.col("own").alias("above"), F.col("conv_id").alias("up"))
    ends = F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")
    upper = border.drop("n_leaves", "saved_tokens").join(sums, "own").join(least, "above", "left").select("conv_id", "depth", F.col("up").alias("parent_conv_id"), *columns[3:7], ends)
    lower = whole.join(least, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(*columns)
    return upper.unionByName(lower)


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


#: crc32 of conv_id's decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, '')))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS host, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t) x
), have AS (
  SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
), r AS (
  SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.host AND t.i <= h
  UNION ALL
  SELECT c.conv_id, t.i - h + least(h, coalesce(n, 0)), t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h LEFT JOIN have ON have.conv_id = host
), one AS (
  SELECT conv_id, i, octet_length(encode(text)) AS b, md5(concat(octet_length(encode(role)), ':', role, text)) AS m FROM r
), p AS (
  SELECT conv_id, i AS depth, b, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY i)) AS k FROM one
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), q AS (
  SELECT conv_id, depth, b, k, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(k) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM p
), node AS (
  SELECT k, depth, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n, any_value(b) AS b,
         sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM q GROUP BY k, depth
), kids AS (
  SELECT up AS k, count(*) AS n FROM node WHERE depth > 0 GROUP BY up
), own AS (
  SELECT node.*, coalesce(kids.n, 0) AS n_children, (node.n - 1) * b AS saved FROM node LEFT JOIN kids ON kids.k = node.k
), below AS (
  SELECT a.k, sum(CASE WHEN own.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own.saved) AS saved
  FROM own JOIN p x ON x.k = own.k AND x.depth = own.depth AND x.conv_id = own.conv_id JOIN p a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY a.k
)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, CAST(own.n AS BIGINT) AS n_convs, CAST(own.n_children AS BIGINT) AS n_children,
       CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN below ON below.k = own.k LEFT JOIN own parent ON parent.k = own.up AND own.depth > 0
"""
