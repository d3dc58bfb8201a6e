"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact cosine.

Coarse centroids and codebooks are fitted on at most ``SAMPLE`` distinct vectors; all are indexed. Each distinct vector is a
member of its nearest list, by the codes of what its centroid leaves, and looks into every list that can hold a link: angles
obey the triangle inequality, so a link's angle to the centroid is within the limit's angle of one's own, and a list is left
out only if none of its members' angles is. In a list a table of a vector's products with all codewords estimates cosines to
members by looking up their codes. A code's error is known exactly when it is made, so an estimate below the limit by more
than that error can't hide a link; all others are computed in full. No link is lost. Neighbouring lists are bundled to some
``BLOCK`` members, longer ones split; two bundles are a task's small group, where only vectors that look into the other
bundle go, and only counts and a spanning forest of the links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Forest, cut, packed, ship, table
from .components import connected_components

SAMPLE = 20_000
LISTS = 4096
SUBSPACES, WORDS = 8, 256
#: Members of a bundle of lists at most, and pairs that are looked at together.
BLOCK, PAIRS = 16384, 1 << 19
#: What rounding may add to an angle, and to an estimate in single precision.
SLACK, ROUNDING = 1e-6, 1e-5


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """At most k centroids; an empty one is put on a random row."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers, 1)[:, 0]
        count = np.bincount(near, minlength=len(centers))
        for d in range(x.shape[1]):
            centers[:, d] = np.bincount(near, x[:, d], len(centers)) / np.maximum(count, 1)
        centers[count == 0] = x[rng.integers(0, len(x), int((count == 0).sum()))]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each row, nearest first."""
    out = np.zeros((len(x), n), np.int64)
    size = (centers**2).sum(1)
    for a in range(0, len(x), 4096):
        far = size - 2 * (x[a : a + 4096] @ centers.T)
        if n == 1:
            out[a : a + 4096, 0] = far.argmin(1)
        else:
            few = np.argpartition(far, n - 1, axis=1)[:, :n]
            out[a : a + 4096] = np.take_along_axis(few, np.take_along_axis(far, few, 1).argsort(1, kind="stable"), 1)
    return out


class Index:
    """Coarse centroids and codebooks, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centers = k_means(sample, lists)
        size = np.sqrt((self.centers**2).sum(1, keepdims=True))
        self.axes = self.centers / np.where(size > 0, size, 1)
        rest = sample - self.centers[nearest(sample, self.centers, 1)[:, 0]]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.words = [k_means(rest[:, p], WORDS, seed=1 + i) for i, p in enumerate(self.parts)]

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and how long the difference is that they leave."""
        rest = x - self.centers[home]
        codes = np.stack([nearest(rest[:, p], w, 1)[:, 0] for p, w in zip(self.parts, self.words)], 1)
        for k, (p, w) in enumerate(zip(self.parts, self.words)):
            rest[:, p] -= w[codes[:, k]]
        return codes.astype(np.uint8), np.sqrt((rest**2).sum(1))

    def angles(self, x: np.ndarray, lists: slice | int = slice(None)) -> np.ndarray:
        """Angles between unit vectors and centroids."""
        return np.arccos(np.clip(x @ self.axes[lists].T, -1, 1))

    def estimates(self, queries: np.ndarray, center: int, codes: np.ndarray) -> np.ndarray:
        """Products of each coded member of a list with each query, in single precision; whole rows of the tables are added."""
        out = np.repeat((queries @ self.centers[center]).astype(np.float32)[None], len(codes), 0)
        for k, (p, w) in enumerate(zip(self.parts, self.words)):
            out += (w @ queries[:, p].T).astype(np.float32)[codes[:, k]]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def bundles_of(index: Index, counts: np.ndarray, block: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Lists in bundles of at most so many members, a longer list in several of its own; each list's first bundle and number of them."""
    around = k_means(index.centers, max(1, int(np.sqrt(len(counts)))))
    bundles, size = [], block
    first, pieces = np.zeros(len(counts), np.int64), np.maximum(-(-counts // block), 1)
    for name in np.argsort(nearest(index.centers, around, 1)[:, 0], kind="stable").tolist():
        if not counts[name]:
            continue
        if size + counts[name] > block:
            bundles += [[] for _ in range(pieces[name])]
            size = 0
        first[name] = len(bundles) - pieces[name]
        for k in range(first[name], len(bundles)):
            bundles[k].append(name)
        size += counts[name]
    return bundles, first, pieces


def hits_in(index: Index, center: int, x: np.ndarray, y: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which rows of x and members y of one list have an exact cosine of at least the limit, as ``(rows, members, matrix)`` pieces."""
    reach = np.arccos(np.clip(limit, -1, 1)) + SLACK
    far, near = index.angles(x, center), index.angles(y, center)
    rows, members = np.argsort(far, kind="stable"), np.argsort(near, kind="stable")
    far, near = far[rows], near[members]
    codes, error = index.codes(y[members], np.full(len(y), center))
    a, stop = np.searchsorted(far, (near[0] - reach, near[-1] + reach))
    while a < stop:
        low, b = np.searchsorted(near, far[a] - reach), min(stop, a + max(1, PAIRS // len(y)))
        high = np.searchsorted(near, far[b - 1] + reach, side="right")
        if high > low:
            i, j = rows[a:b], members[low:high]
            least = (limit - ROUNDING - error[low:high]).astype(np.float32)
            hit = np.ascontiguousarray((index.estimates(x[i], center, codes[low:high]) >= least[:, None]).T)
            if hit.mean() > 0.02:
                product = x[i] @ y[j].T
                open_ = hit & (np.abs(product - limit) < 1e-12)  # the order of adding may decide
                hit &= product >= limit
            else:
                open_ = hit
            k, m = np.nonzero(open_)
            for c in range(0, len(k), 65536):
                kc, mc = k[c : c + 65536], m[c : c + 65536]
                hit[kc, mc] = np.einsum("ij,ij->i", x[i[kc]], y[j[mc]]) >= limit
            if hit.any():
                yield i, j, hit
        a = b


def near_duplicates(vectors: DataFrame, limit: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of vectors.

    Rows link where the cosine in double precision is at least the limit. n_links counts the other rows linked directly,
    copies each for itself; component_id is the smallest id reachable; kept: it is the row's own. Rows without an id, and
    vectors that are null, empty, zero or hold a null or non-finite component, link with nothing. Vectors link with those of
    their own length alone; each length is indexed by itself, so there should be few. Repeated rows are rows of their own. An
    empty table gives none. Other columns are not read.
    """
    e = F.col("embedding")
    whole = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size(e) > 0)
        & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(e, lambda c: c != 0),
        F.lit(False),
    )
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).withColumn("whole", whole)
    lone = rows.where(~F.col("whole")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = cut(rows.where("whole").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    sizes = {r.size: r.n for r in classes.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).collect()}  # a row for each length
    kind = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    told = [_linked(classes.where(F.size("embedding") == size) if len(sizes) > 1 else classes, n, limit, kind) for size, n in sorted(sizes.items())]
    if told:
        linked = rows.where("whole").join(cut(reduce(DataFrame.union, told)), "embedding").select("vec_id", "n_links", "component_id")
        lone = linked.union(lone)
    return lone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(classes: DataFrame, n: int, limit: float, kind: str) -> DataFrame:
    """``(embedding, n_links, component_id)`` of n distinct vectors of one length, ``(embedding, id, copies)``."""
    spark = classes.sparkSession
    most = SAMPLE / n
    few = classes.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, most) * (1 << 30))).orderBy("id").select("embedding").toArrow()
    if not len(few):
        few = classes.orderBy("id").limit(SAMPLE).select("embedding").toArrow()
    sample = _unit(np.array(few.column(0).to_pylist(), np.float64))
    ship(spark)
    sent = spark.sparkContext.broadcast(Index(sample, int(min(LISTS, max(1, np.sqrt(n))))))  # 4,096 centroids at most
    reach = np.arccos(np.clip(limit, -1, 1)) + SLACK

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            if len(b):
                x = _unit(np.array(b.column(0).to_pylist(), np.float64))
                home = nearest(x, index.centers, 1)[:, 0]
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, index.axes[home]), -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(home, pa.int32()), pa.array(angle), b.column(0)], ["id", "copies", "home", "angle", "embedding"])

    assigned = cut(classes.mapInArrow(assign, "id long, copies long, home int, angle double, embedding array<double>"))
    lists = len(sent.value.centers)
    counts, low, high = np.zeros(lists, np.int64), np.full(lists, np.inf), np.full(lists, -np.inf)
    for r in assigned.groupBy("home").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect():  # a row for each list
        counts[r.home], low[r.home], high[r.home] = r.n, r.low - reach, r.high + reach
    bundles, first, pieces = bundles_of(sent.value, counts, min(BLOCK, max(2048, n // 8)))
    held, begins = np.concatenate(bundles), np.cumsum([0, *map(len, bundles[:-1])])

    def record(dim: int) -> np.dtype:
        return np.dtype([("id", "<i8"), ("copies", "<i8"), ("home", "<i4"), ("x", kind, (dim,))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                x = np.array(b.column(4).to_pylist(), np.float64)
                all_rows = np.zeros(len(b), record(x.shape[1]))
                all_rows["id"], all_rows["copies"], all_rows["home"], all_rows["x"] = np.array(b.column(0)), np.array(b.column(1)), np.array(b.column(2)), x
                angles = sent.value.angles(_unit(x))
                looks = np.logical_or.reduceat(((angles >= low) & (angles <= high))[:, held], begins, axis=1)
                spread = (all_rows["id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = first[all_rows["home"]] + (spread % pieces[all_rows["home"]].astype(np.uint64)).astype(np.int64)
                keys, blobs = [], []
                for mine in np.unique(own).tolist():
                    here = own == mine
                    for other in np.flatnonzero(looks[here].any(0)).tolist():
                        keys.append((min(mine, other), max(mine, other), int(mine > other)))
                        blobs.append(all_rows[here & looks[:, other]])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in zip(*keys)), packed(blobs)], ["low", "high", "side", "rows"])

    def look(group: pa.Table) -> pa.Table:
        index, alone = sent.value, group.column("low")[0] == group.column("high")[0]
        rows, sides, blobs = record(index.centers.shape[1]), group.column("side").to_pylist(), group.column("rows").to_pylist()
        p, m = (np.concatenate([np.zeros(0, rows), *(np.frombuffer(r, rows) for r, k in zip(blobs, sides) if k == side)]) for side in (0, 0 if alone else 1))
        x, y = _unit(p["x"].astype(np.float64)), _unit(m["x"].astype(np.float64))
        ids, where = np.unique(np.concatenate([p["id"], m["id"]]), return_inverse=True)
        of_p, of_m = where[: len(p)], where[len(p) :]
        forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
        for name in np.unique(m["home"]).tolist() if len(p) else ():
            mine = np.flatnonzero(m["home"] == name)
            for i, j, hit in hits_in(index, name, x, y[mine], limit):
                j = mine[j]
                if alone:  # a pair counts once
                    hit &= p["id"][i][:, None] < m["id"][j]
                links[of_p[i]] += hit @ m["copies"][j]
                links[of_m[j]] += p["copies"][i] @ hit
                k, o = np.nonzero(hit & (forest.find(of_p[i])[:, None] != forest.find(of_m[j])))
                forest.join(of_p[i[k]], of_m[j[o]])
        told = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[told], pa.int64()), "root": pa.array(ids[forest.roots()[told]], pa.int64()), "links": pa.array(links[told], pa.int64())})

    groups = assigned.mapInArrow(deal, "low int, high int, side int, rows binary").groupBy("low", "high")
    found = cut(groups.applyInArrow(look, "id long, root long, links long"))
    sets = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.join(counts, "id", "left").join(sets.withColumnRenamed("node", "id"), "id", "left")
    return told.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def op10_pq_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(r.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least r ON r.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
