"""Recall and precision of detected spans against planted ones, by type."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimveil.sources import lexicon as L

from claimveil.operators.spans import PLACES, clusters


def sweep(tolerance: int = 0) -> Callable[[list[tuple], list[tuple]], tuple[list[bool], list[int]]]:
    """A function of one text's planted and detected ``(start, end, type)``, both in order: which planted ones are hit, which detected ones are spare.

    Each planted span takes the first unused detection of its type whose ends are within the tolerance, or else the first unused
    one that overlaps. The time grows with the number of spans: detections of a type and place are looked up, and a chain of those
    still in play skips what is used or lies before all planted spans to come. Made here so that workers need nothing of this package.
    """

    def run(planted: list[tuple], found: list[tuple]) -> tuple[list[bool], list[int]]:
        n = len(found)
        at: dict[tuple, list[int]] = {}
        for i in range(n - 1, -1, -1):
            at.setdefault(found[i], []).append(i)  # the first one last, where it is taken from
        used, after, before = [False] * n, list(range(1, n + 1)) + [0], list(range(-1, n))  # a ring through n, which is no span
        near = range(-tolerance, tolerance + 1)

        def unlink(i: int) -> None:
            after[before[i]], before[after[i]] = after[i], before[i]

        after[n], before[0] = 0, n
        hits = []
        for start, end, kind in planted:
            hit = None
            if tolerance > 3:  # too many places to look up: those that start near enough, in order
                k = bisect.bisect_left(found, (start - tolerance,))
                while k < n and found[k][0] <= start + tolerance:
                    if not used[k] and abs(found[k][1] - end) <= tolerance and found[k][2] == kind:
                        hit = k
                        break
                    k += 1
            else:
                for a in near:
                    for b in near:
                        same = at.get((start + a, end + b, kind))
                        while same and used[same[-1]]:
                            same.pop()
                        if same and (hit is None or same[-1] < hit):
                            hit = same[-1]
            if hit is None:
                i = after[n]
                while i != n and found[i][0] < end:
                    then = after[i]
                    if found[i][1] > start:
                        hit = i
                        break
                    unlink(i)  # it ends before this planted span starts, and so before all later ones
                    i = then
            if hit is not None:
                used[hit] = True
                if before[after[hit]] == hit and after[before[hit]] == hit:
                    unlink(hit)
            hits.append(hit is not None)
        return hits, [i for i in range(n) if not used[i]]

    return run


def settler(tolerance: int, key: str) -> tuple[Callable, Callable]:
    """For tasks: ``numbers`` of rows' clusters, and ``settle``, outcomes of a table ``(key, start, end, type, planted, cluster)`` of whole clusters."""
    run = sweep(tolerance)

    def numbers(keys: pa.Array, cluster: np.ndarray) -> np.ndarray:
        """Rows' clusters, numbered from 0."""
        code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum((np.diff(code) != 0) | (np.diff(cluster) != 0))])

    def settle(t: pa.Table) -> pa.RecordBatch:
        """Outcomes of whole clusters."""
        cluster, start, end, planted = (t.column(c).to_numpy() for c in ("cluster", "start", "end", "planted"))
        g = numbers(t.column(key).combine_chunks(), cluster)
        listed = t.column("type").combine_chunks().dictionary_encode()
        words = listed.dictionary.to_pylist()
        place = np.empty(len(words) + 1, np.int64)
        place[sorted(range(len(words)), key=lambda i: words[i])] = np.arange(len(words))
        place[-1] = -1  # no type
        code = place[listed.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
        order = np.lexsort((code, end, start, g))
        sides = [order[planted[order]], order[~planted[order]]]
        n = [np.bincount(g[x], minlength=g[-1] + 1) for x in sides]
        rank = [np.arange(len(x)) - (np.cumsum(c) - c)[g[x]] for x, c in zip(sides, n)]
        most = np.minimum(*n)
        paired = [r < most[g[x]] for x, r in zip(sides, rank)]
        p, d = (x[y] for x, y in zip(sides, paired))
        near = (np.abs(start[p] - start[d]) <= tolerance) & (np.abs(end[p] - end[d]) <= tolerance) & (code[p] == code[d]) & (code[p] >= 0)
        single = (n[0] == 1) & (n[1] == 1)
        hit = near | (single[g[p]] & (start[d] < end[p]) & (start[p] < end[d]))
        messy = (np.bincount(g[p], weights=~hit, minlength=len(most)) > 0) & ~single
        done = hit & ~messy[g[p]]
        taken = np.zeros(len(g), bool)
        taken[p[done]] = taken[d[done]] = True

        rest = order[messy[g[order]]]
        for part in np.split(rest, np.flatnonzero(np.diff(g[rest])) + 1) if len(rest) else []:
            spans = list(zip(start[part].tolist(), end[part].tolist(), code[part].tolist()))
            held = planted[part]
            own, others = np.flatnonzero(held), np.flatnonzero(~held)
            hits, spare = run([spans[i] for i in own], [spans[i] for i in others])
            taken[part[own]] = hits
            taken[part[others]] = True
            taken[part[others[spare]]] = False
        told = np.flatnonzero(planted | ~taken)
        flags = [planted & taken, planted & ~taken, ~planted]
        rows = t.select([key, "type"]).take(pa.array(told)).combine_chunks().to_batches()
        if not rows:
            return pa.RecordBatch.from_pylist([], schema=pa.schema([t.schema.field(key), t.schema.field("type"), *[(c, pa.int32()) for c in ("tp", "fn", "fp")]]))
        return pa.RecordBatch.from_arrays([*rows[0].columns, *[pa.array(f[told].astype(np.int32)) for f in flags]], names=[key, "type", "tp", "fn", "fp"])

    return numbers, settle


def score_spans(found: DataFrame, truth: DataFrame, tolerance: int = 0, key: str = "note_id") -> DataFrame:
    """``(key, type, tp, fn, fp)``, a row for each planted span and each detected one that matches none; both tables hold ``(key, start, end, type)``.

    Planted and detected spans by (start, end, type); each planted one takes the first unused detection of its type whose ends are within
    the tolerance, or else the first unused one that overlaps. A hit or miss counts for the planted type, a false alarm for the detected.
    Spans that touch each other make a cluster, told by windows in one sort by place; tasks then settle their clusters in batches. Where the
    first planted span fits the first detection of its cluster, the second the second and so on, the order can't bring others together, and
    these and single pairs are settled as columns. Only the other clusters are matched in turn, by ``sweep``. A null key is a text like
    others; spans without a place are left out.
    """
    columns = [key, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type"]
    both = found.select(*columns, F.lit(False).alias("planted")).union(truth.select(*columns, F.lit(True))).where("start is not null and end is not null")
    # detections reach as far as the tolerance; a planted span of no length stands at its place
    low = F.when(F.col("planted"), F.col("start")).otherwise(F.col("start") - tolerance)
    high = F.when(F.col("planted"), F.greatest("end", "start")).otherwise(F.greatest("end", "start") + tolerance + 1)
    numbers, settle = settler(tolerance, key)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches up to their last cluster, which may go on in the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            n = numbers(batch.column(key), batch.column("cluster").to_numpy())
            cut = int(np.searchsorted(n, n[-1]))  # where the last cluster begins
            if held and any(batch.column(c)[0].as_py() != held[-1].column(c)[-1].as_py() for c in (key, "cluster")):
                yield settle(pa.Table.from_batches(held))
                held = []
            if cut:
                yield settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield settle(pa.Table.from_batches(held))

    placed = clusters(both.withColumns({"_from": low, "_to": high}), key, F.col("_from"), F.col("_to"))
    # the windows have dealt the rows by key and put them in this order
    placed = placed.sortWithinPartitions(key, "_from", "_to").select(key, "start", "end", "type", "planted", "cluster")
    return placed.mapInArrow(match, _outcomes(found, key))


def score_lists(found: DataFrame, truth: DataFrame, tolerance: int = 0, key: str = "note_id", spans: str = "spans") -> DataFrame:
    """``score_spans`` of tables ``(key, spans)`` that hold a text's spans in one row: its rows are shuffled, not its spans, and tasks tell clusters in batches.

    Lists of one key, if it has several, are put together, and the spans of one key are held by a task.
    """
    place = lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["type"].alias("type"))

    def side(df: DataFrame, planted: bool) -> DataFrame:
        fits = df.schema[spans].dataType.simpleString() == PLACES
        return df.select(key, (F.col(spans) if fits else F.transform(spans, place)).alias("spans"), F.lit(planted).alias("planted"))

    both = side(found, False).union(side(truth, True))
    _, settle = settler(tolerance, key)

    def flat(t: pa.Table) -> pa.RecordBatch | None:
        """Outcomes of whole keys."""
        lists, keys = t.column("spans").combine_chunks(), t.column(key).combine_chunks()
        own, inner = pc.list_parent_indices(lists), pc.list_flatten(lists)
        rows = pa.table({key: keys.take(own), "planted": t.column("planted").combine_chunks().take(own)} | dict(zip(("start", "end", "type"), inner.flatten())))
        rows = rows.append_column("code", keys.dictionary_encode().indices.fill_null(-1).take(own)).filter(pc.and_(pc.is_valid(rows["start"]), pc.is_valid(rows["end"])))
        if not rows.num_rows:
            return None
        code, start, end, planted = (rows[c].to_numpy() for c in ("code", "start", "end", "planted"))
        code, start, end = code.astype(np.int64), start.astype(np.int64), end.astype(np.int64)
        # as for rows: detections reach as far as the tolerance, and a planted span of no length stands at its place
        low, high = np.where(planted, start, start - tolerance), np.where(planted, np.maximum(end, start), np.maximum(end, start) + tolerance + 1)
        order = np.lexsort((high, low, code))
        base = code[order] * (np.maximum(high.max(), low.max()) - min(low.min(), high.min()) + 1)  # so far apart that no key reaches the next
        far = np.maximum.accumulate(high[order] + base)
        cluster = np.cumsum(np.concatenate([[True], low[order][1:] + base[1:] >= far[:-1]]))
        return settle(rows.take(pa.array(order)).append_column("cluster", pa.array(cluster)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches up to their last key, which may go on in the next."""
        held: list[pa.RecordBatch] = []

        def told(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = flat(pa.Table.from_batches(parts)) if parts else None
            if out is not None:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            cut = int(np.flatnonzero(np.diff(code))[-1]) + 1 if (code != code[-1]).any() else 0  # where the last key begins
            if held and batch.column(key)[0].as_py() != held[-1].column(key)[-1].as_py():
                yield from told(held)
                held = []
            if cut:
                yield from told([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        yield from told(held)

    return both.repartition(key).sortWithinPartitions(key).mapInArrow(match, _outcomes(found, key))


def _outcomes(found: DataFrame, key: str) -> str:
    """Columns of ``score_spans``."""
    return StructType([found.schema[key]]).simpleString()[7:-1].replace(":", " ", 1) + ", type string, tp int, fn int, fp int"


def score_notes(notes: DataFrame, truth: DataFrame, tolerance: int = 0, key: str = "note_id", spans: str = "spans") -> DataFrame:
    """``score_spans`` of notes that carry their detected spans."""
    # an outer generator: for others Spark infers filters on the spans, and would detect again for each of them
    return score_spans(notes.select(key, F.inline_outer(spans)).where("type is not null"), truth, tolerance, key)


def totals(rows: DataFrame) -> DataFrame:
    """Counts, recall and precision of each type and, where ``is_total``, of all types together, from one pass; no rows for no spans.

    The total has no precision: a false alarm costs a word, a miss may tell a person, and the two are never averaged.
    """
    sums = rows.rollup("type").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fn", "fp")], (F.grouping("type") == 1).alias("is_total"))
    n = F.col("tp") + F.col("fn")
    precision = F.when(~F.col("is_total"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    return sums.select("is_total", "type", "tp", "fn", "fp", n.alias("n_truth"), F.try_divide("tp", n).alias("recall"), precision.alias("precision"))


def by_type(rows: DataFrame) -> DataFrame:
    """Counts, recall and precision of each type; null where undefined."""
    sums = rows.groupBy("type").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fn", "fp")])
    n = F.col("tp") + F.col("fn")
    return sums.select("type", "tp", "fn", "fp", n.alias("n_truth"), F.try_divide("tp", n).alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def catalogue(types: DataFrame) -> DataFrame:
    """The catalogue of identifiers, each with what ``by_type`` tells of its types: how many were planted and caught, and recall.

    Identifiers without types, or that weren't planted, have zeros and no recall.
    """
    rows = [(*r, L.SAFE_HARBOR_TYPES.get(r[0], [])) for r in L.SAFE_HARBOR]
    listed = types.sparkSession.createDataFrame(rows, "n int, identifier string, present boolean, detection string, transformation string, residual_risk string, types array<string>")
    told = listed.select("n", F.explode("types").alias("type")).join(types, "type").groupBy("n").agg(F.sum("n_truth").alias("planted"), F.sum("tp").alias("caught"))
    zero = F.lit(0).cast("long")
    out = listed.drop("types").join(F.broadcast(told), "n", "left")  # a row for each identifier
    return out.select(*listed.drop("types").columns, F.coalesce("planted", zero).alias("n_planted"), F.coalesce("caught", zero).alias("n_caught"), F.try_divide("caught", "planted").alias("recall"))


def overall(types: DataFrame) -> DataFrame:
    """All types together: counts and recall; precision and recall are never averaged."""
    sums = types.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fn", "fp", "n_truth")])
    return sums.withColumn("recall", F.try_divide("tp", "n_truth"))
