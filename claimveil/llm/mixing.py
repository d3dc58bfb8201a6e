"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

A document of a source is expected to be taken in proportion to the square root of its words, and MOST times at most; the
scale is the one at which the source's expected words are its target. The whole part of that number are certain copies; the
rest is the document's own inclusion probability for one more. Within strata of a source, documents whose sizes differ by an
eighth at most, a fixed number is taken: the probabilities' sum, rounded up or down by a random number of the stratum's own.
Each document draws a number from a hash of its id, and the first by random odds divided by inclusion odds are taken. As
sizes hardly differ in a stratum, a fixed number of documents is nearly a fixed number of words, and the words that rounding
leaves over pass on to the next shorter documents, so that a source ends within about one short document of its target. A stratum
takes no more words than its source's shorter documents can save, and no fewer than they can add, up to SLACK of the target; that only
binds in small sources.

No source or stratum is ever sorted as a whole: ranks are cut into narrow bins and counted, and only the bin in which a
stratum's last document falls is put in order. Probabilities are counted in units of 1 / ONE, so sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
BINS = 4096
#: Units of a probability, and of a document's weight.
ONE, UNIT = 1 << 30, 1024
#: Share of a source's target that a stratum's rounding may miss it by for good.
SLACK = 0.02
#: Sources, or strata, up to this number are sent to all executors (some 100 bytes each); beyond it they are joined by a shuffle.
SENT = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: weights repeat over sources by code point, null last.

    Sources share all words by weight, and none gets over ``most`` times its size; what one can't take is shared again by
    weight. Filled in order of size by weight, the first k sources are full and the others get the same share for each unit
    of weight, where k is the smallest number for which no further source would be over its limit.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    named = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    named = named.withColumns({"weight": weight, "limit": most * F.col("source_size")})
    filling = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, every = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double") / left
    leveled = named.withColumns({"share": share, "open": F.col("limit") >= F.col("weight") * share})
    level = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), "place", "share"))).over(Window.partitionBy())
    leveled = leveled.withColumns({"level": level["share"], "first": level["place"], "full_to": level["col1"]})
    full = (F.col("limit") / F.col("weight") < F.col("full_to")) | ((F.col("limit") / F.col("weight") == F.col("full_to")) & (F.col("place") < F.col("first")))
    got = F.when(F.col("first").isNull() | full, F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return leveled.select("source", "source_size", got.alias("target"))


def uniform(*cols: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the values alone: 52 bits of the md5 of their text."""
    text = F.concat_ws(":", F.lit(seed), *cols)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def weight_of(size: Column) -> Column:
    """A document's weight by its words: their square root, as a whole number."""
    return F.floor(F.sqrt(size.cast("double")) * UNIT).cast("long")


def stratum_of(size: Column) -> Column:
    """Sizes that share their highest bit and the three after it."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.floor(size * 8 / F.pow(F.lit(2.0), (bits - 1).cast("double")))).cast("int")


def scales(sized: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """``(s, scale)``: what a source's weights are multiplied by, so that expected words are its target; null: all at the most.

    sized: ``(source, size, n)``. The longest documents reach the most first; the scale is that of the first size that
    doesn't. A source has d sizes only if it has d (d + 1) / 2 words, so its rows here are few.
    """
    one = Window.partitionBy("source")
    upto = one.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.col("size") * F.col("n")
    full = (F.sum(words).over(one) - F.sum(words).over(upto)).cast("double")
    rest = F.sum((F.col("size") * F.col("g")).cast("decimal(18,0)") * F.col("n")).over(upto).cast("double")
    weighed = sized.where("size > 0").withColumn("g", weight_of(F.col("size")))
    weighed = weighed.join(plan.select("s", "target"), weighed.source.eqNullSafe(plan.s)).withColumn("scale", (F.col("target") - most * full) / rest)
    found = weighed.groupBy("s").agg(F.max(F.when(F.col("scale") * F.col("g") < most, F.struct("size", "scale"))).alias("first"))
    return found.select(F.col("s").alias("scaled"), F.col("first.scale").alias("scale"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies, expected)`` for every row of docs.

    size: words of the text (null and empty: 0); source_size: words of its source; target: the words the source should
    give; copies: how many times the mix takes the row; taken: copies times size; expected: copies over all seeds. A null
    source is a source of its own. Rows without words give none and aren't taken. Repeated rows draw the same number and are
    ranked side by side; rows without a doc_id draw by their text. Very long texts count whole. An empty table gives none.
    Other columns are not read.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string")))
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), uniform(key, seed=seed).alias("u")))
    sized = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    plan = cut(targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most).withColumnRenamed("source", "s"))
    scaled = scales(sized, plan, most)
    plan = cut(plan.join(scaled, plan.s.eqNullSafe(scaled.scaled), "left").drop("scaled"))
    few = plan.count()
    send = F.broadcast if few <= SENT else (lambda x: x)

    def expect(df: DataFrame) -> DataFrame:
        """df with its source's plan, expected copies, certain ones, and units of the probability of one more."""
        told = F.when(F.col("size") == 0, 0.0).when(F.col("scale").isNull(), float(most)).otherwise(F.least(F.lit(float(most)), F.col("scale") * weight_of(F.col("size"))))
        df = df.join(send(plan), df.source.eqNullSafe(plan.s)).withColumn("expected", told)
        return df.withColumns({"certain": F.floor("expected"), "units": F.floor((F.col("expected") - F.floor("expected")) * ONE), "stratum": stratum_of(F.col("size"))})

    units, words = F.col("units").cast("decimal(20,0)") * F.col("n"), (F.col("units") * F.col("size")).cast("decimal(24,0)") * F.col("n")
    strata = expect(sized).where("units > 0").groupBy("source", "stratum").agg(F.sum(units).cast("double").alias("m"), F.sum(words).alias("words"), F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("all"), (F.max("target") * SLACK).alias("slack"))
    shorter = Window.partitionBy("source").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    below = {"w": F.col("words").cast("double"), "due": F.coalesce(F.sum("words").over(shorter), F.lit(0)).cast("double"), "room": F.coalesce(F.sum("all").over(shorter), F.lit(0)).cast("double")}
    strata = strata.withColumns(below)
    strata = strata.withColumn("turn", uniform(F.lit("round"), F.coalesce("source", F.lit("")), F.col("stratum").cast("string"), seed=seed))
    # some 500 strata a source at most, whatever its rows
    listed = strata.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("stratum", "m", "w", "n", "turn", "due", "room", "slack")), False).alias("strata"))

    def fix(state: Column, x: Column) -> Column:
        each, owed = x["w"] / x["m"], state["owed"] + x["w"]
        # no more than all shorter documents can make up for by staying out, no fewer than they can by going in, but for a little
        high, low = F.floor(((owed + x["due"]) / ONE + x["slack"]) / each), F.ceil((owed / ONE - x["room"] - x["slack"]) / each)
        n = F.greatest(F.lit(0), F.least(x["n"], high, F.greatest(low, F.floor(owed / ONE / each + x["turn"]))))
        return F.struct((owed - n * each * ONE).alias("owed"), F.array_append(state["fixed"], F.struct(x["stratum"].alias("stratum"), n.alias("fixed"))).alias("fixed"))

    none = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<stratum:int,fixed:long>>").alias("fixed"))
    strata = listed.select(F.col("source").alias("fs"), F.inline(F.aggregate("strata", none, fix, lambda x: x["fixed"]))).withColumnRenamed("stratum", "fk")
    odds = F.col("units") / (ONE - F.col("units"))
    ranked = expect(rows).withColumn("rank", F.when(F.col("units") > 0, F.col("u") / (1 - F.col("u")) / odds))
    # the last one taken has a rank near 1, where bins are narrowest
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))
    counts = ranked.where("rank is not null").groupBy("source", "stratum", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    cuts = cut(
        counts.join(strata, counts.source.eqNullSafe(strata.fs) & (F.col("stratum") == F.col("fk")))
        .where((F.col("before") < F.col("fixed")) & (F.col("before") + F.col("n") >= F.col("fixed")))
        .select("fs", "fk", F.col("bin").alias("cut"), (F.col("fixed") - F.col("before")).alias("left"))
    )
    send_cuts = F.broadcast if few <= SENT and cuts.count() <= SENT else (lambda x: x)
    placed = ranked.join(send_cuts(cuts), ranked.source.eqNullSafe(cuts.fs) & (F.col("stratum") == F.col("fk")), "left")
    at_cut = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    order = F.row_number().over(Window.partitionBy("fs", "fk").orderBy("rank", "doc_id", "size"))
    edge = placed.where(at_cut).withColumn("more", (order <= F.col("left")).cast("int"))
    other = placed.where(~at_cut).withColumn("more", F.coalesce(F.col("bin") < F.col("cut"), F.lit(False)).cast("int"))
    copies = (F.col("certain") + F.col("more")).cast("long")
    return other.union(edge).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "expected")


def op6_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), placed AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s
), w AS (
  SELECT *, [5, 2, 1][CAST(place % 3 + 1 AS INTEGER)] AS weight, 3 * source_size AS most,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM placed
), f AS (
  SELECT *, most / weight AS r,
         CAST(total - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
  FROM w
), l AS (
  SELECT r, place, share FROM f WHERE most >= weight * share ORDER BY r, place LIMIT 1
), t AS (
  SELECT f.source, f.source_size,
         CASE WHEN l.place IS NULL OR f.r < l.r OR (f.r = l.r AND f.place < l.place) THEN CAST(f.most AS DOUBLE) ELSE f.weight * l.share END AS target
  FROM f LEFT JOIN l ON TRUE
), h AS (
  SELECT source, size, count(*) AS n, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1024) AS HUGEINT) AS g FROM d WHERE size > 0 GROUP BY source, size
), k AS (
  SELECT h.source, size, g, (target - 3 * CAST(coalesce(sum(size * n) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(size * g * n) OVER (PARTITION BY h.source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS scale
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT source, arg_max(scale, size) AS scale FROM k WHERE scale * CAST(g AS DOUBLE) < 3 GROUP BY source
), e AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN size = 0 THEN 0.0 WHEN scale IS NULL THEN 3.0 ELSE least(3.0, scale * floor(sqrt(CAST(size AS DOUBLE)) * 1024)) END AS expected,
         length(bin(size)) * 16 + CAST(floor(size * 8 / pow(2, length(bin(size)) - 1)) AS INTEGER) AS stratum,
         (CAST(('0x' || substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
), p AS (
  SELECT *, floor(expected) AS certain, CAST(floor((expected - floor(expected)) * 1073741824) AS HUGEINT) AS units FROM e
), g AS (
  SELECT source, stratum, CAST(sum(units) AS DOUBLE) AS m, sum(units * size) AS words, count(*) AS n, CAST(sum(size) AS HUGEINT) AS every, max(target) * CAST(0.02 AS DOUBLE) AS slack FROM p WHERE units > 0 GROUP BY source, stratum
), m AS (
  SELECT source, stratum, m, CAST(words AS DOUBLE) AS w, n, CAST(coalesce(sum(words) OVER b, 0) AS DOUBLE) AS due, CAST(coalesce(sum(every) OVER b, 0) AS DOUBLE) AS room, slack, row_number() OVER (PARTITION BY source ORDER BY stratum DESC) AS i,
         (CAST(('0x' || substr(md5('mix-1:round:' || coalesce(source, '') || ':' || CAST(stratum AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS turn
  FROM g WINDOW b AS (PARTITION BY source ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), q AS (
  SELECT source, stratum, i, w, m, fixed, w - fixed * (w / m) * 1073741824 AS owed FROM (
    SELECT *, greatest(0, least(n, floor(((w + due) / 1073741824 + slack) / (w / m)), greatest(ceil((w / 1073741824 - room - slack) / (w / m)), floor(w / 1073741824 / (w / m) + turn)))) AS fixed FROM m WHERE i = 1) x
  UNION ALL
  SELECT x.source, x.stratum, x.i, x.w, x.m, x.fixed, x.whole - x.fixed * (x.w / x.m) * 1073741824 FROM (
    SELECT m.source, m.stratum, m.i, m.w, m.m, q.owed + m.w AS whole, greatest(0, least(m.n, floor(((q.owed + m.w + m.due) / 1073741824 + m.slack) / (m.w / m.m)), greatest(ceil(((q.owed + m.w) / 1073741824 - m.room - m.slack) / (m.w / m.m)), floor((q.owed + m.w) / 1073741824 / (m.w / m.m) + turn)))) AS fixed
    FROM q JOIN m ON m.source IS NOT DISTINCT FROM q.source AND m.i = q.i + 1) x
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY u / (1 - u) / (CAST(units AS DOUBLE) / CAST(1073741824 - units AS DOUBLE)), doc_id) AS place FROM p WHERE units > 0
), taken AS (
  SELECT r.doc_id, r.source FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source AND r.stratum = q.stratum WHERE place <= fixed
), o AS (
  SELECT p.*, CAST(certain + CASE WHEN x.doc_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS copies FROM p LEFT JOIN taken x ON x.doc_id = p.doc_id AND x.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, expected FROM o
"""
