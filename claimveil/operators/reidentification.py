"""k-anonymity, linkage attacks and generalisation of released records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimveil.functions.scalar import age_band, coarsen_age_band, drop_zip

CONDITION_COLUMNS = ["cond_chf", "cond_copd", "cond_diabetes_complication", "cond_ckd_severe", "cond_cancer", "cond_vascular"]
#: What an attacker knows, more from rung to rung.
LADDER = [
    ["state"], ["state", "sex"], ["state", "sex", "age_band"], ["zip3", "sex", "age_band"], ["zip3", "sex", "age_band", "cond_ckd_severe"],
    ["zip3", "sex", "age_band", *CONDITION_COLUMNS],
]
#: Attacks on carriers of conditions: none, one, or two together.
TARGETS = [(), ("cond_cancer",), ("cond_chf",), ("cond_ckd_severe",), ("cond_cancer", "cond_ckd_severe")]


def classes(records: DataFrame, qis: Sequence[str]) -> DataFrame:
    """Records by quasi-identifiers, with their number; a null is a value like others."""
    return records.groupBy(*qis).agg(F.count("*").alias("size"))


def _risk(sized: DataFrame, *keys: str) -> DataFrame:
    size, rows = F.col("size"), F.col("n_records")
    told = sized.groupBy(*keys).agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_records"), F.count("*").alias("n_classes"), F.coalesce(F.min(size), F.lit(0)).alias("min_k"),
        F.coalesce(F.sum(F.when(size == 1, size)), F.lit(0)).cast("long").alias("records_with_k_1"), F.coalesce(F.sum(F.when(size < 5, size)), F.lit(0)).cast("long").alias("records_with_k_under_5"),
    )
    return told.withColumns({"pct_unique": F.coalesce(F.try_divide("records_with_k_1", rows), F.lit(0.0)), "pct_under_5": F.coalesce(F.try_divide("records_with_k_under_5", rows), F.lit(0.0))})


def k_anonymity(records: DataFrame, qis: Sequence[str]) -> DataFrame:
    """One row: records, classes, the smallest class, and how many records are alone or among fewer than five."""
    return _risk(classes(records, qis))


def size_histogram(records: DataFrame, qis: Sequence[str], most: int = 10) -> DataFrame:
    """The smallest class sizes and how many classes have each."""
    return classes(records, qis).groupBy("size").agg(F.count("*").alias("n_classes")).orderBy("size").limit(most)


def _by_sets(records: DataFrame, sets: Sequence[Sequence[str]], name: str, *more: Column) -> DataFrame:
    """Groups by several sets of columns from a single pass of grouping sets, with their number and further sums; sets must differ and are numbered from 1.

    Columns that a set lacks are null in its groups.
    """
    every = sorted({q for r in sets for q in r})
    told = records.groupingSets([[F.col(q) for q in r] for r in sets], *every).agg(F.count("*").alias("size"), *more, F.grouping_id().alias("g"))
    bit = {q: 1 << (len(every) - 1 - k) for k, q in enumerate(every)}
    number = F.create_map(*[F.lit(x) for k, r in enumerate(sets) for x in (sum(b for q, b in bit.items() if q not in r), k + 1)])
    return told.withColumn(name, number[F.col("g").cast("int")]).drop("g")


def ladder(records: DataFrame, rungs: Sequence[Sequence[str]] = LADDER) -> DataFrame:
    """k-anonymity for each rung, from one pass; rungs must differ. No rows for no records."""
    return _risk(_by_sets(records, rungs, "rung"), "rung")


def external_roll(members: DataFrame, kept: Column) -> DataFrame:
    """What an attacker holds: names and demographics of members for whom the condition holds, without anything clinical."""
    return members.where(kept).select(
        F.concat_ws(" ", "first_name", "last_name").alias("name"), "zip5", "state", "age", "sex", F.col("member_id").alias("true_member_id"),
        F.substring("zip5", 1, 3).alias("zip3"), age_band(F.col("age")).alias("age_band"),
    )


def hash_kept(column: str, coverage: float, seed: int) -> Column:
    """A condition that holds for about that share of values, always for the same ones."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52) <= coverage


def linkage(released: DataFrame, roll: DataFrame, qis: Sequence[str], id_field: str = "member_key") -> DataFrame:
    """A row for each released record that is alone in its class and meets anyone in the roll: how many, and the one if there is one."""
    alone = released.groupBy(*qis).agg(F.count("*").alias("n"), F.min(id_field).alias("released")).where("n = 1").drop("n")
    known = roll.groupBy(*[F.col(q).alias(f"r_{q}") for q in qis]).agg(F.count("*").alias("n_roll"), F.min("name").alias("guessed_name"), F.min("true_member_id").alias("true_member_id"))
    same = [alone[q].eqNullSafe(known[f"r_{q}"]) for q in qis]
    told = alone.join(known, same)
    hit = F.col("n_roll") == 1
    return told.select("released", *qis, "n_roll", F.when(hit, F.col("guessed_name")).alias("guessed_name"), F.when(hit, F.col("true_member_id")).alias("true_member_id"))


def attack(released: DataFrame, roll: DataFrame, qis: Sequence[str], id_field: str = "member_key") -> DataFrame:
    """One row: sizes, records identified with certainty, their rate, and unique ones that several people of the roll fit."""
    links = linkage(released, roll, qis, id_field).agg(F.count_if(F.col("n_roll") == 1).alias("n_reidentified"), F.count_if(F.col("n_roll") > 1).alias("n_unique_but_ambiguous_in_roll"))
    sizes = released.agg(F.count("*").alias("n_released")).crossJoin(roll.agg(F.count("*").alias("n_roll")))  # one row each
    return sizes.crossJoin(links).withColumn("rate", F.coalesce(F.try_divide("n_reidentified", "n_released"), F.lit(0.0)))


def linkage_sets(released: DataFrame, roll: DataFrame, sets: Sequence[Sequence[str]], id_field: str = "member_key") -> DataFrame:
    """``linkage`` for several different sets of quasi-identifiers at once, numbered from 1 in ``set``: one pass over each side and one join."""
    every = sorted({q for r in sets for q in r})
    alone = _by_sets(released, sets, "set", F.min(id_field).alias("released")).where("size = 1").drop("size")
    known = _by_sets(roll, sets, "r_set", F.min("name").alias("guessed_name"), F.min("true_member_id").alias("true_member_id")).withColumnRenamed("size", "n_roll")
    known = known.withColumnsRenamed({q: f"r_{q}" for q in every})
    hit = F.col("n_roll") == 1
    told = alone.join(known, [alone["set"] == known["r_set"], *[alone[q].eqNullSafe(known[f"r_{q}"]) for q in every]])
    return told.select("set", "released", *every, "n_roll", F.when(hit, F.col("guessed_name")).alias("guessed_name"), F.when(hit, F.col("true_member_id")).alias("true_member_id"))


def attack_rungs(released: DataFrame, roll: DataFrame, rungs: Sequence[tuple[int, Sequence[str]]], id_field: str = "member_key") -> DataFrame:
    """``attack`` for each numbered set of quasi-identifiers, and whether it is the best: the first with most records identified.

    Rungs of the same columns are one attack. Both sides are grouped for all of them at once and counted once.
    """
    sets = list(dict.fromkeys(tuple(sorted(qis)) for _, qis in rungs))
    links = linkage_sets(released, roll, sets, id_field).groupBy("set").agg(F.count_if(F.col("n_roll") == 1).alias("hits"), F.count_if(F.col("n_roll") > 1).alias("unsure"))
    listed = F.array(*[F.struct(F.lit(n).alias("rung"), F.lit(sets.index(tuple(sorted(qis))) + 1).alias("set")) for n, qis in rungs])
    sizes = released.agg(F.count("*").alias("n_released")).crossJoin(roll.agg(F.count("*").alias("n_roll")))  # one row each
    told = sizes.select("*", F.inline(listed)).join(F.broadcast(links), "set", "left")  # a row for each rung
    counts = [F.coalesce("hits", F.lit(0)).alias("n_reidentified"), F.coalesce("unsure", F.lit(0)).alias("n_unique_but_ambiguous_in_roll")]
    rows = told.select("rung", "n_released", "n_roll", *counts).withColumn("rate", F.coalesce(F.try_divide("n_reidentified", "n_released"), F.lit(0.0)))
    best = F.max_by("rung", F.struct("n_reidentified", -F.col("rung"))).over(Window.partitionBy())
    return rows.withColumn("is_best", F.col("rung") == best)


def verify(links: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """How many of the certain links are right; crosswalk: (member_key, member_id). A key that it lacks counts as wrong."""
    told = links.where("true_member_id is not null").select("released", "true_member_id").join(crosswalk, F.col("released") == F.col("member_key"), "left")
    right = F.count_if(F.col("member_id") == F.col("true_member_id"))
    return told.agg(F.count("*").alias("n_checked"), right.alias("n_correct")).withColumn("precision", F.coalesce(F.try_divide("n_correct", "n_checked"), F.lit(0.0)))


def first_links(links: DataFrame, n: int = 5) -> DataFrame:
    """The certain links of the first released ids."""
    return links.where("true_member_id is not null").orderBy("released").limit(n)


def targeted(records: DataFrame, targets: Sequence[Sequence[str]] = TARGETS, base: Sequence[str] = ("zip3", "sex", "age_band")) -> DataFrame:
    """For each target: k-anonymity with the conditions known, and the share of records that are alone among those at risk, in one pass.

    At risk are the carriers of a single condition, else all records. Prevalence is told for a single condition.
    """
    sized = _by_sets(records, [[*base, *t] for t in targets], "target")
    own = F.lit(None).cast("boolean")
    for k, conditions in enumerate(targets):
        if len(conditions) == 1:
            own = F.when(F.col("target") == k + 1, F.col(conditions[0])).otherwise(own)
    carried = sized.withColumn("carried", own)
    sums = carried.groupBy("target").agg(F.sum(F.when(F.col("carried"), F.col("size"))).alias("carriers"), F.sum(F.when(F.col("carried") & (F.col("size") == 1), 1)).alias("alone"))
    names = [(k + 1, "+".join(c.removeprefix("cond_") for c in t) or "none", len(t) == 1) for k, t in enumerate(targets)]
    listed = F.array(*[F.struct(F.lit(k).alias("target"), F.lit(name).alias("known"), F.lit(one).alias("single")) for k, name, one in names])
    told = records.sparkSession.range(1).select(F.inline(listed)).join(_risk(sized, "target"), "target", "left").join(sums, "target", "left").na.fill(0)
    share = F.coalesce(F.try_divide("alone", "carriers"), F.lit(0.0))
    prevalence = F.coalesce(F.try_divide("carriers", "n_records"), F.lit(0.0))
    return told.withColumns({"carriers_pct_unique": F.when(F.col("single"), share).otherwise(F.col("pct_unique")), "prevalence": F.when(F.col("single"), prevalence)}).drop("single", "carriers", "alone")


def generalise(records: DataFrame, qis: Sequence[str], k: int = 5, generalisations: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """records with columns made coarser, and ``kept``: whether at least k share a record's quasi-identifiers afterwards."""
    coarse = records.withColumns({c: f(F.col(c)) for c, f in (generalisations or {}).items() if c in records.columns})
    sized = classes(coarse, qis).select(*[F.col(q).alias(f"k_{q}") for q in qis], "size")
    return coarse.join(sized, [coarse[q].eqNullSafe(sized[f"k_{q}"]) for q in qis]).withColumn("kept", F.col("size") >= k).select(*coarse.columns, "kept")


def suppression(generalised: DataFrame, k: int = 5) -> DataFrame:
    """One row: k, records in, kept and suppressed, and the rate."""
    told = generalised.agg(F.count("*").alias("n_in"), F.count_if("kept").alias("n_kept"))
    gone = F.col("n_in") - F.col("n_kept")
    return told.select(F.lit(k).alias("k"), "n_in", "n_kept", gone.alias("n_suppressed"), F.coalesce(F.try_divide(gone, F.col("n_in")), F.lit(0.0)).alias("suppression_rate"))


STEPS = [("as released", {}), ("10-year age bands", {"age_band": coarsen_age_band}), ("10-year age bands, ZIP dropped", {"age_band": coarsen_age_band, "zip3": drop_zip})]


def suppression_steps(records: DataFrame, qis: Sequence[str], k: int = 5, steps: Sequence[tuple[str, dict[str, Callable[[Column], Column]]]] = STEPS) -> DataFrame:
    """``suppression`` of each step's generalisation, and the smallest class that is left, from one pass over the records.

    A step's row depends on the sizes of classes alone, so nothing is joined back to the records. Steps must differ.
    """
    coarse, sets = {}, []
    for n, (_, change) in enumerate(steps):
        coarse |= {f"{q}_{n}": change[q](F.col(q)) for q in qis if q in change}
        sets.append([f"{q}_{n}" if q in change else q for q in qis])
    sized = _by_sets(records.withColumns(coarse), sets, "number")
    kept = F.when(F.col("size") >= k, F.col("size"))
    sums = sized.groupBy("number").agg(F.sum("size").alias("n_in"), F.sum(kept).alias("n_kept"), F.min(kept).alias("min_k_after"))
    listed = F.array(*[F.struct(F.lit(n + 1).alias("number"), F.lit(name).alias("step")) for n, (name, _) in enumerate(steps)])
    told = records.sparkSession.range(1).select(F.inline(listed)).join(sums, "number", "left").na.fill(0)
    gone = F.col("n_in") - F.col("n_kept")
    return told.select("number", "step", F.lit(k).alias("k"), "n_in", "n_kept", gone.alias("n_suppressed"), F.coalesce(F.try_divide(gone, F.col("n_in")), F.lit(0.0)).alias("suppression_rate"), "min_k_after")
