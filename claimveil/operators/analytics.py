"""Member months, PMPM by category, its decomposition, cost concentration and risk context."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimveil.functions.scalar import days_in_month, months_between
from claimveil.sources.lexicon import CONDITIONS

SHARES = (1, 5, 10, 20, 50)
#: Parts of a month in which all months' days are whole numbers, so that sums of member months don't depend on order.
PARTS = math.lcm(28, 29, 30, 31)


def member_months(eligibility: DataFrame, start: str, end: str, prorate: bool = True) -> DataFrame:
    """``(member_id, year, month, member_months)``: each span's covered days of a month over its days, summed.

    Spans include both ends. The window picks months: a month that it only touches counts as a whole. Without prorate a
    month counts as one if a span covers 15 days of it, else as zero. Overlapping spans count twice.
    """
    spans = eligibility.select(
        "member_id", "span_start", "span_end",
        F.explode(months_between(F.greatest("span_start", F.lit(start).cast("date")), F.least("span_end", F.lit(end).cast("date")))).alias("m"),
    )
    days = F.date_diff(F.least("span_end", F.last_day("m")), F.greatest("span_start", "m")) + 1
    part = days * (F.lit(PARTS) / days_in_month(F.col("m"))).cast("long") if prorate else F.when(days >= 15, PARTS).otherwise(0)
    told = spans.where(days > 0).select("member_id", F.year("m").alias("year"), F.month("m").alias("month"), part.cast("long").alias("part"))
    return told.groupBy("member_id", "year", "month").agg((F.sum("part") / PARTS).alias("member_months"))


def total_months(column: str = "member_months") -> Column:
    """The sum of member months, in whole parts of a month."""
    return F.sum(F.round(F.col(column) * PARTS).cast("long")) / PARTS


def spine(by_member: DataFrame) -> DataFrame:
    """``(year, month, member_months)`` from member months by member."""
    return by_member.groupBy("year", "month").agg(total_months().alias("member_months"))


def naive_denominator(members: DataFrame, months: DataFrame) -> DataFrame:
    """Members times months beside the true member months, and by how much the one overstates the other."""
    actual = months.agg(total_months().alias("actual"), F.count("*").alias("n_months"))
    both = members.agg(F.count("*").alias("n_members")).crossJoin(actual)  # one row each
    naive = (F.col("n_members") * F.col("n_months")).cast("double")
    return both.select(
        "n_members", "n_months", "actual", naive.alias("naive"),
        (F.try_divide(naive, "actual") - 1).alias("overstatement"), (1 - F.try_divide(F.col("actual"), naive)).alias("pmpm_understatement"),
    )


def _ratios(df: DataFrame, more: list[Column]) -> DataFrame:
    """PMPM and price beside paid, services and member months; a price without services is zero."""
    paid = F.col("paid").cast("double")
    return df.withColumns({
        "paid": paid, "pmpm": F.coalesce(F.try_divide(paid, F.col("member_months")), F.lit(0.0)),
        "price_per_service": F.coalesce(F.try_divide(paid, F.col("services")), F.lit(0.0)),
    }).select("*", *more)


def pmpm_by_month(claims: DataFrame, months: DataFrame, start: str, end: str, by_category: bool = True) -> DataFrame:
    """Paid, services and ratios for each month of the spine, by category or in total.

    Claims outside the window or in months without member months are left out; months without claims stay, with a null
    category, or zeros in total. Claims are summed before they meet the spine, which is a row for each month.
    """
    inside = claims.where(F.col("service_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    keys = ["year", "month"] + ["category"] * by_category
    summed = (
        inside.select(F.year("service_date").alias("year"), F.month("service_date").alias("month"), F.col("service_category").alias("category"), "paid_amount", "units")
        .groupBy(*keys).agg(F.sum("paid_amount").alias("paid"), F.sum("units").cast("long").alias("services"))
    )
    joined = months.where("member_months > 0").join(summed, ["year", "month"], "left")
    joined = joined.withColumn("services", F.coalesce("services", F.lit(0).cast("long"))).withColumn("paid", F.coalesce("paid", F.lit(0).cast("decimal(28,2)")))
    out = _ratios(joined, [(F.col("services") / F.col("member_months") * 1000).alias("util_per_1000")])
    return out.select(*keys, "member_months", "paid", "services", "pmpm", "util_per_1000", "price_per_service")


def pmpm_by_quarter(by_month: DataFrame, months: DataFrame, by_category: bool = True) -> DataFrame:
    """Sums of months' paid, services and member months by quarter, ratios computed again from the sums."""
    quarter = F.ceil(F.col("month") / 3).cast("int").alias("quarter")
    mm = months.where("member_months > 0").groupBy("year", quarter).agg(total_months().alias("member_months"))
    keys = ["year", "quarter"] + ["category"] * by_category
    summed = by_month.where("category is not null") if by_category else by_month
    summed = summed.withColumn("quarter", quarter).groupBy(*keys).agg(F.sum(F.col("paid").cast("decimal(28,2)")).alias("paid"), F.sum("services").alias("services"))
    out = _ratios(mm.join(summed, ["year", "quarter"]), [(F.col("services") / F.col("member_months")).alias("util_per_member_month")])
    return out.select(*keys, "member_months", "paid", "services", "pmpm", "util_per_member_month", "price_per_service")


def quarter_totals(by_quarter: DataFrame, months: DataFrame) -> DataFrame:
    """All categories together, from their rows; quarters of the spine without any stay, with zeros."""
    quarter = F.ceil(F.col("month") / 3).cast("int").alias("quarter")
    mm = months.where("member_months > 0").groupBy("year", quarter).agg(total_months().alias("member_months"))
    summed = by_quarter.groupBy("year", "quarter").agg(F.sum(F.col("paid").cast("decimal(28,2)")).alias("paid"), F.sum("services").alias("services"))
    joined = mm.join(summed, ["year", "quarter"], "left").withColumns({"paid": F.coalesce("paid", F.lit(0).cast("decimal(28,2)")), "services": F.coalesce("services", F.lit(0).cast("long"))})
    out = _ratios(joined, [(F.col("services") / F.col("member_months")).alias("util_per_member_month")])
    return out.select("year", "quarter", "member_months", "paid", "services", "pmpm", "util_per_member_month", "price_per_service")


PERIOD = "year * 4 + quarter"


def _both_sides(rows: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """A row for each period and key that it or the next one has: figures with 0 (the period's) and 1 (the next one's) after their names.

    Each row is dealt to both periods it belongs to and they meet in one aggregation, so the rows are computed once.
    """
    sides = F.explode(F.array(*[F.struct((F.expr(PERIOD) - k).alias("t"), F.lit(k).alias("side")) for k in (0, 1)])).alias("s")
    dealt = rows.select(sides, *keys, *[F.col(a).alias(b) for a, b in names.items()]).select("s.*", *keys, *names.values())
    return dealt.groupBy("t", *keys).agg(*[F.max(F.when(F.col("side") == k, F.col(b))).alias(f"{b}{k}") for b in names.values() for k in (0, 1)])


def _pairs(by_quarter: DataFrame) -> DataFrame:
    """A row for each category of two neighbouring periods, with 0 and 1 after the names of their figures; missing: zero."""
    names = {"util_per_member_month": "u", "price_per_service": "p", "pmpm": "pmpm"}
    return _both_sides(by_quarter, ["category"], names).na.fill(0.0)


def _known(totals: DataFrame) -> DataFrame:
    """Neighbouring periods that both have totals."""
    told = _both_sides(totals.withColumns({"y": F.col("year"), "q": F.col("quarter")}), [], {"y": "year", "q": "quarter", "pmpm": "pmpm_", "member_months": "member_months_"})
    return told.where("year0 is not null and year1 is not null").withColumnsRenamed({"year0": "year", "quarter0": "quarter"})


def decompose(by_quarter: DataFrame, totals: DataFrame) -> DataFrame:
    """Price, utilisation and mix effects and the residual of the PMPM's change from each quarter to the next.

    Only pairs of quarters that both have totals are told. With shares s of the uses u, U their sum: utilisation is
    (U1 - U0) sum(s0 p0), price U0 sum(s0 (p1 - p0)), mix U0 sum((s1 - s0) p0); shares of nothing are zero.
    """
    def total(a: str, b: str | None = None) -> Column:
        return F.sum(F.col(a) * F.col(b) if b else F.col(a)).alias(a + (b or ""))

    sums = _pairs(by_quarter).groupBy("t").agg(total("u0"), total("u1"), total("u0", "p0"), total("u0", "p1"), total("u1", "p0"))
    mean0, mean1 = (F.coalesce(F.try_divide(f"{u}p0", u), F.lit(0.0)) for u in ("u0", "u1"))
    used = F.when(F.col("u0") != 0, 1.0).otherwise(0.0)
    effects = sums.select(
        "t", ((F.col("u1") - F.col("u0")) * mean0).alias("utilisation_effect"), (used * (F.col("u0p1") - F.col("u0p0"))).alias("price_effect"), (F.col("u0") * (mean1 - mean0)).alias("mix_effect")
    )
    told = _known(totals)
    change = F.col("pmpm_1") - F.col("pmpm_0")
    out = told.join(effects, "t", "left").na.fill(0.0, ["utilisation_effect", "price_effect", "mix_effect"])
    return out.select(
        "year", "quarter", "pmpm_0", "pmpm_1", change.alias("actual_change"), F.coalesce(F.try_divide(change, "pmpm_0"), F.lit(0.0)).alias("pct_change"),
        "member_months_0", "member_months_1",
        F.coalesce(F.try_divide(F.col("member_months_1") - F.col("member_months_0"), "member_months_0"), F.lit(0.0)).alias("member_month_change_pct"),
        "utilisation_effect", "price_effect", "mix_effect",
        (change - F.col("utilisation_effect") - F.col("price_effect") - F.col("mix_effect")).alias("residual"),
        *[F.coalesce(F.try_divide(e, change), F.lit(0.0)).alias(f"{e.split('_')[0]}_share") for e in ("utilisation_effect", "price_effect", "mix_effect")],
    )


def decompose_by_category(by_quarter: DataFrame, totals: DataFrame) -> DataFrame:
    """Each category's own price and utilisation effect, and its PMPM and price in both quarters."""
    known = _known(totals).select("t", "year", "quarter")
    return _pairs(by_quarter).join(known, "t").select(
        "year", "quarter", "category", (F.col("u0") * (F.col("p1") - F.col("p0"))).alias("price_effect"), ((F.col("u1") - F.col("u0")) * F.col("p0")).alias("util_effect"),
        "pmpm0", "pmpm1", F.coalesce(F.try_divide("p1", "p0"), F.lit(0.0)).alias("price_ratio"),
    )


def cost_concentration(claims: DataFrame, start: str, end: str, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """Which share of spend the costliest p percent of members with spend account for; no row without any.

    The rank over all members comes without sorting them in one task: members are counted and summed by amount, the running
    sums go over ranges of amounts first and inside each range then. A total of zero gives null shares.
    """
    spend = (
        claims.where(F.col("service_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("member_id").agg(F.sum("paid_amount").cast("decimal(28,2)").alias("spend"))
    )
    amounts = spend.groupBy("spend").agg(F.count("*").alias("n"))
    ranged = amounts.withColumn("range", F.floor(F.log2(F.greatest(F.col("spend").cast("double"), F.lit(0.0)) + 1) * 64))
    by_range = ranged.groupBy("range").agg(F.sum("n").alias("rn"), F.sum(F.col("spend") * F.col("n")).cast("decimal(38,2)").alias("rs"))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    by_range = by_range.select(
        "range", F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("rs").over(above), F.lit(0).cast("decimal(38,2)")).alias("s_above"),
        F.sum("rn").over(every).alias("n_all"), F.sum("rs").over(every).alias("s_all"),
    )
    inside = Window.partitionBy("range").orderBy(F.desc("spend")).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(by_range, "range").select(
        "spend", "n", "n_all", "s_all", (F.col("n_above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"),
    )
    k = {p: F.greatest(F.lit(1), F.bround(F.col("n_all") * p / F.lit(100.0), 0).cast("long")) for p in shares}
    taken = {p: F.sum(F.col("spend").cast("decimal(28,2)") * F.greatest(F.least(F.col("n"), c - F.col("before")), F.lit(0))).cast("double") for p, c in k.items()}
    total = F.first("s_all").cast("double")
    return placed.agg(
        *[F.try_divide(taken[p], total).alias(f"top_{p}pct_share") for p in shares], F.first("n_all").alias("n_members_with_spend"), total.alias("total_paid"), F.count("*").alias("_n")
    ).where("_n > 0").drop("_n")


def risk_context(members: DataFrame) -> DataFrame:
    """A row for each condition: code, description, coefficient, members and prevalence; mean score and members beside."""
    flags = members.agg(
        *[F.count_if(F.col(f"cond_{name}")).alias(name) for name in CONDITIONS], F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("mean_risk_score"), F.count("*").alias("members")
    )
    rows = F.explode(F.array(*[F.struct(F.lit(code).alias("code"), F.lit(text).alias("description"), F.lit(weight).alias("coefficient"), F.col(name).alias("n_members")) for name, (code, text, weight) in CONDITIONS.items()]))
    told = flags.select(rows.alias("r"), "mean_risk_score", "members")
    return told.select("r.*", F.coalesce(F.try_divide("r.n_members", "members"), F.lit(0.0)).alias("prevalence"), "mean_risk_score", "members")
