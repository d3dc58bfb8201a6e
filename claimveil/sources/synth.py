"""Members, eligibility, claims and notes made up from hashes of numbers: the same rows however they are partitioned.

The numbers are a range, or a table's key: then each of its rows has a made-up person in its place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimveil.functions import arrays
from claimveil.sources import lexicon as L
from claimveil.sources.adapters import pieces


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone: 52 bits of the md5 of their text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def between(u: Column, low: int, high: int) -> Column:
    """An integer from low to high, both included."""
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def choose(u: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), between(u, 1, len(values)))


def padded(number: str, digits: int) -> Column:
    """A column of numbers with so many digits at least."""
    text = F.col(number).cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def poisson(u: Column, v: Column, mean: Column) -> Column:
    """A Poisson number by its inverse distribution; over a mean of 30 a rounded-down normal one, not below zero.

    The distribution is summed up to ten standard deviations over the mean and a dozen more, beyond which a double has no part of it.
    Few numbers need all of that sum: where u is reached within two deviations, it ends there. u and the mean are computed once a row, not at each step.
    """

    def counted(at: Column) -> Column:
        u, mean = at["u"], at["mean"]
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).alias("n"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * mean / k
            return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), (s["n"] + (u >= s["sum"]).cast("int")).alias("n"))

        def up_to(last: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"])

        near = F.ceil(mean + 2 * F.sqrt(mean)).cast("int") + 2  # the sum never falls, so a number below this is final
        far = F.ceil(mean + 10 * F.sqrt(mean)).cast("int") + 12
        small = arrays.bind(up_to(near), lambda n: F.when(n < near, n).otherwise(up_to(far)))
        large = F.greatest(F.lit(0), (mean + normal(u, v) * F.sqrt(mean)).cast("int"))
        return F.when(mean <= 0, 0).when(mean > 30, large).otherwise(small)

    return arrays.bind(F.struct(u.alias("u"), mean.alias("mean")), counted)


def members(spark: SparkSession, n: int = 8000, seed: int = 17, unseen_fraction: float = 0.30) -> DataFrame:
    return members_for(spark.range(n), seed, unseen_fraction)


def members_for(ids: DataFrame, seed: int = 17, unseen_fraction: float = 0.30) -> DataFrame:
    """A member for each number in the column ``id``, which must be distinct and not negative; more columns are not read."""

    def u(name: str) -> Column:
        return uniform(seed, F.col("id"), name)

    def number(name: str, low: int, high: int) -> Column:
        return between(u(name), low, high).cast("string")

    city = F.element_at(F.array(*[F.struct(F.lit(c).alias("city"), F.lit(s).alias("state"), F.lit(z).alias("zip5")) for c, s, z in L.CITIES]), between(u("city"), 1, len(L.CITIES)))
    people = ids.select("id").withColumns({"unseen": u("unseen") < unseen_fraction, "place": city, "age": F.greatest(F.lit(0), F.least(F.lit(94), (52 + 20 * normal(u("age1"), u("age2"))).cast("int")))})
    people = people.withColumns({
        "first_name": F.when(F.col("unseen"), choose(u("first"), L.FIRST_UNSEEN)).otherwise(choose(u("first"), L.FIRST_KNOWN)),
        "last_name": F.when(F.col("unseen"), choose(u("last"), L.SURNAMES_UNSEEN)).otherwise(choose(u("last"), L.SURNAMES_KNOWN)),
        **{f"cond_{c}": u(f"cond_{c}") < 0.02 + F.col("age") / 1400 for c in L.CONDITIONS},
    })
    risk = 0.6 + F.col("age") / 250
    for c, (_, _, weight) in L.CONDITIONS.items():
        risk = risk + F.when(F.col(f"cond_{c}"), weight).otherwise(0.0)
    # numbers that tell members apart have the row's number in them
    unique = padded("id", 8)
    return people.select(
        "id", F.concat(choose(u("plan"), ["H", "P"]), number("member", 1, 9), unique).alias("member_id"), "age", choose(u("sex"), ["F", "M"]).alias("sex"),
        "first_name", "last_name", F.concat(number("house", 1, 9999), F.lit(" "), choose(u("street"), L.STREETS)).alias("street"),
        F.col("place.city").alias("city"), F.col("place.state").alias("state"),
        F.when(u("small") < 0.08, choose(u("zip"), L.SMALL_ZIPS)).otherwise(F.col("place.zip5")).alias("zip5"),
        F.concat(F.lit("("), number("p1", 200, 989), F.lit(") "), number("p2", 200, 999), F.lit("-"), number("p3", 1000, 9999)).alias("phone"),
        F.concat(F.lower("first_name"), F.lit("."), F.lower("last_name"), number("mail", 1, 99), F.lit("@example.com")).alias("email"),
        F.concat(number("s1", 100, 899), F.lit("-"), number("s2", 10, 99), F.lit("-"), number("s3", 1000, 9999)).alias("ssn"),
        F.concat(F.lit("MRN"), number("mrn", 1_000_000, 9_999_999)).alias("mrn"), F.concat(F.lit("ACCT-"), number("account", 100_000, 999_999)).alias("account_number"),
        (~F.col("unseen")).alias("name_in_gazetteer"), *[f"cond_{c}" for c in L.CONDITIONS], F.round(risk, 3).alias("risk_score"),
    )


def spans(people: DataFrame, seed: int = 17) -> DataFrame:
    """people with ``spans``, the array of covered spans: full, late, early or with a gap, some cut off by the shock."""

    def u(name: str) -> Column:
        return uniform(seed, F.col("id"), name)

    start, end, cut = (F.lit(x).cast("date") for x in (L.START, L.END, L.SHOCK_CUT))

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    gap = F.date_add(start, between(u("gap"), 90, 500))
    again = F.date_add(gap, between(u("again"), 40, 200))
    kind = u("kind")
    late = F.date_add(start, between(u("late"), 30, 400))
    early = F.date_sub(end, between(u("early"), 30, 400))
    told = (
        F.when(kind < 0.62, F.array(span(start, end))).when(kind < 0.75, F.array(span(late, end))).when(kind < 0.87, F.array(span(start, early)))
        .when(again < end, F.array(span(start, gap), span(again, end))).otherwise(F.array(span(start, gap)))
    )
    ended = F.transform(F.filter(told, lambda s: s["a"] < cut), lambda s: span(s["a"], F.least(s["b"], cut)))
    return people.withColumn("spans", F.when(u("shock") < L.SHOCK_DROP, ended).otherwise(told))


def eligibility(covered: DataFrame) -> DataFrame:
    return covered.select("member_id", F.explode("spans").alias("s")).select("member_id", F.col("s.a").alias("span_start"), F.col("s.b").alias("span_end"))


def covered_days() -> Column:
    return F.aggregate("spans", F.lit(0), lambda n, s: n + F.date_diff(s["b"], s["a"]))


def claims(covered: DataFrame, seed: int = 17) -> DataFrame:
    """Claims of covered members: a Poisson number for each category, each in a random span, on a random day of it."""
    rates = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("rate"), F.lit(p).alias("price")) for c, (r, p) in L.CATEGORIES.items()]))
    told = covered.withColumn("days", covered_days()).where("days > 0").select("id", "member_id", "risk_score", "days", "spans", rates.alias("r"))
    n = poisson(uniform(seed, F.col("id"), F.col("r.c"), "n"), uniform(seed, F.col("id"), F.col("r.c"), "m"), F.col("r.rate") * F.col("risk_score") * F.col("days") / 365.0)
    # an outer generator: for others Spark infers a filter on the number, and would draw it again for that
    told = told.withColumn("n", n).withColumn("k", F.explode_outer(F.expr("CASE WHEN n > 0 THEN sequence(1, n) END"))).where("k is not null")

    def u(name: str) -> Column:
        return uniform(seed, F.col("id"), F.col("r.c"), F.col("k"), name)

    told = told.withColumn("span", F.element_at("spans", (F.floor(u("span") * F.size("spans")) + 1).cast("int"))).drop("spans", "n", "days", "risk_score")
    # again an outer generator, so that what is asked of the span and the day doesn't draw them again
    told = told.select("id", "member_id", "r", "k", F.inline_outer(F.array(F.struct(F.col("span.a").alias("a"), F.date_diff("span.b", "span.a").alias("length")))))
    told = told.where("length > 1").withColumn("d", F.date_add("a", F.floor(u("day") * F.col("length")).cast("int")))
    dear = (F.col("r.c") == "inpatient") & (F.struct(F.year("d"), F.quarter("d")) >= F.struct(*map(F.lit, L.SHOCK_START)))
    price = F.col("r.price") * (0.55 + u("price") * 1.05) * F.when(dear, L.SHOCK_PRICE).otherwise(1.0)
    return told.select(
        F.concat(F.lit("C"), padded("id", 9), F.substring("r.c", 1, 2), F.lpad(F.col("k").cast("string"), 4, "0")).alias("claim_id"), "member_id", F.col("d").alias("service_date"),
        F.col("r.c").alias("service_category"), F.lit(1).alias("units"), F.round(price, 2).cast("decimal(18,2)").alias("paid_amount"), F.concat(F.lit("1"), between(u("npi"), 100_000_000, 999_999_999).cast("string")).alias("provider_npi"),
    )


def notes(covered: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Notes of covered members, none to two each, and the planted spans."""
    count = F.element_at(F.array(*map(F.lit, (0, 0, 0, 1, 1, 2))), between(uniform(seed, F.col("id"), "notes"), 1, 6))
    told = covered.withColumn("days", covered_days()).where("days > 0").withColumn("n", count).where("n > 0").withColumn("k", F.explode(F.expr("sequence(1, n)")))

    def u(name: str) -> Column:
        return uniform(seed, F.col("id"), F.col("k"), name)

    def number(name: str, low: int, high: int) -> Column:
        return between(u(name), low, high).cast("string")

    window = F.date_diff(F.lit(L.END).cast("date"), F.lit(L.START).cast("date"))
    day = F.date_add(F.lit(L.START).cast("date"), F.floor(u("date") * window).cast("int"))
    own = {c: F.col(c) for c in ("mrn", "phone", "email", "ssn", "member_id", "street", "city", "state", "zip5", "account_number")}
    fields = own | {
        "first": F.col("first_name"), "last": F.col("last_name"), "provider_last": choose(u("provider"), L.SURNAMES_KNOWN + L.SURNAMES_UNSEEN), "date": F.date_format(day, "MM/dd/yyyy"),
        "url": F.concat(F.lit("https://portal.example.com/case/"), number("url", 10_000, 99_999)),
        "ip": F.concat_ws(".", number("i1", 10, 220), number("i2", 0, 255), number("i3", 0, 255), number("i4", 1, 254)), "drug": choose(u("drug"), L.DRUGS),
        "dept": choose(u("dept"), L.DEPARTMENTS), "month": choose(u("month"), L.MONTHS), "month2": choose(u("month2"), L.MONTHS), "payer": choose(u("payer"), L.PAYERS),
    }
    parts = F.lit(None)
    for t, text in reversed(list(enumerate(L.NOTE_TEMPLATES))):
        told_parts = F.array(*[F.struct((fields[f] if f else F.lit(lit)).alias("value"), F.lit(L.FIELD_TYPES.get(f)).cast("string").alias("type")) for lit, f in pieces(text)])
        parts = F.when(F.col("template") == t, told_parts).otherwise(parts) if t < len(L.NOTE_TEMPLATES) - 1 else told_parts
    told = told.withColumn("template", between(u("template"), 0, len(L.NOTE_TEMPLATES) - 1)).withColumn("parts", parts)
    note_id = F.concat(F.lit("N"), padded("id", 8), F.col("k").cast("string"))
    empty = F.array().cast("array<struct<start:int,end:int,type:string,value:string>>")

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p["value"])
        span = F.struct(s["at"].alias("start"), end.alias("end"), p["type"].alias("type"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(p["type"].isNotNull(), F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    planted = F.aggregate("parts", F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    told = told.select(note_id.alias("note_id"), "member_id", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("text"), planted.alias("truth"))
    return told.select("note_id", "member_id", "text"), told.select("note_id", F.explode("truth").alias("s")).select("note_id", "s.*")


def generate(spark: SparkSession, n: int = 8000, seed: int = 17) -> dict[str, DataFrame]:
    """All tables by name."""
    return generate_for(spark.range(n), seed)


def generate_for(ids: DataFrame, seed: int = 17) -> dict[str, DataFrame]:
    """All tables by name, for members with these numbers."""
    people = members_for(ids, seed)
    covered = spans(people, seed)
    told, planted = notes(covered, seed)
    return {"members": people.drop("id"), "eligibility": eligibility(covered), "claims": claims(covered, seed), "notes": told, "truth_spans": planted}
