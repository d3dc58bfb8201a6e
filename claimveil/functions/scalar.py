"""Scalar functions as Column expressions; none runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimveil.sources.lexicon import DEFAULT_ZIP3_POPULATION, SMALL_ZIP3_POPULATION, ZIP3_POPULATION


def pseudonym(value: Column, salt: str, prefix: str = "ID") -> Column:
    """``PREFIX-`` and the first ten hex digits, upper case, of sha256(salt + value). Null stays null."""
    digest = F.sha2(F.concat(F.lit(salt), value.cast("string")).cast("binary"), 256)
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(digest, 1, 10)))


def patient_offset(key: Column, salt: str, max_days: int = 364) -> Column:
    """Days to shift a patient's dates by: -max_days to -1, the same for the same key and salt."""
    digest = F.sha2(F.concat(F.lit(salt + "date"), key.cast("string")).cast("binary"), 256)
    return (-(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % max_days) - 1).cast("int")


def parse_date(text: Column) -> Column:
    """A date from year-month-day or month/day/year; null for any other text."""
    told = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-M-d")), F.try_to_timestamp(text, F.lit("M/d/yyyy")))
    return told.cast("date")


def shift_date(date: Column, days: Column) -> Column:
    return F.date_add(date, days)


def shift_date_text(text: Column, days: Column) -> Column:
    """A written date moved by so many days, as year-month-day; text that is no date stays as it is."""
    return F.coalesce(F.date_format(F.date_add(parse_date(text), days), "yyyy-MM-dd"), text)


def age_band(age: Column) -> Column:
    """Five-year bands; 90 and over together."""
    low = F.floor(age / 5) * 5
    return F.when(age >= 90, F.lit("90+")).when(age.isNotNull(), F.concat_ws("-", low.cast("string"), (low + 4).cast("string")))


def coarsen_age_band(band: Column) -> Column:
    """Ten-year bands from five-year ones; what doesn't begin with a number stays."""
    low = F.split_part(band, F.lit("-"), F.lit(1)).try_cast("int")
    decade = F.floor(low / 10) * 10
    return F.when((band != "90+") & low.isNotNull(), F.concat_ws("-", decade.cast("string"), (decade + 9).cast("string"))).otherwise(band)


def drop_zip(_: Column) -> Column:
    return F.lit("***")


def is_small_zip3(zip3: Column) -> Column:
    """Whether a three-digit area has so few people that it must not be told; areas that aren't listed count as large."""
    people = F.create_map(*[F.lit(x) for pair in ZIP3_POPULATION.items() for x in pair])
    return F.coalesce(people[zip3], F.lit(DEFAULT_ZIP3_POPULATION)) <= SMALL_ZIP3_POPULATION


def area_of(zip5: Column) -> Column:
    return F.substring(zip5.cast("string"), 1, 3)


def zip3(zip5: Column) -> Column:
    """The first three digits, 000 for a small area."""
    first = area_of(zip5)
    return F.when(is_small_zip3(first), F.lit("000")).otherwise(first)


def zip_in_text(value: Column) -> Column:
    return F.concat(zip3(value), F.lit("XX"))


def risk_band(score: Column) -> Column:
    """A score to one decimal, ties decided by the binary value rather than its shortest decimal form."""
    return F.format_number(score, 1).cast("double")


def months_between(first: Column, last: Column) -> Column:
    """First days of all months from first's to last's; none if first's month is later."""
    a, b = F.trunc(first, "MM"), F.trunc(last, "MM")
    return F.when(a <= b, F.sequence(a, b, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))
