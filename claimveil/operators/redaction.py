"""De-identified texts and members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimveil.functions import arrays
from claimveil.functions.joins import checked
from claimveil.functions.scalar import age_band, area_of, parse_date, patient_offset, pseudonym, shift_date, zip3, zip_in_text
from claimveil.operators.detection import with_spans
from claimveil.sources.lexicon import MASKS, SMALL_ZIP3_POPULATION


def replacement(span: Column, offset: Column, salt: str) -> Column:
    """What a span becomes: a mask, a pseudonym, a shifted date or the ZIP area."""
    kind, value = span["type"], span["value"]
    masks = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    told = F.when(kind == "name", pseudonym(value, salt, "NAME")).when(kind == "mrn", pseudonym(value, salt, "MRN"))
    told = told.when(kind == "member_id", pseudonym(value, salt, "MBR")).when(kind == "zip", zip_in_text(value))
    told = told.when(kind == "date", F.coalesce(F.date_format(shift_date(parse_date(value), offset), "MM/dd/yyyy"), F.lit("[DATE]")))
    return F.coalesce(told, masks[kind], F.lit("[REDACTED]"))


def redact(notes: DataFrame, salt: str, text: str = "text", key: str = "member_id", name: str = "clean") -> DataFrame:
    """notes with ``spans`` and the text in which every span is replaced; dates move by the key's own number of days.

    A null text has no spans and stays null; a note without a key keeps no dates.
    """
    found = with_spans(notes, text)
    offset = patient_offset(F.col(key), salt)

    body = F.col(text)
    before = lambda i: F.coalesce(F.get(F.col("spans"), i - 1)["end"], F.lit(0))

    def joined(take: Callable[[Column, Column], Column]) -> Column:
        pieces = F.transform("spans", lambda s, i: F.concat(take(before(i), s["start"]), replacement(s, offset, salt)))
        return F.array_join(F.concat(pieces, F.array(take(F.element_at("spans", -1)["end"], F.length(body)))), "")

    short = joined(lambda a, b: F.substring(body, a + 1, b - a))
    long = arrays.bind(arrays.chunks(body), lambda c: joined(lambda a, b: arrays.part(c, a, b)))
    whole = F.when(body.isNull() | (F.size("spans") == 0), body).when(F.length(body) <= arrays.CHUNK, short).otherwise(long)
    return found.withColumn(name, whole)


def with_areas(rows: DataFrame, areas: DataFrame, zip5: str = "zip5", name: str = "zip3", most: int = SMALL_ZIP3_POPULATION) -> DataFrame:
    """rows with the first three digits of a ZIP code, 000 for areas of at most so many people by a table ``(zip3, people)``.

    Areas that the table lacks, or tells no number for, count as large; of an area that it tells twice the numbers add up. The table
    is broadcast if the plan says that it is small, else both sides are shuffled. A null ZIP code stays null; repeated rows stay.
    """
    small = areas.groupBy(F.col("zip3").alias("_zip3")).agg(F.sum("people").alias("_people")).where(F.col("_people") <= most).select("_zip3")
    area = area_of(F.col(zip5))
    told = rows.withColumn("_area", area).join(checked(small), F.col("_area") == F.col("_zip3"), "left")
    return told.withColumn(name, F.when(F.col("_zip3").isNotNull(), F.lit("000")).otherwise(F.col("_area"))).drop("_area", "_zip3")


def deidentify_members(members: DataFrame, salt: str) -> DataFrame:
    """Six columns: a key that the notes' pseudonyms match, ZIP area, state, age band, sex and the days dates are shifted by."""
    return members.select(
        pseudonym(F.col("member_id"), salt, "MBR").alias("member_key"), zip3(F.col("zip5")).alias("zip3"), "state",
        age_band(F.col("age")).alias("age_band"), "sex", patient_offset(F.col("member_id"), salt).alias("date_offset_days"),
    )


def govern_claims(claims: DataFrame, salt: str) -> DataFrame:
    """Claims with the member's key in place of the id, and dates shifted by the member's days."""
    shifted = shift_date(F.col("service_date"), patient_offset(F.col("member_id"), salt))
    return claims.select(pseudonym(F.col("member_id"), salt, "MBR").alias("member_key"), shifted.alias("service_date"), *[c for c in claims.columns if c not in ("member_id", "service_date")])
