import datetime
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from claimveil.functions import arrays
from claimveil.functions import scalar as S

SALT = "test-salt"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_pseudonym_and_offset(spark):
    digest = hashlib.sha256((SALT + "MRN1234567").encode()).hexdigest()[:10].upper()
    assert one(spark, S.pseudonym(F.lit("MRN1234567"), SALT, "MRN")) == f"MRN-{digest}" and "1234567" not in digest
    assert one(spark, S.pseudonym(F.lit("MRN7654321"), SALT, "MRN")) != f"MRN-{digest}"
    days = [r.d for r in spark.range(50).select(S.patient_offset(F.concat(F.lit("M"), "id"), SALT).alias("d")).collect()]
    want = [-(int.from_bytes(hashlib.sha256(f"{SALT}dateM{i}".encode()).digest()[:4], "big") % 364) - 1 for i in range(50)]
    assert days == want and len(set(days)) > 25 and all(-364 <= d <= -1 for d in days)


def test_shift_keeps_intervals(spark):
    days = S.patient_offset(F.lit("M1"), SALT)
    a, b = (one(spark, S.shift_date(F.lit(d).cast("date"), days)) for d in ("2024-03-01", "2024-03-31"))
    assert (b - a).days == 30 and a < datetime.date(2024, 3, 1)


@pytest.mark.parametrize("text,want", [("2024-03-14", "2024-03-04"), ("03/14/2024", "2024-03-04"), ("3/4/2024", "2024-02-23"), ("03-14-2024", "03-14-2024"), ("02/30/2024", "02/30/2024"), ("2024-13-40", "2024-13-40"), ("x", "x"), (None, None)])
def test_shift_text(spark, text, want):
    assert one(spark, S.shift_date_text(F.lit(text).cast("string"), F.lit(-10))) == want


@pytest.mark.parametrize("age,band,coarse", [(91, "90+", "90+"), (90, "90+", "90+"), (89, "85-89", "80-89"), (42, "40-44", "40-49"), (0, "0-4", "0-9"), (37, "35-39", "30-39"), (None, None, None)])
def test_bands(spark, age, band, coarse):
    x = S.age_band(F.lit(age).cast("int"))
    assert one(spark, x) == band and one(spark, S.coarsen_age_band(x)) == coarse


def test_coarsen_leaves_other_text(spark):
    assert one(spark, S.coarsen_age_band(F.lit("old"))) == "old" and one(spark, S.drop_zip(F.lit("455"))) == "***"


@pytest.mark.parametrize("zip5,area", [("05901", "000"), ("82312", "000"), ("88905", "000"), ("45501", "455"), ("99999", "999")])
def test_zip(spark, zip5, area):
    assert one(spark, S.zip3(F.lit(zip5))) == area and one(spark, S.zip_in_text(F.lit(zip5))) == area + "XX"


@pytest.mark.parametrize("score", [1.15, 1.05, 1.25, 1.35, 2.249, 0.6])
def test_risk_band_rounds_the_binary_value(spark, score):
    assert one(spark, S.risk_band(F.lit(score))) == round(score, 1)


def test_months(spark):
    a, b = (F.lit(d).cast("date") for d in ("2023-11-30", "2024-02-01"))
    assert [d.month for d in one(spark, S.months_between(a, b))] == [11, 12, 1, 2]
    assert one(spark, S.months_between(b, a)) == [] and one(spark, S.days_in_month(b)) == 29


def test_running_and_matches(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 15, 16, 17, 18, 100, 3000])]
    x = F.col("a")
    for r in spark.createDataFrame(rows, "i int, a array<int>").select("a", arrays.running(x).alias("sums"), arrays.running(x, F.greatest).alias("tops")).collect():
        assert r.sums == list(itertools.accumulate(r.a)) and r.tops == list(itertools.accumulate(r.a, max))
    texts = ["x😀 ab12 é34 5", "", "no", "12", "😀" * 500 + "77 8" * 300]
    told = spark.createDataFrame([(t,) for t in texts], "t string").select("t", arrays.matches(F.col("t"), "([0-9])([0-9]*)", (2,)).alias("m"))
    for r in told.collect():
        assert [tuple(m) for m in r.m] == [(m.start(), m.end(), m[0], m[2]) for m in re.finditer("([0-9])([0-9]*)", r.t)]


def test_part_of_a_long_text(spark):
    text = "".join(random.Random(2).choice("aé😀") for _ in range(10_000))
    places = [(0, 0), (0, 5), (4090, 4100), (4096, 8192), (0, 10_000), (3000, 9000), (8191, 8193), (9999, 10_000), (5, 5)]
    rows = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a int, b int")
    for r in rows.withColumn("p", arrays.bind(arrays.chunks(F.col("t")), lambda c: arrays.part(c, F.col("a"), F.col("b")))).collect():
        assert r.p == text[r.a : r.b]


def test_few_rows_are_dealt_to_tasks(spark, tmp_path):
    """One small file whose rows take much work: as many tasks as its rows need, and no shuffle for very few rows."""
    from claimveil.functions.deal import dealt

    spark.range(3000).coalesce(1).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert dealt(t, "id", 100).rdd.getNumPartitions() == 30 and dealt(t, "id", 10**6).rdd.getNumPartitions() == 4
    assert dealt(t.limit(10), "id", 100).rdd.getNumPartitions() == 1 and dealt(t, "id", 100).distinct().count() == 3000


def test_numbers_are_drawn_once(spark):
    """The Poisson number of a claim's category is neither drawn again at each step of its sum nor for a filter."""
    from claimveil.sources import synth

    plan = synth.generate(spark, 100)["claims"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", n) as binary") == 1


def test_notes_are_made_where_orders_are_dealt(spark, tmp_path):
    """Short orders are shuffled, not the texts made of them."""
    from claimveil.sources import adapters

    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, TIMESTAMP '2000-01-01' AS o_orderdate FROM range(3000)").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("notes", "truth", "odd_notes"):
        assert adapters.load(spark, str(tmp_path), name, 100).rdd.getNumPartitions() == 30
    assert sorted(map(tuple, adapters.load(spark, str(tmp_path), "notes", 100).collect())) == sorted(map(tuple, adapters.load(spark, str(tmp_path), "notes").collect()))
