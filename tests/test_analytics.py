import datetime
import math
import re

import pytest
from pyspark.sql import functions as F

from claimveil.operators import analytics as A
from claimveil.sources import synth

DAY = datetime.date.fromisoformat


def months(spark, spans, start="2024-01-01", end="2024-12-31", prorate=True):
    rows = spark.createDataFrame([(m, DAY(a), DAY(b)) for m, a, b in spans], "member_id string, span_start date, span_end date")
    return A.member_months(rows, start, end, prorate)


def total(df):
    return {(r.year, r.month): r.member_months for r in A.spine(df).collect()}


def test_spine(spark):
    assert total(months(spark, [("A", "2024-03-01", "2024-03-15")])) == {(2024, 3): 15 / 31}
    assert math.isclose(sum(total(months(spark, [("A", "2024-01-01", "2024-12-31")])).values()), 12)
    assert math.isclose(sum(total(months(spark, [("A", "2024-01-01", "2024-05-31"), ("A", "2024-09-01", "2024-12-31")])).values()), 9)
    assert total(months(spark, [("A", "2023-11-05", "2024-02-10")], start="2024-01-15")) == {(2024, 1): 1.0, (2024, 2): 10 / 29}
    assert total(months(spark, [("A", "2024-05-10", "2024-04-01"), ("A", "2024-05-10", "2024-05-01")])) == {}
    assert total(months(spark, [("A", "2024-02-01", "2024-02-29")] * 2)) == {(2024, 2): 2.0}
    whole = months(spark, [("A", "2024-03-01", "2024-03-14"), ("B", "2024-04-01", "2024-04-15")], prorate=False)
    assert total(whole) == {(2024, 3): 0.0, (2024, 4): 1.0} and months(spark, []).count() == 0


def claims(spark, rows):
    return spark.createDataFrame([(m, DAY(d), c, 1, float(p)) for m, d, c, p in rows], "member_id string, service_date date, service_category string, units int, paid double").select("member_id", "service_date", "service_category", "units", F.col("paid").cast("decimal(18,2)").alias("paid_amount"))


def test_pmpm(spark):
    spine = A.spine(months(spark, [("A", "2024-01-01", "2024-06-30")]))
    c = claims(spark, [("A", "2024-02-10", "professional", 600), ("A", "2024-09-10", "professional", 5), ("A", "2023-02-10", "professional", 5)])
    monthly = A.pmpm_by_month(c, spine, "2024-01-01", "2024-12-31")
    told = {(r.month, r.category): r for r in monthly.collect()}
    assert told[2, "professional"].pmpm == 600 and told[2, "professional"].util_per_1000 == 1000 and (9, "professional") not in told and told[1, None].paid == 0
    by_total = A.pmpm_by_month(c, spine, "2024-01-01", "2024-12-31", False)
    quarter = A.pmpm_by_quarter(by_total, spine, False).orderBy("quarter").collect()
    assert [r.member_months for r in quarter] == [3, 3] and quarter[0].pmpm == 200 and quarter[1].price_per_service == 0
    naive = A.naive_denominator(spark.createDataFrame([("A",), ("B",)], "member_id string"), spine).first()
    assert naive.naive == 12 and naive.overstatement == 1


def quarters(spark, cells, totals):
    cat = spark.createDataFrame([(2024, q, c, u, p, u * p) for q, c, u, p in cells], "year int, quarter int, category string, util_per_member_month double, price_per_service double, pmpm double")
    tot = spark.createDataFrame([(2024, q, mm, p) for q, mm, p in totals], "year int, quarter int, member_months double, pmpm double")
    return A.decompose(cat, tot).collect(), A.decompose_by_category(cat, tot).collect()


def test_decomposition(spark):
    (price,), _ = quarters(spark, [(1, "i", 0.1, 1000.0), (2, "i", 0.1, 1200.0)], [(1, 1.0, 100.0), (2, 1.0, 120.0)])
    assert math.isclose(price.price_effect, 20) and abs(price.utilisation_effect) < 1e-9 and abs(price.residual) < 1e-9
    (use,), _ = quarters(spark, [(1, "i", 0.1, 1000.0), (2, "i", 0.15, 1000.0)], [(1, 1.0, 100.0), (2, 1.0, 150.0)])
    assert math.isclose(use.utilisation_effect, 50) and abs(use.price_effect) < 1e-9
    (both,), parts = quarters(spark, [(1, "a", 0.1, 500.0), (1, "b", 0.5, 100.0), (2, "a", 0.14, 600.0), (2, "b", 0.45, 120.0), (2, "c", 0.01, 10.0)], [(1, 1000.0, 100.0), (2, 900.0, 138.0)])
    assert math.isclose(both.utilisation_effect + both.price_effect + both.mix_effect + both.residual, 38) and math.isclose(both.member_month_change_pct, -0.1)
    assert {r.category: r.pmpm0 for r in parts}["c"] == 0 and math.isclose({r.category: r.price_ratio for r in parts}["a"], 1.2)


@pytest.mark.parametrize("n", [50, 70, 7, 1])
def test_concentration(spark, n):
    rows = [(f"m{i % n}", "2024-01-05", "x", 1 + (i * 37) % 100) for i in range(3 * n)]
    told = A.cost_concentration(claims(spark, rows), "2024-01-01", "2024-12-31").first()
    spend = {}
    for m, _, _, p in rows:
        spend[m] = spend.get(m, 0) + p
    ordered = sorted(spend.values(), reverse=True)
    for p in A.SHARES:
        k = max(1, round(n * p / 100))
        assert math.isclose(told[f"top_{p}pct_share"], sum(ordered[:k]) / sum(ordered))
    assert told.n_members_with_spend == n and told.total_paid == sum(ordered)


def test_concentration_of_nothing(spark):
    assert A.cost_concentration(claims(spark, []), "2024-01-01", "2024-12-31").count() == 0
    assert A.cost_concentration(claims(spark, [("a", "2024-01-05", "x", 0)]), "2024-01-01", "2024-12-31").first().top_1pct_share is None


def test_shock_is_recovered(spark):
    made = synth.generate(spark, 3000)
    spine = A.spine(A.member_months(made["eligibility"], synth.L.START, synth.L.END))
    monthly, whole = (A.pmpm_by_month(made["claims"], spine, synth.L.START, synth.L.END, c) for c in (True, False))
    q, t = A.pmpm_by_quarter(monthly, spine), A.pmpm_by_quarter(whole, spine, False)
    told = A.decompose(q, t).where("year = 2024 and quarter = 2").first()
    ratio = A.decompose_by_category(q, t).where("year = 2024 and quarter = 2 and category = 'inpatient'").first().price_ratio
    assert told.price_effect > 0 and told.member_month_change_pct < -0.05 and 1.05 < ratio < 1.4
    share = A.naive_denominator(made["members"], spine).first()
    assert 0.84 < share.actual / share.naive < 0.92


def test_risk(spark):
    told = A.risk_context(synth.members(spark, 500)).collect()
    assert len(told) == 6 and all(r.members == 500 and math.isclose(r.prevalence, r.n_members / 500) for r in told)
    assert A.risk_context(synth.members(spark, 0)).first().mean_risk_score == 0


def test_plans(spark):
    spine = A.spine(months(spark, [("A", "2024-01-01", "2024-06-30")]))
    plan = A.pmpm_by_month(claims(spark, []), spine, "2024-01-01", "2024-12-31")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Cartesian|NestedLoop", plan)
