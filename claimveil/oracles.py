"""SQL for the rows of ``queries``, written for DuckDB and apart from the operators.

For notes the answer has a closed form: each template's fields are known, and with them which rules find what.
"""

from __future__ import annotations

from claimveil.queries import END, SALT, START
from claimveil.sources import adapters as X
from claimveil.sources import lexicon as L

ORACLES: dict[str, str] = {}
FIRST_DAY, LAST_DAY = f"DATE '{START}'", f"DATE '{END}'"


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({ {**{k: v[0] for k, v in X.SOURCES.items()}, **VIEWS}[n]})" for n in names)


def add(name: str, views: str, sql: str, ints: str = "", reals: str = "", others: str = "") -> None:
    """Registers SQL with its columns cast like ``queries.tidy`` does."""
    told = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()] + [f'floor(CAST("{c}" AS DOUBLE) * 1e6 + 0.5) / 1e6 AS "{c}"' for c in reals.split()] + [f'"{c}"' for c in others.split()]
    ORACLES[name] = f"{_with(*views.split())} SELECT {', '.join(told)} FROM ({sql}) t" if views else f"SELECT {', '.join(told)} FROM ({sql}) t"


def _key(x: str, prefix: str = "MBR") -> str:
    return f"concat('{prefix}-', upper(substr(sha256(concat('{SALT}', {x})), 1, 10)))"


def _days(x: str) -> str:
    return f"(-(CAST(concat('0x', substr(sha256(concat('{SALT}date', {x})), 1, 8)) AS BIGINT) % 364) - 1)"


_BAND = "CASE WHEN age >= 90 THEN '90+' ELSE concat(age - age % 5, '-', age - age % 5 + 4) END"
_COARSE = "CASE WHEN age >= 90 THEN '90+' ELSE concat(age - age % 10, '-', age - age % 10 + 9) END"
_ZIP3 = "CASE WHEN substr(zip5, 1, 3) IN ('059', '823', '889') THEN '000' ELSE substr(zip5, 1, 3) END"
_CONDITIONS = ["cond_chf", "cond_copd", "cond_diabetes_complication", "cond_ckd_severe", "cond_cancer", "cond_vascular"]


#: Days are counted in parts of a month that divide all months, money in decimals, so that sums don't depend on order.
PARTS = 377580


def _mm(part: str) -> str:
    return f"""
SELECT member_id, year(m) AS year, month(m) AS month, CAST(sum({part}) AS BIGINT) AS parts FROM (
  SELECT member_id, m, date_diff('day', greatest(span_start, m), least(span_end, last_day(m))) + 1 AS days FROM (
    SELECT member_id, span_start, span_end,
           CAST(unnest(generate_series(date_trunc('month', greatest(span_start, {FIRST_DAY})), date_trunc('month', least(span_end, {LAST_DAY})), INTERVAL 1 MONTH)) AS DATE) AS m
    FROM eligibility) a) b WHERE days > 0 GROUP BY ALL"""


VIEWS = {
    "mm": _mm(f"days * ({PARTS} // day(last_day(m)))"),
    "spine": f"SELECT year, month, sum(parts) AS parts, sum(parts) / {PARTS} AS member_months FROM mm GROUP BY year, month HAVING sum(parts) > 0",
    "paid": f"""SELECT year(service_date) AS year, month(service_date) AS month, service_category AS category, sum(paid_amount) AS paid, count(*) AS services
                FROM claims WHERE service_date BETWEEN {FIRST_DAY} AND {LAST_DAY} GROUP BY ALL""",
    "monthly": "SELECT s.year, s.month, category, member_months, coalesce(paid, 0) AS paid, coalesce(services, 0) AS services FROM spine s LEFT JOIN paid p ON s.year = p.year AND s.month = p.month",
    "qmm": f"SELECT year, (month + 2) // 3 AS quarter, sum(parts) / {PARTS} AS member_months FROM spine GROUP BY ALL",
    "qcat": """SELECT q.year, q.quarter, category, max(q.member_months) AS mm, sum(paid) AS paid, sum(services) AS services FROM monthly m
               JOIN qmm q ON q.year = m.year AND q.quarter = (m.month + 2) // 3 WHERE category IS NOT NULL GROUP BY ALL""",
    "cells": "SELECT year * 4 + quarter AS t, category, services / mm AS u, CASE WHEN services > 0 THEN CAST(paid AS DOUBLE) / services ELSE 0 END AS p, CAST(paid AS DOUBLE) / mm AS pmpm FROM qcat",
    "qtot": "SELECT q.year * 4 + q.quarter AS t, q.year, q.quarter, q.member_months AS mm, CAST(coalesce(sum(paid), 0) AS DOUBLE) / max(q.member_months) AS pmpm FROM qmm q LEFT JOIN qcat c ON c.year = q.year AND c.quarter = q.quarter GROUP BY q.year, q.quarter, q.member_months",
    "pairs": """SELECT coalesce(a.t, b.t - 1) AS t, coalesce(a.category, b.category) AS category, coalesce(a.u, 0) AS u0, coalesce(b.u, 0) AS u1, coalesce(a.p, 0) AS p0,
                coalesce(b.p, 0) AS p1, coalesce(a.pmpm, 0) AS pmpm0, coalesce(b.pmpm, 0) AS pmpm1 FROM cells a FULL JOIN cells b ON b.t = a.t + 1 AND a.category = b.category""",
    "released": f"SELECT {_key('member_id')} AS member_key, {_ZIP3} AS zip3, state, {_BAND} AS age_band, {_COARSE} AS coarse, sex, risk_score, {', '.join(_CONDITIONS)} FROM members",
    "roll": f"""SELECT name, zip5, state, age, sex, true_member_id, substr(zip5, 1, 3) AS zip3, {_BAND} AS age_band FROM (
                SELECT concat(first_name, ' ', last_name) AS name, zip5, state, age, sex, member_id AS true_member_id FROM members WHERE bucket < 17
                UNION ALL SELECT concat(first_name, ' ', last_name), zip5, state, age + 5, sex, concat('X', member_id) FROM members WHERE bucket = 5) r""",
    "hits": """SELECT released, a.zip3, a.sex, a.age_band, n_roll, CASE WHEN n_roll = 1 THEN name END AS guessed_name, CASE WHEN n_roll = 1 THEN tid END AS true_member_id
               FROM (SELECT zip3, sex, age_band, min(member_key) AS released FROM released GROUP BY ALL HAVING count(*) = 1) a
               JOIN (SELECT zip3, sex, age_band, count(*) AS n_roll, min(name) AS name, min(true_member_id) AS tid FROM roll GROUP BY ALL) b
               ON a.zip3 = b.zip3 AND a.sex = b.sex AND a.age_band = b.age_band""",
}
VIEWS["mm_whole"] = _mm(f"CASE WHEN days >= 15 THEN {PARTS} ELSE 0 END")

add("member_month_spine", "eligibility mm", f"SELECT year, month, sum(parts) / {PARTS} AS member_months FROM mm GROUP BY year, month", "year month", "member_months")
add("member_month_spine_whole_month", "eligibility mm_whole", f"SELECT year, month, sum(parts) / {PARTS} AS member_months FROM mm_whole GROUP BY year, month", "year month", "member_months")
add("member_month_by_member", "eligibility mm", f"SELECT *, parts / {PARTS} AS member_months FROM mm", "year month", "member_months", "member_id")
add("naive_vs_actual_mm", "members eligibility mm spine", f"""
  SELECT n_members, n_months, actual, n_members * n_months AS naive, n_members * n_months / actual - 1 AS overstatement, 1 - actual / (n_members * n_months) AS pmpm_understatement
  FROM (SELECT count(*) AS n_members FROM members) a, (SELECT count(*) AS n_months, sum(parts) / {PARTS} AS actual FROM spine) b""", "n_members n_months", "actual naive overstatement pmpm_understatement")  # fmt: skip
_MONTHLY = "CAST(paid AS DOUBLE) / member_months AS pmpm, services / member_months * 1000 AS util_per_1000, CASE WHEN services > 0 THEN CAST(paid AS DOUBLE) / services ELSE 0 END AS price_per_service"
_BASE = "eligibility claims mm spine paid monthly"
add("pmpm_month_category", _BASE, f"SELECT year, month, category, member_months, paid, services, {_MONTHLY} FROM monthly", "year month services", "member_months paid pmpm util_per_1000 price_per_service", "category")
add("pmpm_month_total", _BASE, f"SELECT *, {_MONTHLY} FROM (SELECT year, month, member_months, sum(paid) AS paid, sum(services) AS services FROM monthly GROUP BY ALL) m", "year month services", "member_months paid pmpm util_per_1000 price_per_service")
_QUARTERLY = "CAST(paid AS DOUBLE) / mm AS pmpm, services / mm AS util_per_member_month, CASE WHEN services > 0 THEN CAST(paid AS DOUBLE) / services ELSE 0 END AS price_per_service"
add("pmpm_quarter_category", _BASE + " qmm qcat", f"SELECT year, quarter, category, mm AS member_months, paid, services, {_QUARTERLY} FROM qcat", "year quarter services", "member_months paid pmpm util_per_member_month price_per_service", "category")
add("pmpm_quarter_total", _BASE + " qmm qcat", f"""SELECT year, quarter, mm AS member_months, paid, services, {_QUARTERLY} FROM (
  SELECT q.year, q.quarter, q.member_months AS mm, coalesce(sum(paid), 0) AS paid, coalesce(sum(services), 0) AS services FROM qmm q
  LEFT JOIN qcat c ON c.year = q.year AND c.quarter = q.quarter GROUP BY ALL) x""", "year quarter services", "member_months paid pmpm util_per_member_month price_per_service")  # fmt: skip
_CHANGES = _BASE + " qmm qcat cells qtot pairs"
add("pmpm_decomposition", _CHANGES, """
  SELECT year, quarter, pmpm_0, pmpm_1, c AS actual_change, CASE WHEN pmpm_0 <> 0 THEN c / pmpm_0 ELSE 0 END AS pct_change, mm0 AS member_months_0, mm1 AS member_months_1,
         CASE WHEN mm0 <> 0 THEN (mm1 - mm0) / mm0 ELSE 0 END AS member_month_change_pct, ue AS utilisation_effect, pe AS price_effect, me AS mix_effect, c - ue - pe - me AS residual,
         CASE WHEN c <> 0 THEN ue / c ELSE 0 END AS utilisation_share, CASE WHEN c <> 0 THEN pe / c ELSE 0 END AS price_share, CASE WHEN c <> 0 THEN me / c ELSE 0 END AS mix_share
  FROM (SELECT a.year, a.quarter, a.pmpm AS pmpm_0, b.pmpm AS pmpm_1, a.mm AS mm0, b.mm AS mm1, b.pmpm - a.pmpm AS c,
               coalesce(ue, 0) AS ue, coalesce(pe, 0) AS pe, coalesce(me, 0) AS me
        FROM qtot a JOIN qtot b ON b.t = a.t + 1 LEFT JOIN (
          SELECT t, (max(U1) - max(U0)) * sum(s0 * p0) AS ue, max(U0) * sum(s0 * (p1 - p0)) AS pe, max(U0) * sum((s1 - s0) * p0) AS me
          FROM (SELECT *, CASE WHEN U0 <> 0 THEN u0_ / U0 ELSE 0 END AS s0, CASE WHEN U1 <> 0 THEN u1_ / U1 ELSE 0 END AS s1
                FROM (SELECT t, p0, p1, u0 AS u0_, u1 AS u1_, sum(u0) OVER (PARTITION BY t) AS U0, sum(u1) OVER (PARTITION BY t) AS U1 FROM pairs) y) z GROUP BY t) e ON e.t = a.t) w
  """, "year quarter", "pmpm_0 pmpm_1 actual_change pct_change member_months_0 member_months_1 member_month_change_pct utilisation_effect price_effect mix_effect residual utilisation_share price_share mix_share")  # fmt: skip
add("pmpm_decomposition_category", _CHANGES, """
  SELECT a.year, a.quarter, category, u0 * (p1 - p0) AS price_effect, (u1 - u0) * p0 AS util_effect, pmpm0, pmpm1, CASE WHEN p0 <> 0 THEN p1 / p0 ELSE 0 END AS price_ratio
  FROM pairs JOIN qtot a ON a.t = pairs.t JOIN qtot b ON b.t = a.t + 1""", "year quarter", "price_effect util_effect pmpm0 pmpm1 price_ratio", "category")  # fmt: skip
add("cost_concentration", "claims", f"""
  SELECT {', '.join(f"sum(s) FILTER (rn <= greatest(1, round_even(n * {p} / 100.0, 0))) / max(t) AS top_{p}pct_share" for p in (1, 5, 10, 20, 50))}, max(n) AS n_members_with_spend, max(t) AS total_paid
  FROM (SELECT CAST(s AS DOUBLE) AS s, row_number() OVER (ORDER BY s DESC) AS rn, count(*) OVER () AS n, CAST(sum(s) OVER () AS DOUBLE) AS t
        FROM (SELECT member_id, sum(paid_amount) AS s FROM claims WHERE service_date BETWEEN {FIRST_DAY} AND {LAST_DAY} GROUP BY 1) a) b HAVING count(*) > 0
  """, "n_members_with_spend", " ".join(f"top_{p}pct_share" for p in (1, 5, 10, 20, 50)) + " total_paid")  # fmt: skip
add("risk_context", "members", " UNION ALL ".join(
  f"SELECT '{code}' AS code, '{text}' AS description, {weight} AS coefficient, count(*) FILTER (cond_{c}) AS n_members, count(*) FILTER (cond_{c}) / count(*) AS prevalence, avg(risk_score) AS mean_risk_score, count(*) AS members FROM members"
  for c, (code, text, weight) in L.CONDITIONS.items()), "n_members members", "coefficient prevalence mean_risk_score", "code description")
add("deidentify_member", "members", f"SELECT {_key('member_id')} AS member_key, {_ZIP3} AS zip3, state, {_BAND} AS age_band, sex, {_days('member_id')} AS date_offset_days FROM members", "date_offset_days", "", "member_key zip3 state age_band sex")
add("released_extract", "members released", "SELECT *, round(CAST(printf('%.1f', risk_score) AS DOUBLE), 1) AS risk_score_band FROM released", "", "risk_score_band", "member_key zip3 state age_band sex " + " ".join(_CONDITIONS))
add("governed_claims", "claims", f"SELECT {_key('member_id')} AS member_key, CAST(service_date + CAST({_days('member_id')} AS INTEGER) AS VARCHAR) AS service_date, claim_id, service_category, units, paid_amount FROM claims", "units", "paid_amount", "member_key service_date claim_id service_category")
add("pseudonym_customer", "", f"SELECT c_custkey, {_key('c_name', 'ID')} AS pseudonym, {_key('c_custkey', 'MRN')} AS mrn_pseudonym FROM customer", "c_custkey", "", "pseudonym mrn_pseudonym")
add("patient_offset", "members", f"SELECT member_id, {_days('member_id')} AS days FROM members", "days", "", "member_id")
add("shift_order_dates", "", f"""
  SELECT o_orderkey, CAST(d + n AS VARCHAR) AS shifted, CASE WHEN o_orderkey % 3 < 2 THEN CAST(d + n AS VARCHAR) ELSE concat('on ', d) END AS shifted_text
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST({_days('o_custkey')} AS INTEGER) AS n FROM orders) x""", "o_orderkey", "", "shifted shifted_text")  # fmt: skip
add("age_band", "members", f"SELECT age, {_BAND} AS band, {_COARSE} AS coarse, count(*) AS n FROM members GROUP BY ALL", "age n", "", "band coarse")
add("zip3_generalise", "members", f"SELECT zip5, {_ZIP3} AS zip3, concat({_ZIP3}, 'XX') AS in_text, '***' AS dropped, count(*) AS n FROM members GROUP BY ALL", "n", "", "zip5 zip3 in_text dropped")


def _risk(qis: str, extra: str = "", rows: str = "released", where: str = "TRUE") -> str:
    return f"""SELECT {extra} coalesce(sum(size), 0) AS n_records, count(*) AS n_classes, coalesce(min(size), 0) AS min_k, coalesce(sum(size) FILTER (size = 1), 0) AS records_with_k_1,
      coalesce(sum(size) FILTER (size < 5), 0) AS records_with_k_under_5, coalesce(coalesce(sum(size) FILTER (size = 1), 0) / sum(size), 0) AS pct_unique,
      coalesce(coalesce(sum(size) FILTER (size < 5), 0) / sum(size), 0) AS pct_under_5 FROM (SELECT {qis}, count(*) AS size FROM {rows} GROUP BY ALL) x WHERE {where}"""


_RISK_INTS, _RISK_REALS = "n_records n_classes min_k records_with_k_1 records_with_k_under_5", "pct_unique pct_under_5"
_DEMO = "zip3, sex, age_band"
_RUNGS = ["state", "state, sex", "state, sex, age_band", _DEMO, f"{_DEMO}, cond_ckd_severe", f"{_DEMO}, {', '.join(_CONDITIONS)}"]
_MR = "members released"
add("k_anonymity", _MR, _risk(_DEMO), _RISK_INTS, _RISK_REALS)
add("k_anonymity_ladder", _MR, " UNION ALL ".join(_risk(q, f"{k + 1} AS rung,") for k, q in enumerate(_RUNGS)), "rung " + _RISK_INTS, _RISK_REALS)
add("k_size_histogram", _MR, f"SELECT size, count(*) AS n_classes FROM (SELECT {_RUNGS[5]}, count(*) AS size FROM released GROUP BY ALL) x GROUP BY size ORDER BY size LIMIT 10", "size n_classes")
add("external_roll", "members roll", "SELECT * FROM roll", "age", "", "name zip5 state sex true_member_id zip3 age_band")
_LINK = "members released roll hits"
add("linkage_attack", _LINK, """SELECT n_released, n_roll, n_reidentified, a AS n_unique_but_ambiguous_in_roll, coalesce(n_reidentified / n_released, 0) AS rate FROM
  (SELECT count(*) AS n_released FROM released) x, (SELECT count(*) AS n_roll FROM roll) y, (SELECT count(*) FILTER (n_roll = 1) AS n_reidentified, count(*) FILTER (n_roll > 1) AS a FROM hits) z""",
  "n_released n_roll n_reidentified n_unique_but_ambiguous_in_roll", "rate")
add("linkage_hits", _LINK, "SELECT * FROM hits", "n_roll", "", "released zip3 sex age_band guessed_name true_member_id")
add("linkage_first_hits", _LINK, "SELECT * FROM hits WHERE true_member_id IS NOT NULL ORDER BY released LIMIT 5", "n_roll", "", "released zip3 sex age_band guessed_name true_member_id")
add("verify_attack", _LINK, f"""SELECT count(*) AS n_checked, count(*) FILTER (m.member_id = h.true_member_id) AS n_correct, coalesce(count(*) FILTER (m.member_id = h.true_member_id) / count(*), 0) AS precision
  FROM (SELECT * FROM hits WHERE true_member_id IS NOT NULL) h LEFT JOIN members m ON {_key('m.member_id')} = h.released""", "n_checked n_correct", "precision")  # fmt: skip


def _targets() -> str:
    rows = []
    for k, names in enumerate([[], ["cancer"], ["chf"], ["ckd_severe"], ["cancer", "ckd_severe"]]):
        qis = ", ".join([_DEMO, *[f"cond_{c}" for c in names]])
        risk = "pct_unique AS carriers_pct_unique, CAST(NULL AS DOUBLE) AS prevalence"
        if len(names) == 1:
            own = f"cond_{names[0]}"
            alone = f"(SELECT coalesce(coalesce(sum(size) FILTER (size = 1), 0) / sum(size), 0) FROM (SELECT {qis}, count(*) AS size FROM released GROUP BY ALL) y WHERE {own})"
            risk = f"{alone} AS carriers_pct_unique, (SELECT count(*) FILTER ({own}) / count(*) FROM released) AS prevalence"
        rows.append(f"SELECT r.*, {risk}, {k + 1} AS target, '{'+'.join(names) or 'none'}' AS known FROM ({_risk(qis)}) r")
    return " UNION ALL ".join(rows)


add("targeted_attack", _MR, _targets(), _RISK_INTS + " target", _RISK_REALS + " carriers_pct_unique prevalence", "known")
add("generalise_to_k", _MR, "SELECT member_key, zip3, sex, coarse AS age_band, count(*) OVER (PARTITION BY zip3, sex, coarse) >= 5 AS kept FROM released", "", "", "member_key zip3 sex age_band kept")
add("generalise_to_k_steps", _MR, " UNION ALL ".join(f"""SELECT '{name}' AS step, 5 AS k, count(*) AS n_in, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_suppressed,
  coalesce(count(*) FILTER (NOT kept) / count(*), 0) AS suppression_rate FROM (SELECT count(*) OVER (PARTITION BY {by}) >= 5 AS kept FROM released) x"""
  for name, by in (("as released", "zip3, sex, age_band"), ("10-year age bands", "zip3, sex, coarse"), ("10-year age bands, ZIP dropped", "sex, coarse"))),
  "k n_in n_kept n_suppressed", "suppression_rate", "step")
add("external_roll_hashed", "members", f"""SELECT concat(first_name, ' ', last_name) AS name, zip5, state, age, sex, member_id AS true_member_id, substr(zip5, 1, 3) AS zip3, {_BAND} AS age_band FROM members
  WHERE CAST(('0x' || substr(md5(concat('99:', member_id)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) <= 0.85""", "age", "", "name zip5 state sex true_member_id zip3 age_band")  # fmt: skip


def _rung(n: int, qis: str) -> str:
    return f"""SELECT {n} AS rung, (SELECT count(*) FROM released) AS n_released, (SELECT count(*) FROM roll) AS n_roll, count(*) FILTER (b.n = 1) AS n_reidentified,
      count(*) FILTER (b.n > 1) AS n_unique_but_ambiguous_in_roll FROM (SELECT {qis} FROM released GROUP BY ALL HAVING count(*) = 1) a JOIN (SELECT {qis}, count(*) AS n FROM roll GROUP BY ALL) b USING ({qis})"""


add("attack_rungs", "members released roll", f"""SELECT *, n_reidentified / n_released AS rate, rung = arg_max(rung, n_reidentified * 10 - rung) OVER () AS is_best
  FROM ({" UNION ALL ".join(_rung(n, q) for n, q in ((3, "state, sex, age_band"), (4, _DEMO), (5, _DEMO)))}) r""", "rung n_released n_roll n_reidentified n_unique_but_ambiguous_in_roll", "rate", "is_best")  # fmt: skip
_GAPS = "SELECT * REPLACE (nullif({zip3}, '000') AS zip3, nullif(age_band, '90+') AS age_band) FROM {name}"


def _rung_with_gaps(n: int, qis: str) -> str:
    same = " AND ".join(f"a.{q} IS NOT DISTINCT FROM b.{q}" for q in qis.split(", "))
    return f"""SELECT {n} AS rung, (SELECT count(*) FROM released) AS n_released, (SELECT count(*) FROM roll) AS n_roll, count(*) FILTER (b.n = 1) AS n_reidentified,
      count(*) FILTER (b.n > 1) AS n_unique_but_ambiguous_in_roll FROM (SELECT {qis} FROM ({_GAPS.format(zip3='zip3', name='released')}) x GROUP BY ALL HAVING count(*) = 1) a
      JOIN (SELECT {qis}, count(*) AS n FROM ({_GAPS.format(zip3=_ZIP3, name='roll')}) x GROUP BY ALL) b ON {same}"""


add("attack_rungs_with_gaps", "members released roll", f"""SELECT *, n_reidentified / n_released AS rate, rung = arg_max(rung, n_reidentified * 10 - rung) OVER () AS is_best
  FROM ({" UNION ALL ".join(_rung_with_gaps(n, q) for n, q in ((1, "state"), (2, "state, sex"), (3, "state, sex, age_band"), (4, _DEMO), (5, _DEMO)))}) r""",
  "rung n_released n_roll n_reidentified n_unique_but_ambiguous_in_roll", "rate", "is_best")


def _hits(n: int, qis: str) -> str:
    told = ", ".join(q if q in qis.split(", ") else f"NULL AS {q}" for q in ("age_band", "sex", "state", "zip3"))
    return f"""SELECT {n} AS "set", released, {told}, n AS n_roll, CASE WHEN n = 1 THEN name END AS guessed_name, CASE WHEN n = 1 THEN id END AS true_member_id
      FROM (SELECT {qis}, min(member_key) AS released FROM released GROUP BY {qis} HAVING count(*) = 1) a JOIN (SELECT {qis}, count(*) AS n, min(name) AS name, min(true_member_id) AS id FROM roll GROUP BY {qis}) b USING ({qis})"""


add("linkage_sets", "members released roll", f"{_hits(1, _DEMO)} UNION ALL {_hits(2, 'state, sex, age_band')}", "set n_roll", "", "released age_band sex state zip3 guessed_name true_member_id")
_SICK = ", ".join(_CONDITIONS)
add("generalise_to_k_profile", _MR, " UNION ALL ".join(f"""SELECT {n} AS number, '{name}' AS step, 5 AS k, sum(size) AS n_in, coalesce(sum(size) FILTER (size >= 5), 0) AS n_kept, coalesce(sum(size) FILTER (size < 5), 0) AS n_suppressed,
  coalesce(sum(size) FILTER (size < 5), 0) / sum(size) AS suppression_rate, coalesce(min(size) FILTER (size >= 5), 0) AS min_k_after FROM (SELECT count(*) AS size FROM released GROUP BY {by}, {_SICK}) x"""
  for n, (name, by) in enumerate((("as released", "zip3, sex, age_band"), ("10-year age bands", "zip3, sex, coarse"), ("10-year age bands, ZIP dropped", "sex, coarse")), 1)),
  "number k n_in n_kept n_suppressed min_k_after", "suppression_rate", "step")
add("zip3_of_area_table", "members", """SELECT member_id, zip5, CASE WHEN substr(zip5, 1, 3) IN (SELECT substr(zip5, 1, 3) FROM members WHERE bucket < 10 GROUP BY 1 HAVING count(*) <= 20) THEN '000' ELSE substr(zip5, 1, 3) END AS zip3 FROM members""",
  "", "", "member_id zip5 zip3")
add("effects_ordered", _CHANGES, """SELECT *, row_number() OVER (PARTITION BY year, quarter ORDER BY floor(abs(price_effect) * 1e6 + 0.5) DESC, category) AS place FROM (
  SELECT a.year, a.quarter, category, u0 * (p1 - p0) AS price_effect FROM pairs JOIN qtot a ON a.t = pairs.t JOIN qtot b ON b.t = a.t + 1) x""", "year quarter place", "price_effect", "category")  # fmt: skip

# Any texts. They are first told in ASCII, character by character: letters of other scripts as word characters, spaces as
# spaces, all else as a sign; so these regular expressions see the same words as Unicode's rules. Rules follow each other,
# and each keeps what overlaps nothing kept before; a rule's own matches never overlap.
_SPACES, _WORDS = r"[\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", r"\pL\pM\p{Nd}\p{Nl}\p{Pc}"


def _rules() -> list[tuple[str, str, tuple[int, ...], int]]:
    """Type, pattern, named groups and number of groups of each rule."""
    names = {*L.SURNAMES_KNOWN, *L.SURNAME_DECOYS, *L.FIRST_KNOWN, *L.FIRST_DECOYS} - set(L.STOP_WORDS)
    words = [("address", rf"\b(?:{'|'.join(L.GAZETTEER_CITIES)})\b"), ("name", rf"\b(?:{'|'.join(sorted(names))})\b")]
    plain = [(kind, p, (), 0) for kind, p in L.PATTERNS]
    return plain + [("name", p, g, p.count("(") - p.count("(?:")) for p, g in L.CONTEXTS] + [(kind, p, (), 0) for kind, p in words]


def _candidates(rank: int, kind: str, pattern: str, groups: tuple[int, ...], n: int) -> str:
    p = pattern.replace("'", "''")
    parts = "".join(f", unnest(regexp_extract_all(t, '{p}', {k})) AS g{k}" for k in range(1, n + 1))
    found = f"""SELECT doc_id, sum(length(gap)) OVER o + sum(length(m)) OVER o - length(m) AS s, m{''.join(f', g{k}' for k in range(1, n + 1))} FROM (
      SELECT doc_id, unnest(range(len(ms))) AS i, unnest(gaps[1:len(ms)]) AS gap, unnest(ms) AS m{parts} FROM (
        SELECT doc_id, t, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS ms FROM ascii) x) y WINDOW o AS (PARTITION BY doc_id ORDER BY i)"""
    if not groups:
        return f"SELECT doc_id, {rank} AS rank, '{kind}' AS type, s, s + length(m) AS e FROM ({found}) f"
    stops, rows = "', '".join(L.STOP_WORDS), []
    for k in groups:
        before = " + ".join(["s", *[f"length(g{j})" for j in range(1, k)]])
        rows.append(f"SELECT doc_id, {rank} AS rank, '{kind}' AS type, {before} AS s, {before} + length(g{k}) AS e FROM ({found}) f WHERE g{k} NOT IN ('{stops}')")
    return " UNION ALL ".join(rows)


def _texts(source: str, told: str, names: str | None = None) -> str:
    """SQL over spans(doc_id, text, type, s, e) of the texts (doc_id, text) that source tells; names: SQL for the words that are names."""
    rules = _rules()
    if names:
        rules[-1] = ("name", r"\b[A-Z][a-z]+\b", (), 0)
    views = [
        f"texts AS MATERIALIZED ({source})",
        f"ascii AS MATERIALIZED (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_SPACES}', ' ', 'g'), '[^\\x00-\\x7f{_WORDS}]', chr(1), 'g'), '[^\\x00-\\x7f]', '_', 'g') AS t FROM texts WHERE text IS NOT NULL)",
    ]
    for k, rule in enumerate(rules):
        found = _candidates(k, *rule)
        if names and k == len(rules) - 1:
            found = found.replace(") f", f") f WHERE m IN ({names})")
        views.append(f"c{k} AS MATERIALIZED ({found})")
        kept = f"SELECT * FROM c{k} c WHERE NOT EXISTS (SELECT 1 FROM k{k - 1} x WHERE x.doc_id = c.doc_id AND x.s < c.e AND c.s < x.e)" if k else "SELECT * FROM c0"
        views.append(f"k{k} AS MATERIALIZED ({f'SELECT * FROM k{k - 1} UNION ALL ' if k else ''}{kept})")
    views.append(f"spans AS (SELECT k.doc_id, text, type, s, e, substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)) AS value FROM k{len(rules) - 1} k JOIN texts USING (doc_id))")
    return f"WITH {', '.join(views)} {told}"


def _becomes() -> str:
    masks = " ".join(f"WHEN '{kind}' THEN '{mask}'" for kind, mask in L.MASKS.items())
    day = f"coalesce(strftime(CAST(try_strptime(value, ['%Y-%m-%d', '%m/%d/%Y']) AS DATE) + CAST({_days('doc_id')} AS INTEGER), '%m/%d/%Y'), '[DATE]')"
    area = "CASE WHEN substr(value, 1, 3) IN ('059', '823', '889') THEN '000XX' ELSE concat(substr(value, 1, 3), 'XX') END"
    keys = " ".join(f"WHEN '{kind}' THEN {_key('value', prefix)}" for kind, prefix in (("name", "NAME"), ("mrn", "MRN"), ("member_id", "MBR")))
    return f"CASE type {masks} {keys} WHEN 'zip' THEN {area} WHEN 'date' THEN {day} ELSE '[REDACTED]' END"


_REDACTED = f"""
  SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(CASE WHEN n IS NULL THEN t.text ELSE concat(head, substr(t.text, CAST(last + 1 AS BIGINT))) END) AS clean_sha256
  FROM texts t LEFT JOIN (
    SELECT doc_id, count(*) AS n, max(e) AS last, string_agg(concat(substr(text, CAST(before + 1 AS BIGINT), CAST(s - before AS BIGINT)), {_becomes()}), '' ORDER BY s) AS head
    FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans) p GROUP BY doc_id) r USING (doc_id)"""
_DOCUMENTS = "SELECT doc_id, text FROM documents"
ORACLES["detect_counts_documents"] = _texts(_DOCUMENTS, "SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM spans GROUP BY type")
ORACLES["redact_documents"] = _texts(_DOCUMENTS, _REDACTED)
_STOPS = "', '".join(L.STOP_WORDS)
ORACLES["detect_names_of_table"] = _texts(
    _DOCUMENTS, "SELECT doc_id, type, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM spans GROUP BY doc_id, type",
    f"SELECT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) x WHERE regexp_full_match(w, '[A-Z][a-z]{{2,}}') AND w NOT IN ('{_STOPS}')",
)
ORACLES["redact_odd_notes"] = _texts(X.ODD_NOTES, _REDACTED)

# Notes. Which fields are found, by template: names beside a context always, others if the gazetteer has them.
_NAMES = "', '".join([*L.SURNAMES_KNOWN, *L.FIRST_KNOWN])
_CITIES = "', '".join(L.GAZETTEER_CITIES)
_NO_CONTEXT = {(3, "first"), (3, "last"), (7, "first"), (7, "last")}


def _found(template: int, field: str) -> str:
    """SQL for whether a planted field is found."""
    if (template, field) in _NO_CONTEXT:
        return f"{X.FIELDS[field]} IN ('{_NAMES}')"
    return f"{X.FIELDS[field]} IN ('{_CITIES}')" if field == "city" else "TRUE"


def _also(template: int, dept: str) -> list[tuple[str, str, str]]:
    """Other words that are taken for names: offset in the department, word, and when."""
    if template == 1:  # two capitalised words after "to"
        two = f"{dept} LIKE '% %'"
        return [("0", f"split_part({dept}, ' ', 1)", two), (f"length(split_part({dept}, ' ', 1)) + 1", f"split_part({dept}, ' ', 2)", two)]
    return [("0", "'Harris'", f"{dept} LIKE 'Harris %'")]


def _detected() -> str:
    rows = []
    for t, text in enumerate(L.NOTE_TEMPLATES):
        parts = X.pieces(text)
        for k, (_, field) in enumerate(parts):
            before = " + ".join(f"length({X.sql_of(p)})" for p in parts[:k]) or "0"
            told = []
            if field in L.FIELD_TYPES:
                value = f"concat({X.FIELDS[field]}, '.')" if field == "url" else X.FIELDS[field]  # a URL ends at white space
                told = [(before, L.FIELD_TYPES[field], value, _found(t, field))]
            elif field == "dept":
                told = [(f"{before} + {at}", "name", word, when) for at, word, when in _also(t, X.FIELDS["dept"])]
            rows += [f"SELECT {X.NOTE_ID} AS note_id, {s} AS s, '{kind}' AS type, {v} AS value FROM orders WHERE {X.TEMPLATE} = {t} AND {when}" for s, kind, v, when in told]
    return 'SELECT note_id, s AS "start", s + length(value) AS "end", type, value FROM (' + " UNION ALL ".join(rows) + ") x"


def _replaced(field: str) -> str:
    kind, value = L.FIELD_TYPES[field], X.FIELDS[field]
    if kind in L.MASKS:
        return f"'{L.MASKS[kind]}'"
    if kind == "zip":
        return f"CASE WHEN substr({value}, 1, 3) IN ('059', '823', '889') THEN '000XX' ELSE concat(substr({value}, 1, 3), 'XX') END"
    if kind == "date":
        return f"strftime(CAST(o_orderdate AS DATE) + CAST({_days(X.FIELDS['member_id'])} AS INTEGER), '%m/%d/%Y')"
    return _key(value, {"name": "NAME", "mrn": "MRN", "member_id": "MBR"}[kind])


def _clean() -> str:
    cases = []
    for t, text in enumerate(L.NOTE_TEMPLATES):
        parts, told = X.pieces(text), []
        for k, (lit, field) in enumerate(parts):
            if field in L.FIELD_TYPES:
                told.append(f"CASE WHEN {_found(t, field)} THEN {_replaced(field)} ELSE {X.FIELDS[field]} END")
            elif field == "dept":
                d, first, second = X.FIELDS["dept"], f"split_part({X.FIELDS['dept']}, ' ', 1)", f"split_part({X.FIELDS['dept']}, ' ', 2)"
                if t == 1:
                    told.append(f"CASE WHEN {d} LIKE '% %' THEN concat({_key(first, 'NAME')}, ' ', {_key(second, 'NAME')}, substr({d}, length({first}) + length({second}) + 2)) ELSE {d} END")
                else:
                    told.append(f"replace({d}, 'Harris', {_key(chr(39) + 'Harris' + chr(39), 'NAME')})")
            elif k and parts[k - 1][1] == "url":  # the URL took the full stop
                told.append("'" + lit.removeprefix(".") + "'")
            else:
                told.append(X.sql_of((lit, field)))
        cases.append(f"WHEN {t} THEN concat({', '.join(told)})")
    return f"SELECT {X.NOTE_ID} AS note_id, CASE {X.TEMPLATE} {' '.join(cases)} END AS clean FROM orders"


VIEWS["detected"] = _detected()
VIEWS["outcomes"] = """
  SELECT t.type, CAST(d.note_id IS NOT NULL AS INT) AS tp, CAST(d.note_id IS NULL AS INT) AS fn, 0 AS fp
  FROM truth t LEFT JOIN detected d ON d.note_id = t.note_id AND d."start" < t."end" AND t."start" < d."end"
  UNION ALL SELECT d.type, 0, 0, 1 FROM detected d LEFT JOIN truth t ON d.note_id = t.note_id AND d."start" < t."end" AND t."start" < d."end" WHERE t.note_id IS NULL"""
add("detect_spans", "detected", "SELECT * FROM detected", "start end", "", "note_id type value")
add("detect_notes_by_type", "detected", "SELECT type, count(*) AS n_spans, count(DISTINCT note_id) AS n_notes FROM detected GROUP BY type", "n_spans n_notes", "", "type")
add("redact_notes", "", _clean(), "", "", "note_id clean")
add("score_by_type", "truth detected outcomes", """SELECT type, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tp + fn) AS n_truth, sum(tp) / nullif(sum(tp + fn), 0) AS recall,
  sum(tp) / nullif(sum(tp + fp), 0) AS precision FROM outcomes GROUP BY type""", "tp fn fp n_truth", "recall precision", "type")  # fmt: skip
ORACLES["score_relational"] = ORACLES["score_by_type"]
add("score_within_tolerance", "truth detected", """SELECT type, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tp + fn) AS n_truth, sum(tp) / nullif(sum(tp + fn), 0) AS recall,
  sum(tp) / nullif(sum(tp + fp), 0) AS precision FROM (
    SELECT t.type, CAST(count(d.note_id) > 0 AS INT) AS tp, CAST(count(d.note_id) = 0 AS INT) AS fn, 0 AS fp
    FROM truth t LEFT JOIN detected d ON d.note_id = t.note_id AND d."start" < t."end" AND t."start" < d."end" GROUP BY t.note_id, t."start", t."end", t.type
    UNION ALL SELECT d.type, 0, 0, 1 FROM detected d LEFT JOIN truth t ON d.note_id = t.note_id AND d."start" < t."end" AND t."start" < d."end" WHERE t.note_id IS NULL) x GROUP BY type""",
  "tp fn fp n_truth", "recall precision", "type")
add("score_totals", "truth detected outcomes", """SELECT grouping(type) = 1 AS is_total, type, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tp + fn) AS n_truth, sum(tp) / nullif(sum(tp + fn), 0) AS recall,
  CASE WHEN grouping(type) = 0 THEN sum(tp) / nullif(sum(tp + fp), 0) END AS precision FROM outcomes GROUP BY ROLLUP (type)""", "tp fn fp n_truth", "recall precision", "is_total type")  # fmt: skip
ORACLES["detect_rows_notes"] = ORACLES["detect_spans"]
add("score_overall", "truth detected outcomes", "SELECT sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tp + fn) AS n_truth, sum(tp) / nullif(sum(tp + fn), 0) AS recall FROM outcomes", "tp fn fp n_truth", "recall")


add("score_by_type_ordered", "truth detected outcomes", """SELECT type, row_number() OVER (ORDER BY sum(tp + fn) DESC, type) AS place, sum(tp + fn) AS n_truth, sum(tp) / sum(tp + fn) AS recall
  FROM outcomes GROUP BY type HAVING sum(tp + fn) > 0""", "place n_truth", "recall", "type")  # fmt: skip
add("pipeline_counters", "members eligibility claims notes truth", " UNION ALL ".join([
  *[f"SELECT '{t}' AS counter, count(*) AS n FROM {t}" for t in ("members", "eligibility", "claims", "notes", "truth")],
  f"SELECT 'unseen_names', count(*) FROM members WHERE first_name IN ('{(chr(39) + ', ' + chr(39)).join(L.FIRST_UNSEEN)}') OR last_name IN ('{(chr(39) + ', ' + chr(39)).join(L.SURNAMES_UNSEEN)}')",
  "SELECT 'small_zip', count(*) FROM members WHERE substr(zip5, 1, 3) IN ('059', '823', '889')", "SELECT 'age_90_plus', count(*) FROM members WHERE age >= 90",
]), "n", "", "counter")


def _quoted(x: object) -> str:
    return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


_TYPES = ", ".join(f"({n}, '{t}')" for n, types in L.SAFE_HARBOR_TYPES.items() for t in types)
add("safe_harbor_catalogue", "truth detected outcomes", f"""
  SELECT v.*, coalesce(planted, 0) AS n_planted, coalesce(caught, 0) AS n_caught, caught / nullif(planted, 0) AS recall
  FROM (VALUES {", ".join(f"({', '.join(map(_quoted, r))})" for r in L.SAFE_HARBOR)}) v(n, identifier, present, detection, transformation, residual_risk)
  LEFT JOIN (SELECT k.n, sum(tp + fn) AS planted, sum(tp) AS caught FROM outcomes o JOIN (VALUES {_TYPES}) k(n, type) ON o.type = k.type GROUP BY k.n) m ON m.n = v.n""",
    "n n_planted n_caught", "recall", "identifier present detection transformation residual_risk")


# The generator. Draws are told by the md5 of a seed and names, as numbers in [0, 1).
def _u(*keys: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '17', {', '.join(keys)})), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def _draw(u: str, low: int, high: int) -> str:
    return f"CAST(floor({u} * {high - low + 1}) + {low} AS BIGINT)"


def _choice(u: str, values: list) -> str:
    return f"([{', '.join(map(_quoted, values))}])[{_draw(u, 1, len(values))}]"


def _normal(u: str, v: str) -> str:
    return f"sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v})"


def _own(name: str, low: int, high: int) -> str:
    """A member's own number."""
    return _draw(_u("id", f"'{name}'"), low, high)


def _people() -> str:
    drawn = ", ".join(f"{_u('id', f_)} AS u_{f_.strip(chr(39))}" for f_ in ("'unseen'", "'first'", "'last'", "'city'", "'small'", "'zip'"))
    flags = ", ".join(f"{_u('id', f_)} < 0.02 + age / 1400 AS cond_{c}" for c, f_ in ((c, f"'cond_{c}'") for c in L.CONDITIONS))
    age = f"greatest(0, least(94, CAST(trunc(52 + 20 * {_normal(_u('id', repr('age1')), _u('id', repr('age2')))}) AS BIGINT)))"
    risk = " + ".join(f"CASE WHEN cond_{c} THEN {w} ELSE 0 END" for c, (_, _, w) in L.CONDITIONS.items())
    name = lambda u, known, unseen: f"CASE WHEN u_unseen < 0.3 THEN {_choice(u, unseen)} ELSE {_choice(u, known)} END"
    place = lambda k: _choice("u_city", [c[k] for c in L.CITIES])
    return f"""
SELECT id, concat({_choice(_u("id", "'plan'"), ["H", "P"])}, {_own("member", 1, 9)}, lpad(CAST(id AS VARCHAR), greatest(8, CAST(length(CAST(id AS VARCHAR)) AS INTEGER)), '0')) AS member_id, age, {_choice(_u("id", "'sex'"), ["F", "M"])} AS sex,
       first_name, last_name, concat({_own("house", 1, 9999)}, ' ', {_choice(_u("id", "'street'"), L.STREETS)}) AS street, {place(0)} AS city, {place(1)} AS state,
       CASE WHEN u_small < 0.08 THEN {_choice("u_zip", L.SMALL_ZIPS)} ELSE {place(2)} END AS zip5,
       concat('(', {_own("p1", 200, 989)}, ') ', {_own("p2", 200, 999)}, '-', {_own("p3", 1000, 9999)}) AS phone,
       concat(lower(first_name), '.', lower(last_name), {_own("mail", 1, 99)}, '@example.com') AS email,
       concat({_own("s1", 100, 899)}, '-', {_own("s2", 10, 99)}, '-', {_own("s3", 1000, 9999)}) AS ssn, concat('MRN', {_own("mrn", 1000000, 9999999)}) AS mrn,
       concat('ACCT-', {_own("account", 100000, 999999)}) AS account_number, u_unseen >= 0.3 AS name_in_gazetteer, {", ".join(_CONDITIONS)},
       round(0.6 + age / 250 + {risk}, 3) AS risk_score
FROM (SELECT *, {flags}, {name("u_first", L.FIRST_KNOWN, L.FIRST_UNSEEN)} AS first_name, {name("u_last", L.SURNAMES_KNOWN, L.SURNAMES_UNSEEN)} AS last_name
      FROM (SELECT id, {drawn}, {age} AS age FROM (SELECT c_custkey AS id FROM customer) c) a) b"""


def _day(base: str, name: str, low: int, high: int, sign: str = "+") -> str:
    return f"{base} {sign} CAST({_own(name, low, high)} AS INTEGER)"


_FROM, _TO, _CUT = (f"DATE '{x}'" for x in (L.START, L.END, L.SHOCK_CUT))
_FIELD = {c: c for c in ("mrn", "phone", "email", "ssn", "member_id", "street", "city", "state", "zip5", "account_number")} | {"first": "first_name", "last": "last_name"}


def _of_note(name: str, low: int, high: int) -> str:
    return _draw(_u("id", "k", f"'{name}'"), low, high)


_FIELD |= {
    "provider_last": _choice(_u("id", "k", "'provider'"), L.SURNAMES_KNOWN + L.SURNAMES_UNSEEN),
    "date": f"strftime({_FROM} + CAST(floor({_u('id', 'k', repr('date'))} * ({_TO} - {_FROM})) AS INTEGER), '%m/%d/%Y')",
    "url": f"concat('https://portal.example.com/case/', {_of_note('url', 10_000, 99_999)})",
    "ip": f"concat_ws('.', {_of_note('i1', 10, 220)}, {_of_note('i2', 0, 255)}, {_of_note('i3', 0, 255)}, {_of_note('i4', 1, 254)})",
} | {f: _choice(_u("id", "k", f"'{f}'"), values) for f, values in (("drug", L.DRUGS), ("dept", L.DEPARTMENTS), ("month", L.MONTHS), ("month2", L.MONTHS), ("payer", L.PAYERS))}
_PARTS = [X.pieces(t) for t in L.NOTE_TEMPLATES]


def _piece(piece: tuple[str, str | None]) -> str:
    return piece[1] if piece[1] else _quoted(piece[0])


def _planted() -> str:
    rows = []
    for t, parts in enumerate(_PARTS):
        for k, (_, field) in enumerate(parts):
            if field in L.FIELD_TYPES:
                before = " + ".join(f"length({_piece(p)})" for p in parts[:k]) or "0"
                rows.append(f"SELECT note_id, {before} AS s, '{L.FIELD_TYPES[field]}' AS type, {field} AS value FROM written WHERE template = {t}")
    return 'SELECT note_id, s AS "start", s + length(value) AS "end", type, value FROM (' + " UNION ALL ".join(rows) + ") x"


VIEWS["people"] = _people()
VIEWS["covered"] = f"""
  SELECT id, member_id, i, a, CASE WHEN shocked THEN least(b, {_CUT}) ELSE b END AS b FROM (
    SELECT *, 1 AS i, CASE WHEN kind >= 0.62 AND kind < 0.75 THEN {_day(_FROM, "late", 30, 400)} ELSE {_FROM} END AS a,
           CASE WHEN kind < 0.75 THEN {_TO} WHEN kind < 0.87 THEN {_day(_TO, "early", 30, 400, "-")} ELSE gap END AS b FROM kinds
    UNION ALL SELECT *, 2, again, {_TO} FROM kinds WHERE kind >= 0.87 AND again < {_TO}) x
  WHERE NOT (shocked AND a >= {_CUT})"""
VIEWS["kinds"] = f"""
  SELECT *, gap + CAST({_own("again", 40, 200)} AS INTEGER) AS again FROM (
    SELECT id, member_id, {_u("id", "'kind'")} AS kind, {_u("id", "'shock'")} < {L.SHOCK_DROP} AS shocked, {_day(_FROM, "gap", 90, 500)} AS gap FROM people) x"""
VIEWS["days"] = "SELECT id, sum(b - a) AS days, list(a ORDER BY i) AS starts, list(b ORDER BY i) AS ends FROM covered GROUP BY id HAVING sum(b - a) > 0"
VIEWS["rates"] = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {r}, {p})" for c, (r, p) in L.CATEGORIES.items()) + ") v(c, rate, price)"
VIEWS["means"] = f"""
  SELECT p.id, member_id, c, price, starts, ends, CAST(rate AS DOUBLE) * risk_score * days / 365 AS mean, {_u("p.id", "c", "'n'")} AS u, {_u("p.id", "c", "'m'")} AS v
  FROM people p JOIN days d ON d.id = p.id CROSS JOIN rates"""
VIEWS["counted"] = f"""
  SELECT id, member_id, c, price, starts, ends, count(*) FILTER (u >= upto) AS n FROM (
    SELECT *, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY id, c ORDER BY k) AS upto FROM (SELECT *, unnest(range(0, 120)) AS k FROM means WHERE mean <= 30) x) y
  GROUP BY ALL
  UNION ALL SELECT id, member_id, c, price, starts, ends, greatest(0, CAST(trunc(mean + {_normal("u", "v")} * sqrt(mean)) AS BIGINT)) FROM means WHERE mean > 30"""
_OF = lambda name: _u("id", "c", "k", f"'{name}'")
VIEWS["billed"] = f"""
  SELECT *, a + CAST(floor({_OF("day")} * (b - a)) AS INTEGER) AS d FROM (
    SELECT id, member_id, c, price, k, starts[s] AS a, ends[s] AS b FROM (
      SELECT *, CAST(floor({_OF("span")} * len(starts)) + 1 AS BIGINT) AS s FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM counted WHERE n > 0) x) y) z
  WHERE b - a > 1"""
VIEWS["written"] = f"""
  SELECT concat('N', lpad(CAST(id AS VARCHAR), greatest(8, CAST(length(CAST(id AS VARCHAR)) AS INTEGER)), '0'), k) AS note_id, member_id AS owner, {", ".join(f"{sql} AS {f}" for f, sql in _FIELD.items())}, {_of_note("template", 0, len(L.NOTE_TEMPLATES) - 1)} AS template
  FROM (SELECT p.*, unnest(range(1, ([0, 0, 0, 1, 1, 2])[{_draw(_u("p.id", "'notes'"), 1, 6)}] + 1)) AS k FROM people p JOIN days d ON d.id = p.id) x"""

_MEMBER = "member_id sex first_name last_name street city state zip5 phone email ssn mrn account_number name_in_gazetteer " + " ".join(_CONDITIONS)
add("generate_members", "people", "SELECT * FROM people", "age", "risk_score", _MEMBER)
add("generate_eligibility", "people kinds covered", "SELECT member_id, CAST(a AS VARCHAR) AS span_start, CAST(b AS VARCHAR) AS span_end FROM covered", "", "", "member_id span_start span_end")
add("generate_claims", "people kinds covered days rates means counted billed", f"""
  SELECT concat('C', lpad(CAST(id AS VARCHAR), greatest(9, CAST(length(CAST(id AS VARCHAR)) AS INTEGER)), '0'), substr(c, 1, 2), lpad(CAST(k AS VARCHAR), 4, '0')) AS claim_id, member_id, CAST(d AS VARCHAR) AS service_date, c AS service_category, 1 AS units,
         floor(CAST(price AS DOUBLE) * (0.55 + {_OF("price")} * 1.05) * CASE WHEN c = 'inpatient' AND year(d) * 4 + quarter(d) >= {L.SHOCK_START[0] * 4 + L.SHOCK_START[1]} THEN CAST({L.SHOCK_PRICE} AS DOUBLE) ELSE 1 END * 100 + 0.5) / 100 AS paid_amount,
         concat('1', {_draw(_OF("npi"), 100_000_000, 999_999_999)}) AS provider_npi FROM billed""", "units", "paid_amount", "claim_id member_id service_date service_category provider_npi")  # fmt: skip
add("generate_notes", "people kinds covered days written", "SELECT note_id, owner AS member_id, CASE template " + " ".join(f"WHEN {t} THEN concat({', '.join(map(_piece, parts))})" for t, parts in enumerate(_PARTS)) + " END AS text FROM written", "", "", "note_id member_id text")
add("generate_truth_spans", "people kinds covered days written", _planted(), "start end", "", "note_id type value")
