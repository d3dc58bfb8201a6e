"""Govern, then analyse: the whole job from generated tables to results, each written as a table and summed up in one document."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimveil.functions.scalar import is_small_zip3
from claimveil.operators import analytics as A
from claimveil.operators import redaction, scoring
from claimveil.plans.files import write_file
from claimveil.sources import lexicon as L
from claimveil.sources import synth

SALT = "demo-salt-not-a-secret"


def counters(tables: dict[str, DataFrame]) -> dict[str, int]:
    """How many rows each table has, and how many members have unseen names, small ZIP areas or 90 years."""
    m = tables["members"].agg(
        F.count_if(~F.col("name_in_gazetteer")).alias("unseen_names"), F.count_if(is_small_zip3(F.substring("zip5", 1, 3))).alias("small_zip"), F.count_if(F.col("age") >= 90).alias("age_90_plus")
    )
    *counts, people = side_by_side([*[df.count for df in tables.values()], m.first])
    return dict(zip(tables, counts)) | people.asDict()


def _rows(df: DataFrame, *order: str) -> list[dict]:
    """Rows of a table of sums, which is small by what it holds: types, categories or quarters."""
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def side_by_side(jobs: list[Callable[[], object]]) -> list:
    """Runs independent jobs at the same time, so that small ones fill the cores that others leave; results in order."""
    with ThreadPoolExecutor(max(1, min(8, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def written(spark: SparkSession, out: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Writes each table once, and reads it back for whoever needs it."""
    side_by_side([lambda name=name, df=df: df.write.mode("overwrite").parquet(f"{out}/{name}") for name, df in tables.items()])
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}


def results(spark: SparkSession, tables: dict[str, DataFrame], out: str, salt: str = SALT, start: str = L.START, end: str = L.END) -> dict[str, DataFrame]:
    """All result tables by name, written under ``out`` in two steps: what others are made of, then those."""
    months = A.spine(A.member_months(tables["eligibility"], start, end))
    monthly = A.pmpm_by_month(tables["claims"], months, start, end)
    first = {
        "detected": redaction.redact(tables["notes"], salt), "deidentified_members": redaction.deidentify_members(tables["members"], salt), "member_months": months,
        "pmpm_month": monthly, "cost_concentration": A.cost_concentration(tables["claims"], start, end), "risk_context": A.risk_context(tables["members"]),
    }
    done = written(spark, out, first)
    quarters = A.pmpm_by_quarter(done["pmpm_month"], done["member_months"])
    totals = A.quarter_totals(quarters, done["member_months"])
    done |= written(spark, out, {
        "redacted_notes": done["detected"].select("note_id", "clean"), "score_by_type": scoring.by_type(scoring.score_notes(done["detected"], tables["truth_spans"])),
        "denominator": A.naive_denominator(tables["members"], done["member_months"]), "pmpm_quarter": quarters, "pmpm_quarter_total": totals,
        "decomposition": A.decompose(quarters, totals), "decomposition_by_category": A.decompose_by_category(quarters, totals),
    })
    return done


def main(spark: SparkSession, out: str, n_members: int = 8000, seed: int = 17) -> dict:
    """Writes every table under ``out``, the first 40 redacted notes and ``results`` (one JSON line) as text, and ``results.json``; returns what that holds."""
    tables = written(spark, f"{out}/input", synth.generate(spark, n_members, seed))
    read = results(spark, tables, out)
    first_notes = read["redacted_notes"].orderBy("note_id").limit(40).select("clean").coalesce(1)
    small = {
        "score_by_type": lambda: sorted(_rows(read["score_by_type"], "type"), key=lambda r: -r["n_truth"]), "score_overall": lambda: _rows(scoring.overall(read["score_by_type"]), "tp"),
        "denominator": lambda: _rows(read["denominator"], "n_members"), "pmpm_quarter_total": lambda: _rows(read["pmpm_quarter_total"], "year", "quarter"),
        "decomposition": lambda: _rows(read["decomposition"], "year", "quarter"),
        "decomposition_by_category": lambda: sorted(_rows(read["decomposition_by_category"], "year", "quarter", "category"), key=lambda r: (r["year"], r["quarter"], -abs(r["price_effect"]))),
        "cost_concentration": lambda: _rows(read["cost_concentration"], "total_paid"), "risk_context": lambda: _rows(read["risk_context"], "code"),
    }
    counts, _, *rows = side_by_side([lambda: counters(tables), lambda: first_notes.write.mode("overwrite").text(f"{out}/deidentified_notes"), *small.values()])
    told = {"counts": counts} | dict(zip(small, rows))
    spark.createDataFrame([(json.dumps(told, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/results")
    write_file(spark, f"{out}/results.json", json.dumps(told, default=float, indent=2))
    return told


def report(told: dict) -> str:
    """The results as tables for a terminal."""
    c = told["counts"]
    lines = [f"{c['members']:,} members, {c['claims']:,} claims, {c['notes']:,} notes, {c['truth_spans']:,} planted identifiers"]
    lines += [f"{c['unseen_names']:,} members with names in no list, {c['small_zip']:,} in small areas, {c['age_90_plus']:,} of 90 or older", "", "found of planted identifiers"]
    lines += [f"  {r['type']:<15}{r['n_truth']:>8,}{r['tp']:>8,}{r['fn']:>7,} missed{r['fp']:>7,} beyond  recall {_share(r['recall'])}" for r in told["score_by_type"] + [{**told["score_overall"][0], "type": "all"}] if r["n_truth"]]
    for r in told["denominator"]:
        lines += ["", f"member months {r['actual']:,.0f}; members times months {r['naive']:,.0f}, too many by {_share(r['overstatement'])}, PMPM too low by {_share(r['pmpm_understatement'])}", "", "PMPM by quarter"]
    lines += [f"  {r['year']} Q{r['quarter']}{r['member_months']:>12,.1f}{r['pmpm']:>10,.2f}{r['services']:>10,}" for r in told["pmpm_quarter_total"]]
    lines += ["", "change to the next quarter: price, utilisation, mix, residual (share of the change)"]
    for r in told["decomposition"]:
        parts = "".join(f"{r[f'{e}_effect']:>+9.2f} ({r[f'{e}_share']:>5.0%})" for e in ("price", "utilisation", "mix"))
        lines.append(f"  {r['year']} Q{r['quarter']}{r['actual_change']:>+9.2f} ({r['pct_change']:+.1%}){parts}{r['residual']:>+9.2f}")
        own = [x for x in told["decomposition_by_category"] if (x["year"], x["quarter"]) == (r["year"], r["quarter"])]
        lines += [f"    {x['category']:<14}{x['price_effect']:>+9.2f}{x['util_effect']:>+9.2f}  price x{x['price_ratio']:.2f}" for x in own]
    for r in told["cost_concentration"]:
        lines += ["", "share of spend: " + ", ".join(f"top {p}% {_share(r[f'top_{p}pct_share'])}" for p in A.SHARES)]
    lines += ["", "conditions"] + [f"  {r['code']:<8}{r['description']:<42}{r['coefficient']:>6.3f}{r['n_members']:>8,}{r['prevalence']:>8.1%}" for r in told["risk_context"]]
    return "\n".join(lines)


def _share(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.1%}"
