"""Attacks on a released extract: what is unique, who can be linked, and what it costs to prevent it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimveil.functions.scalar import age_band, pseudonym, risk_band, zip3
from claimveil.operators import reidentification as K
from claimveil.plans.files import write_file
from claimveil.plans.pipeline import SALT, side_by_side, written
from claimveil.sources import synth

#: Which rungs of the ladder an attacker links on; conditions aren't in any roll, so they are left out.
ATTACKED = (2, 3, 4)


def released(members: DataFrame, salt: str = SALT) -> DataFrame:
    """What is given away: key, area, band, sex, score band and conditions, without the days of shifting."""
    return members.select(
        pseudonym(F.col("member_id"), salt, "MBR").alias("member_key"), zip3(F.col("zip5")).alias("zip3"), "state", age_band(F.col("age")).alias("age_band"), "sex",
        risk_band(F.col("risk_score")).alias("risk_score_band"), *K.CONDITION_COLUMNS,
    )


def rungs(extract: DataFrame, roll: DataFrame, walk: DataFrame) -> list[dict]:
    """The attack on each rung, with the share of its first links that are right; rungs of the same columns are one attack."""
    sets = {rung + 1: tuple(q for q in K.LADDER[rung] if not q.startswith("cond_")) for rung in ATTACKED}

    def one(qis: tuple[str, ...]) -> dict:
        found = K.first_links(K.linkage(extract, roll, qis))
        hits, right = side_by_side([K.attack(extract, roll, qis).first, K.verify(found, walk).first])
        return hits.asDict() | right.asDict()

    told = dict(zip(dict.fromkeys(sets.values()), side_by_side([lambda q=q: one(q) for q in dict.fromkeys(sets.values())])))
    return [{"rung": rung, "known": list(qis)} | told[qis] for rung, qis in sets.items()]


def main(spark: SparkSession, out: str, n_members: int = 8000, seed: int = 17, coverage: float = 0.85) -> dict:
    """Writes the extract, the roll and ``reidentification`` as JSON under ``out``, a folder and a single file; returns what that holds."""
    members = written(spark, out, {"members": synth.members(spark, n_members, seed).drop("id")})["members"]
    made = written(spark, out, {"released": released(members), "roll": K.external_roll(members, K.hash_kept("member_id", coverage, 99))})
    extract, walk = made["released"], members.select(pseudonym(F.col("member_id"), SALT, "MBR").alias("member_key"), "member_id")
    ladder, links, targets, steps = side_by_side([
        K.ladder(extract).orderBy("rung").collect, lambda: rungs(extract, made["roll"], walk), K.targeted(extract).orderBy("target").collect,
        K.suppression_steps(extract, K.LADDER[5]).orderBy("number").collect,
    ])
    told = {
        "ladder": [r.asDict() for r in ladder], "linkage": links, "best_attack": max(links, key=lambda r: r["n_reidentified"]),
        "targeted": [r.asDict() for r in targets], "generalise": [r.asDict() for r in steps],
    }
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/reidentification")
    write_file(spark, f"{out}/reidentification.json", json.dumps(told, indent=2))
    return told


def report(told: dict) -> str:
    """The attacks as tables for a terminal."""
    lines = ["what is known: smallest class, alone, among fewer than five"]
    lines += [f"  {', '.join(q.removeprefix('cond_') for q in K.LADDER[r['rung'] - 1]):<78}{r['min_k']:>5}{r['pct_unique']:>8.1%}{r['pct_under_5']:>8.1%}" for r in told["ladder"]]
    lines += ["", "linked to a roll by name"]
    lines += [f"  {', '.join(r['known']):<30}{r['n_reidentified']:>6} of {r['n_released']:,}, {r['n_unique_but_ambiguous_in_roll']} ambiguous; {r['n_correct']} of the first {r['n_checked']} right" for r in told["linkage"]]
    best = told["best_attack"]
    lines += [f"  most by {', '.join(best['known'])}" if best["n_reidentified"] else "  none", "", "a condition known beside area, sex and age: carriers alone"]
    lines += [f"  {r['known']:<22}{r['carriers_pct_unique']:>8.1%}" + (f"  prevalence {r['prevalence']:.1%}" if r["prevalence"] is not None else "") for r in told["targeted"]]
    lines += ["", "to leave nobody among fewer than five"]
    lines += [f"  {r['step']:<32}{r['n_kept']:>8,} kept, {r['suppression_rate']:.1%} suppressed, smallest class {r['min_k_after']}" for r in told["generalise"]]
    return "\n".join(lines)
