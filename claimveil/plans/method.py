"""The method document: what is removed and how, and how well that was measured to work."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from claimveil.plans.files import read_file, write_file
from claimveil.sources import lexicon as L


def _share(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.1%}"


def render(results: dict) -> str:
    """Markdown from the results of the pipeline; every number in the prose comes from them."""
    types, total = results["score_by_type"], results["score_overall"][0]
    names = next((r for r in types if r["type"] == "name"), None)
    lines = ["# De-identification method", "", "Approximates the Safe Harbor rule of 45 CFR 164.514(b)(2). Nothing here is an expert determination.", ""]
    lines += ["## Identifiers", "", "| # | identifier | in the data | detection | transformation | what remains |", "|---|---|---|---|---|---|"]
    lines += [f"| {n} | {name} | {'yes' if there else 'no'} | {how} | {what} | {rest} |" for n, name, there, how, what, rest in L.SAFE_HARBOR]
    lines += ["", "## How much is found", "", "Identifiers were planted in made-up notes at known places; a detection counts for one if it overlaps it.", ""]
    lines += ["| type | in the notes | detected | left in the text | share detected | other words replaced |", "|---|---|---|---|---|---|"]
    for r in sorted(types, key=lambda r: (-r["n_truth"], r["type"])):
        lines.append(f"| {r['type']} | {r['n_truth']:,} | {r['tp']:,} | {r['fn']:,} | {_share(r['recall'])} | {r['fp']:,} |")
    lines.append(f"| **all** | {total['n_truth']:,} | {total['tp']:,} | {total['fn']:,} | {_share(total['recall'])} | {total['fp']:,} |")
    lines += ["", "## How to read it", ""]
    weakest = [r for r in types if r["n_truth"] and r["fn"]]
    if names:
        lines += [
            f"**Names.** {names['fn']:,} of {names['n_truth']:,} stay in the text ({_share(names['recall'])} are detected): a name is known from a list, or from what "
            f"stands before it, and some have neither. {names['fp']:,} words that are no names were replaced as well, mostly parts of institutions' names.", "",
        ]
    for r in weakest:
        if r["type"] != "name":
            lines += [f"**{r['type'].capitalize()}.** {r['fn']:,} of {r['n_truth']:,} stay; for addresses these are cities that are left out of the list because they are ordinary words or names too.", ""]
    sure = [r["type"] for r in types if r["n_truth"] and not r["fn"]]
    if sure:
        lines += [f"**Found wherever planted:** {', '.join(sorted(sure))}. That says that the patterns know the forms that were planted, not that there are no others.", ""]
    lines += [
        "**Two kinds of error.** What stays in the text may disclose a person; what is replaced needlessly costs a word. The two have no common scale, so there is no "
        "single score here that mixes them.", "",
        "**Dates.** All dates of a person move back by the same number of days, between one and 364, drawn from a salted hash of the person's id. Intervals within a person "
        "stay right; who knows one true date of someone knows all of theirs. The number is left out of released extracts.", "",
        "**Pseudonyms.** Equal values get equal pseudonyms under one salt, so notes can be joined to members; a name's pseudonym is that of the word, whoever bears it.", "",
        "**What this isn't.** No model of language looks at the notes, no small cells are suppressed beyond ZIP areas of few people, and nobody has reviewed the result.", "",
    ]
    return "\n".join(lines)


def main(spark: SparkSession, out: str) -> str:
    """Reads the pipeline's results under ``out`` and writes the document beside them."""
    text = render(json.loads(read_file(spark, f"{out}/results.json")))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/method")
    write_file(spark, f"{out}/method.md", text)
    return text
