import json

from claimveil.plans import attack, method, pipeline
from claimveil.queries import QUERIES
from claimveil.sources import synth


def test_jobs(spark, tmp_path):
    told = pipeline.main(spark, str(tmp_path), 300)
    assert json.loads(spark.read.text(f"{tmp_path}/results").first().value)["counts"] == told["counts"] and told["counts"]["members"] == 300
    assert spark.read.text(f"{tmp_path}/deidentified_notes").count() == min(40, told["counts"]["notes"])
    assert json.loads((tmp_path / "results.json").read_text()) == json.loads(json.dumps(told, default=float))
    text = method.main(spark, str(tmp_path))
    assert (tmp_path / "method.md").read_text() == text
    assert text.count("\n| ") >= 18 + len(told["score_by_type"]) and f"{told['score_overall'][0]['n_truth']:,}" in text
    found = attack.main(spark, str(tmp_path), 300)
    assert json.loads((tmp_path / "reidentification.json").read_text()) == found
    assert len(found["ladder"]) == 6 and len(found["linkage"]) == 3 and all(s["min_k_after"] in (0, *range(5, 301)) for s in found["generalise"])
    assert all(r["n_checked"] == r["n_correct"] for r in found["linkage"])
    shown, attacked = pipeline.report(told), attack.report(found)
    assert f"{told['counts']['claims']:,} claims" in shown and "top 50%" in shown and attacked.count("suppressed") == 3
    assert "date_offset_days" not in spark.read.parquet(f"{tmp_path}/released").columns


def test_method_without_names():
    assert "n/a" in method.render({"score_by_type": [{"type": "ssn", "n_truth": 0, "tp": 0, "fn": 0, "fp": 1, "recall": None}], "score_overall": [{"n_truth": 0, "tp": 0, "fn": 0, "fp": 1, "recall": None}]})


def test_generator_queries_make_a_member_for_each_customer(spark, tmp_path):
    spark.createDataFrame([(7, "x"), (4000, "y"), (90_000_000_000, "z")], "c_custkey long, name string").write.parquet(f"{tmp_path}/customer.parquet")
    made = {r.member_id[2:]: r for r in QUERIES["generate_members"](spark, str(tmp_path)).collect()}
    assert set(made) == {"00000007", "00004000", "90000000000"}
    assert made["00000007"].ssn == synth.members(spark, 8).where("id = 7").first().ssn and synth.members(spark).count() == 8000
    spark.createDataFrame([], "c_custkey long").write.parquet(f"{tmp_path}/none/customer.parquet")
    for name in ("members", "eligibility", "claims", "notes", "truth_spans"):
        assert QUERIES[f"generate_{name}"](spark, f"{tmp_path}/none").count() == 0
