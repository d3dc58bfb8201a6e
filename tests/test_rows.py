"""Operators that work on spans, areas and names as rows, against those that work on one text's list."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from claimveil.functions import joins
from claimveil.operators import detection, redaction, scoring
from claimveil.operators import reidentification as K
from claimveil.plans.files import read_file, write_file
from claimveil.queries import QUERIES
from claimveil.sources import lexicon as L
from tests.test_privacy import plain_score

SPANS = "note_id string, start int, end int, type string"


def plan(df):
    return df._jdf.queryExecution().toString()


def score(spark, planted, found, tolerance):
    got = scoring.score_spans(spark.createDataFrame(found, SPANS), spark.createDataFrame(planted, SPANS), tolerance)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("tolerance", [0, 2, 7])
def test_long_chains_match_greedily(spark, tolerance):
    """Notes whose spans overlap each other on both sides, repeat, or have no length."""
    rnd, planted, found, want = random.Random(tolerance), [], [], []
    for note in range(60):
        some = lambda: sorted((s, s + rnd.randint(0, 9), rnd.choice("ab")) for s in (rnd.randrange(60) for _ in range(rnd.randint(0, 25))))
        p, f = some(), some()
        planted += [(str(note), *x) for x in p]
        found += [(str(note), *x) for x in f]
        want += [(str(note), *x) for x in plain_score(p, f, tolerance)]
    assert score(spark, planted, found, tolerance) == sorted(want, key=str)


@pytest.mark.parametrize("tolerance", [0, 2])
def test_one_note_with_many_spans(spark, tolerance):
    """20,000 spans on each side: apart, and as one chain where every span overlaps the next; a note as large by the list took hours."""
    apart = [("a", 10 * k, 10 * k + 6, "x") for k in range(20000)]
    near = [("a", s + k % 3, e + k % 3, "x") for k, (_, s, e, _) in enumerate(apart)]
    chain = [("b", 4 * k, 4 * k + 6, "x") for k in range(20000)]
    began = time.time()
    told = scoring.score_spans(spark.createDataFrame(near + chain[:-1], SPANS), spark.createDataFrame(apart + chain, SPANS), tolerance).groupBy("note_id").agg(F.sum("tp"), F.sum("fn"), F.sum("fp")).collect()
    assert {tuple(r) for r in told} == {("a", 20000, 0, 0), ("b", 19999, 1, 0)} and time.time() - began < 100


def test_spans_without_note_or_place(spark):
    rows = [(None, 1, 5, "x"), (None, 1, 5, "x"), ("n", None, 3, "x"), ("n", 4, None, "y")]
    assert score(spark, rows, rows[:1], 0) == sorted([(None, "x", 1, 0, 0), (None, "x", 0, 1, 0)], key=str)
    assert score(spark, [], [], 0) == [] and scoring.totals(scoring.score_spans(spark.createDataFrame([], SPANS), spark.createDataFrame([], SPANS))).collect() == []


def test_scores_make_no_list_of_a_note(spark):
    one = spark.createDataFrame([("n", 1, 2, "x")], SPANS)
    assert "collect_list" not in plan(scoring.score_spans(one, one)) and "Window" in plan(scoring.score_spans(one, one))


def test_totals(spark):
    rows = spark.createDataFrame([("n", "a", 1, 0, 0), ("n", "a", 0, 1, 0), ("n", "b", 0, 0, 1)], "note_id string, type string, tp int, fn int, fp int")
    told = {r.type: r for r in scoring.totals(rows).collect()}
    assert told[None].is_total and told[None].recall == 0.5 and told[None].precision is None and told["b"].recall is None and told["a"].precision == 1.0
    assert plan(scoring.totals(rows)).split("== Physical Plan ==")[1].count("Expand") == 1


TEXTS = [
    "Patient Smith Jones of Boston, 12 Oak St, MRN-123456; ssn 123-45-6789 or 123-45-6789-1", "Dr. Okonkwo saw Mary at 10.0.0.1 http://a.b/c?d=1.2.3.4 on 03/04/2024", None, "", "Smith" * 3, "by Mary Smith to Anna Bell for Lee",
    "Seattle Austin Jackson jackson JACKSON éSmith Smithé Smith-Lee", "call (555) 123-4567 or 555-123-4567 2024-01-02 zip 02139-1234",
]


def spans_by_key(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("small", [joins.SMALL, 0])
def test_rows_find_what_lists_find(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "SMALL", small)
    rnd = random.Random(2)
    words = " ".join(t for t in TEXTS if t).split() + [". ", "\n", "123456789 H123456789"]
    texts = TEXTS + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(25)]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id int, text string").withColumns({"type": F.lit(1), "start": F.lit(2), "rule": F.lit(3)})
    got = detection.detect_rows(notes)
    assert ("BroadcastHashJoin" in plan(got)) == (small > 0)
    assert spans_by_key(got) == spans_by_key(detection.spans_of(detection.with_spans(notes.select("note_id", "text"))))


def test_rows_of_a_text_of_ten_megabytes(spark):
    text = "Patient Smith called 555-123-4567 about the claim that was filed. " + "lorem ipsum dolor sit amet, " * 60
    n = 10_000_000 // len(text) + 1
    notes = spark.createDataFrame([(1, text)], "note_id int, text string").withColumn("text", F.repeat("text", F.lit(n)))
    told = detection.detect_rows(notes).groupBy("type").agg(F.count("*").alias("n"), F.max("end").alias("last")).collect()
    assert {(r.type, r.n) for r in told} == {("name", n), ("phone", n)} and max(r.last for r in told) > 9_900_000


def test_only_small_tables_are_dealt_out(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "x")], "k int, text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    few = spark.read.parquet(f"{tmp_path}/t")
    assert "Exchange" in plan(detection.spread(few, "k"))
    monkeypatch.setattr(detection, "DEALT", 10)
    assert "Exchange" not in plan(detection.spread(few, "k"))


def test_gazetteer_of_a_table(spark):
    words = spark.createDataFrame([("Anna",), ("Anna",), (L.STOP_WORDS[0],), ("Al",), ("two words",), (None,), ("Boston",)], "word string")
    told = detection.gazetteer(words, spark.createDataFrame([("Boston",)], "word string"))
    assert sorted(map(tuple, told.collect())) == [("Anna", "name"), ("Boston", "address"), ("Boston", "name")]
    notes = spark.createDataFrame([("n", "anna Anna Annas Smith Boston")], "note_id string, text string")
    assert spans_by_key(detection.detect_rows(notes, told)) == [("n", 5, 9, "name", "Anna"), ("n", 22, 28, "address", "Boston")]
    assert detection.detect_rows(notes, told.limit(0)).count() == 0


@pytest.mark.parametrize("small", [joins.SMALL, 0])
def test_areas_of_a_table(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "SMALL", small)
    rows = spark.createDataFrame([("01234",), ("02139",), ("99999",), (None,), ("01234",)], "zip5 string").withColumn("people", F.lit("x"))
    areas = spark.createDataFrame([("012", 15000), ("012", 5000), ("021", 20001), ("777", None), (None, 5)], "zip3 string, people int")
    told = redaction.with_areas(rows, areas)
    assert sorted((str(r.zip5), str(r.zip3)) for r in told.collect()) == [("01234", "000"), ("01234", "000"), ("02139", "021"), ("99999", "999"), ("None", "None")]
    assert told.columns == ["zip5", "people", "zip3"]
    assert redaction.with_areas(rows, areas.limit(0)).where("zip3 = '000'").count() == 0


def test_rungs_in_one_pass(spark):
    people = [(f"k{i}", "s", "F" if i % 2 else None, None if i % 5 == 0 else f"{i % 3}", f"z{i % 4}") for i in range(12)] + [("k99", None, None, None, None)]
    released = spark.createDataFrame(people, "member_key string, state string, sex string, age_band string, zip3 string")
    roll = spark.createDataFrame([(f"name {k}", k, *rest) for k, *rest in people[3:] + people[:1] * 2], "name string, true_member_id string, state string, sex string, age_band string, zip3 string")
    sets = [(n, q) for n, q in enumerate((["state"], ["sex", "state"], ["state", "sex", "age_band"], ["zip3", "sex", "age_band"], ["age_band", "zip3", "sex"]), 1)]
    told = K.attack_rungs(released, roll, sets)
    got = {r.rung: r for r in told.collect()}
    for n, q in sets:
        want = K.attack(released, roll, q).first()
        assert all(got[n][c] == want[c] for c in want.asDict())
    best = max(got.values(), key=lambda r: (r.n_reidentified, -r.rung)).rung
    assert [n for n, r in got.items() if r.is_best] == [best]
    none = K.attack_rungs(released.limit(0), roll.limit(0), sets).collect()
    assert len(none) == 5 and all(r.n_released == 0 and r.n_reidentified == 0 and r.rate == 0 for r in none)
    links = K.linkage_sets(released, roll, [sets[3][1]])
    assert sorted(map(tuple, links.drop("set").select("released", "n_roll", "guessed_name").collect())) == sorted(map(tuple, K.linkage(released, roll, sets[3][1]).select("released", "n_roll", "guessed_name").collect()))


def test_rungs_read_each_side_twice(spark, tmp_path):
    cols = "member_key string, state string, sex string, age_band string, zip3 string, name string, true_member_id string"
    spark.createDataFrame([("k", "s", "F", "1", "z", "n", "m")], cols).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    told = K.attack_rungs(t, t, [(k, q) for k, q in enumerate(K.LADDER[:4])])
    assert told._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4


def test_one_file(spark, tmp_path):
    at = f"{tmp_path}/new/folder/results.json"
    for text in ("first, é", json.dumps({"a": [1, None]}), ""):
        write_file(spark, at, text)
        assert open(at, encoding="utf-8").read() == text and [f for f in os.listdir(os.path.dirname(at)) if not f.endswith(".crc")] == ["results.json"]
    write_file(spark, f"file://{at}", "again\n\nand again")
    assert read_file(spark, at) == "again\n\nand again"
    os.mkdir(f"{tmp_path}/full")
    open(f"{tmp_path}/full/x", "w").close()
    with pytest.raises(Exception):
        write_file(spark, f"{tmp_path}/full", "a folder of that name is not replaced")
    assert os.listdir(f"{tmp_path}/full") == ["x"] and not [f for f in os.listdir(tmp_path) if f.startswith(".full")]


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    spark.createDataFrame(list(enumerate(TEXTS)), "note_id int, text string").write.parquet(f"{folder}/notes")
    spark.createDataFrame([(0, 8, 13, "name", "Smith")], "note_id int, start int, end int, type string, value string").write.parquet(f"{folder}/spans")
    return spark.read.parquet(f"{folder}/notes"), spark.read.parquet(f"{folder}/spans")


def test_scores_read_each_side_once(stored):
    assert scans(scoring.score_spans(stored[1], stored[1], 2)) == 2


def test_texts_are_tried_once_and_not_shuffled(stored):
    """Short texts in one reading, long ones in another, which alone shuffles their candidates."""
    told = detection.detect_rows(stored[0])
    assert scans(told) == 2 and told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(note_id") == 1


def test_long_texts_by_rows(spark, stored, monkeypatch):
    want = spans_by_key(detection.spans_of(detection.with_spans(stored[0])))
    monkeypatch.setattr(detection, "LONG", 0)
    assert spans_by_key(detection.detect_rows(stored[0])) == want and want


def test_a_rule_is_one_pass(spark, stored):
    assert "regexp_extract" not in plan(detection.with_spans(stored[0]))
    odd = spark.createDataFrame([(1, "see http://a\0b/c \0 555 123-4567 ٣٣٣-44-5555 Smith\0Jones, Acct-12345")], "note_id int, text string")
    got = [(r.type, r.value) for r in detection.spans_of(detection.with_spans(odd)).orderBy("start").collect()]
    assert got[0] == ("url", "http://a\0b/c") and {("ssn", "٣٣٣-44-5555"), ("name", "Smith"), ("name", "Jones"), ("account_number", "Acct-12345")} <= set(got)


def lists(df):
    return sorted((repr(r[0]), [tuple(x) for x in r.spans or []]) for r in df.collect())


def test_places_are_what_detect_finds(spark):
    """Batches of a few texts; those of other scripts, or with a vertical tab, by ``detect`` itself."""
    rnd = random.Random(5)
    words = " ".join(t for t in TEXTS if t).split() + [". ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\0", "123456789 H123456789", "Patient ", "member\nMary Smith", "Dr.\tLee", "to Prior Auth", "Case Note seen", "http://x\x01y", "mrn 12345"]
    texts = TEXTS + [rnd.choice([" ", ""]).join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    texts += [t.encode("ascii", "ignore").decode().replace("\x0b", " ") for t in texts if t]
    texts += [" ".join(rnd.choice(words) for _ in range(20000)), "Smith and Dr. Jones, " * 50000]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        told = lists(detection.places(notes))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = detection.with_spans(notes).select("note_id", F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["type"])).alias("spans"))
    assert told == lists(want) and sum(len(s) for _, s in told) > 50000


@pytest.mark.parametrize("tolerance,batch", [(0, 1), (2, 3), (7, 10000)])
def test_lists_score_as_rows(spark, tolerance, batch):
    """Keys in several lists, or missing; spans without place or type, or that end before they begin; lists that are null or empty."""
    rnd, sides = random.Random(tolerance), []
    for _ in range(2):
        some = lambda: [(rnd.choice([None, 0, *range(s, s + 1)]) if rnd.random() < 0.05 else s, s + rnd.randint(-1, 9), rnd.choice(["a", "b", None])) for s in (rnd.randrange(60) for _ in range(rnd.randint(0, 15)))]  # noqa: B023, E731
        sides.append([(rnd.choice([None, *map(str, range(30))]), rnd.choice([None, some(), some(), some()])) for _ in range(80)])
    found, truth = (spark.createDataFrame(x, "note_id string, spans array<struct<start:int,end:int,type:string>>") for x in sides)
    rows = [x.select("note_id", F.inline("spans")) for x in (found, truth)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, scoring.score_lists(found, truth, tolerance).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(tuple, scoring.score_spans(*rows, tolerance).collect()), key=str) and got
    assert scoring.score_lists(found.limit(0), truth.limit(0), tolerance).count() == 0


def test_scoring_shuffles_a_row_for_each_note(spark):
    """Not one for each span, which are neither made into rows nor sorted by windows."""
    told = QUERIES["score_within_tolerance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in told and "Generate" not in told and told.count("MapInArrow") == 2
