import random
import re
import time

import pytest
from pyspark.sql import functions as F

from claimveil.operators import detection, redaction, scoring
from claimveil.sources import lexicon as L
from claimveil.sources import synth
from claimveil.streaming import notes as stream

SALT = "test-salt"
SPAN = "array<struct<start:int,end:int,type:string,value:string>>"


def plain(text):
    """Spans by looping over the rules in order of priority."""
    found = []

    def offer(start, end, kind):
        if not any(start < s[1] and s[0] < end for s in found):
            found.append((start, end, kind, text[start:end]))

    for kind, p in L.PATTERNS:
        for m in re.finditer(p, text):
            offer(m.start(), m.end(), kind)
    for p, groups in L.CONTEXTS:
        for m in re.finditer(p, text):
            for g in groups:
                if m[g] not in L.STOP_WORDS:
                    offer(m.start(g), m.end(g), "name")
    for m in re.finditer(r"\b[A-Z][a-z]+\b", text):
        if m[0] in L.GAZETTEER_CITIES:
            offer(m.start(), m.end(), "address")
    names = {*L.SURNAMES_KNOWN, *L.SURNAME_DECOYS, *L.FIRST_KNOWN, *L.FIRST_DECOYS}
    for m in re.finditer(r"\b[A-Z][a-z]{2,}\b", text):
        if m[0] in names and m[0] not in L.STOP_WORDS:
            offer(m.start(), m.end(), "name")
    return sorted(found)


def spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("s", detection.detect(F.col("text"))).orderBy("i").collect()
    return [[tuple(x) for x in r.s] for r in rows]


@pytest.mark.parametrize("text,kind", [
    ("SSN 123-45-6789 on file", "ssn"), ("call (555) 867-5309 today", "phone"), ("email jane.doe12@example.com please", "email"), ("see https://portal.example.com/case/12345 for detail", "url"),
    ("submitted from 192.168.14.7 at noon", "ip"), ("record MRN1234567 pulled", "mrn"), ("member H123456789 verified", "member_id"), ("auth ACCT-889231 approved", "account_number"),
    ("service on 03/14/2024 billed", "date"), ("lives at 417 Elm St now", "address"),
])
def test_structured(spark, text, kind):
    assert kind in {s[2] for s in spans(spark, [text])[0]}


def test_names(spark):
    told = spans(spark, ["Spoke with member Robert Johnson today", "Spoke with member Gregory Wojciechowski today", "Wojciechowski was mentioned.", "auto Foo Bar", "URL https://a.b/c. Lipitor", None, ""])
    values = [[s[3] for s in x] for x in told]
    assert "Johnson" in values[0] and "Wojciechowski" in values[1] and values[2] == [] and values[3] == ["Foo", "Bar"] and values[4] == ["https://a.b/c."] and values[5] == values[6] == []


def test_detection_follows_the_rules_in_order(spark):
    rnd = random.Random(4)
    bits = ["Dr. Smith", "for Ann Lee", "Patient Bob Stone", "12345", "417 Elm St", "John seen", "Mary King filed", "03/14/2024", "2024-03-14", "10.0.0.1", "x@y.com", "555-123-4567", "Springfield", "é12345", "Teö", "😀", "Note", "Case", "by", "to", "123-45-6789", "ACCT-12345", "mrn 12345", "H123456789", "https://x.y/z,"]
    texts = [" ".join(rnd.choice(bits) for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    assert spans(spark, texts) == [plain(t) for t in texts]


def test_redaction(spark):
    texts = ["Paid 2024-03-14 to James Smith at 05901, 45501-1234", "on 02/30/2024 and 03-14-2024", "😀 MRN1234567 H123456789 ACCT-123456", None]
    rows = spark.createDataFrame([(str(i), "M1", t) for i, t in enumerate(texts)], "note_id string, member_id string, text string")
    clean = [r.clean for r in redaction.redact(rows, SALT).orderBy("note_id").collect()]
    assert re.fullmatch(r"Paid \d\d/\d\d/202[34] to NAME-\w{10} NAME-\w{10} at 000XX, 455XX", clean[0])
    assert clean[1] == "on [DATE] and [DATE]" and re.fullmatch(r"😀 MRN-\w{10} MBR-\w{10} \[ACCOUNT\]", clean[2]) and clean[3] is None


def test_notes_and_members_share_keys(spark):
    m = spark.createDataFrame([("H123456789", "05901", "VT", 40, "F"), ("P000000001", "45501", "OH", 91, "M")], "member_id string, zip5 string, state string, age int, sex string")
    told = redaction.deidentify_members(m, SALT).orderBy("zip3").collect()
    assert [r.zip3 for r in told] == ["000", "455"] and told[1].age_band == "90+" and "45501" not in str(told)
    note = spark.createDataFrame([("n", "H123456789", "id H123456789")], "note_id string, member_id string, text string")
    assert redaction.redact(note, SALT).first().clean == "id " + told[0].member_key


def plain_score(truth, found, tolerance):
    used, out = set(), []
    for t in truth:
        free = [i for i in range(len(found)) if i not in used]
        exact = [i for i in free if abs(found[i][0] - t[0]) <= tolerance and abs(found[i][1] - t[1]) <= tolerance and found[i][2] == t[2]]
        hit = (exact or [i for i in free if found[i][0] < t[1] and t[0] < found[i][1]] or [None])[0]
        used.add(hit)
        out.append((t[2], int(hit is not None), int(hit is None), 0))
    return out + [(f[2], 0, 0, 1) for i, f in enumerate(found) if i not in used]


@pytest.mark.parametrize("tolerance", [0, 2])
def test_scoring_matches_greedily(spark, tolerance):
    rnd = random.Random(5)

    def some():
        starts = sorted(rnd.sample(range(40), rnd.randint(0, 5)))
        return [(s, s + rnd.randint(1, 6), rnd.choice("ab"), "") for s in starts]

    cases = [(str(i), some(), some()) for i in range(150)]
    notes = spark.createDataFrame([(k, f) for k, f, _ in cases], f"note_id string, spans {SPAN}")
    truth = spark.createDataFrame([(k, *t) for k, _, ts in cases for t in ts], "note_id string, start int, end int, type string, value string")
    got = sorted(tuple(r) for r in scoring.score_notes(notes, truth, tolerance).collect())
    assert got == sorted((k, *r) for k, f, t in cases for r in plain_score(sorted(t), f, tolerance))


def test_score_totals(spark):
    rows = spark.createDataFrame([("n", "a", 1, 0, 0), ("n", "a", 0, 1, 0), ("n", "b", 0, 0, 1)], "note_id string, type string, tp int, fn int, fp int")
    told = {r.type: r for r in scoring.by_type(rows).collect()}
    assert told["a"].recall == 0.5 and told["a"].precision == 1.0 and told["b"].recall is None and told["b"].precision == 0.0
    assert scoring.overall(scoring.by_type(rows)).first().recall == 0.5 and scoring.overall(scoring.by_type(rows.limit(0))).first().recall is None


def test_catalogue():
    assert [r[0] for r in L.SAFE_HARBOR] == list(range(1, 19)) and all("N/A" in r[5] for r in L.SAFE_HARBOR if not r[2])


def test_catalogue_with_what_is_found(spark):
    types = spark.createDataFrame([("address", 3, 1, 0, 4), ("zip", 2, 0, 5, 2), ("ssn", 0, 0, 1, 0)], "type string, tp long, fn long, fp long, n_truth long")
    told = {r.n: r for r in scoring.catalogue(types).collect()}
    assert sorted(told) == list(range(1, 19)) and (told[2].n_planted, told[2].n_caught) == (6, 5) and abs(told[2].recall - 5 / 6) < 1e-12
    assert all((told[n].n_planted, told[n].n_caught, told[n].recall) == (0, 0, None) for n in told if n != 2)
    assert all(r.n_planted == 0 for r in scoring.catalogue(types.limit(0)).collect())
    assert sorted({t for types in L.SAFE_HARBOR_TYPES.values() for t in types}) == sorted(set(L.FIELD_TYPES.values()))


def test_generated_notes(spark):
    made = synth.generate(spark, 800)
    notes = {r.note_id: r.text for r in made["notes"].collect()}
    truth = made["truth_spans"].collect()
    assert all(notes[t.note_id][t.start : t.end] == t.value for t in truth)
    types = {r.type: r for r in scoring.by_type(scoring.score_notes(detection.with_spans(made["notes"]), made["truth_spans"])).collect()}
    assert 0.90 <= types["name"].recall <= 0.97 and 0.75 <= types["address"].recall <= 0.92
    assert all(r.recall == 1.0 for k, r in types.items() if k not in ("name", "address"))
    again = {r.note_id: r.text for r in synth.generate(spark, 800)["notes"].repartition(7).collect()}
    assert again == notes
    members = made["members"].agg(F.avg((~F.col("name_in_gazetteer")).cast("int")).alias("unseen"), F.avg(F.col("zip5").isin(L.SMALL_ZIPS).cast("int")).alias("small"), F.countDistinct("member_id").alias("n")).first()
    assert 0.25 < members.unseen < 0.35 and 0.05 < members.small < 0.11 and members.n == 800


def test_stream_gives_the_same_texts(spark, tmp_path):
    made = synth.generate(spark, 60)["notes"]
    made.write.parquet(f"{tmp_path}/in")
    stream.write_redacted(stream.read_notes(spark, f"{tmp_path}/in"), SALT, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    want = {(r.note_id, r.clean) for r in redaction.redact(made, SALT).collect()}
    assert {(r.note_id, r.clean) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_no_python_on_executors(spark):
    notes = spark.createDataFrame([("n", "m", "t")], "note_id string, member_id string, text string")
    plan = redaction.redact(notes, SALT)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)


def test_many_identifiers_in_a_long_text(spark):
    """A megabyte of matches takes seconds, and packing in clusters gives what one list gives."""
    part = "Patient Ann Lee at 12 Oak Ave Dr. Smith 123-45-6789 for Mary Jones, 45501 Springfield 10.0.0.1 jane@x.org "
    long = part * 9000
    rows = spark.createDataFrame([(1, part, "m"), (2, long, "m")], "note_id int, text string, member_id string")
    began = time.time()
    told = {r.note_id: r for r in redaction.redact(rows, "salt").collect()}
    assert time.time() - began < 60
    one = [(s.start, s.end, s.type, s.value) for s in told[1].spans]
    assert len(told[2].spans) == 9000 * len(one) and told[2].clean == told[1].clean * 9000
    assert [(s.start, s.end, s.type, s.value) for s in told[2].spans[-len(one) :]] == [(a + 8999 * len(part), b + 8999 * len(part), t, v) for a, b, t, v in one]


def test_packing_in_clusters(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        spans = []
        for _ in range(rnd.randint(0, 60)):
            a = rnd.randint(0, 300)
            spans.append((a, a + rnd.randint(1, 25), rnd.choice("xyz"), str(len(spans))))
        rows.append((i, spans))
    c = spark.createDataFrame(rows, "i int, c " + detection.SPAN)
    for r in c.select("i", detection._packed(F.col("c")).alias("a"), detection._packed_apart(F.col("c")).alias("b")).collect():
        taken = []
        for s in rows[r.i][1]:
            if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
                taken.append(s)
        assert [tuple(x) for x in r.a] == sorted(taken) == [tuple(x) for x in r.b]
