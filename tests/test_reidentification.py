import random
import re

import pytest
from pyspark.sql import functions as F

from claimveil.functions.scalar import coarsen_age_band
from claimveil.operators import reidentification as K


def table(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in (x.split(":") for x in names.split())))


def people(spark, n=2000, seed=13):
    rnd = random.Random(seed)
    rows = [(f"K{i}", f"{rnd.randrange(12)}", rnd.choice("FM"), f"{rnd.randrange(6) * 10}-x", rnd.random() < 0.04) for i in range(n)]
    return table(spark, rows, "member_key:string zip3:string sex:string age_band:string cond_cancer:boolean")


def test_k(spark):
    told = K.k_anonymity(table(spark, [("1", "F"), ("1", "F"), ("2", "M")], "z:string s:string"), ["z", "s"]).first()
    assert (told.n_classes, told.min_k, told.records_with_k_1) == (2, 1, 1) and abs(told.pct_unique - 1 / 3) < 1e-12
    none = K.k_anonymity(table(spark, [], "z:string s:string"), ["z", "s"]).first()
    assert none.n_records == 0 and none.min_k == 0 and none.pct_unique == 0


def test_more_knowledge_never_helps_privacy(spark):
    df = people(spark)
    rungs = [["zip3"], ["zip3", "sex"], ["zip3", "sex", "age_band"], ["zip3", "sex", "age_band", "cond_cancer"]]
    told = K.ladder(df, rungs).orderBy("rung").collect()
    for a, b in zip(told, told[1:]):
        assert b.min_k <= a.min_k and b.pct_unique >= a.pct_unique
    for r, q in zip(told, rungs):
        assert r.asDict() == {"rung": r.rung} | K.k_anonymity(df, q).first().asDict()
    sizes = K.size_histogram(df, rungs[3]).collect()
    assert [r.size for r in sizes] == sorted(r.size for r in sizes) and len(sizes) <= 10


def test_linkage(spark):
    released = table(spark, [("K1", "1", "F"), ("K2", "2", "M"), ("K3", "2", "M"), ("K4", None, "F"), ("K5", "5", "F"), ("K6", "6", "F")], "member_key:string z:string s:string")
    roll = table(spark, [("Ann", "1", "F", "M1"), ("Bob", "2", "M", "M2"), ("Nil", None, "F", "M4"), ("C", "5", "F", "X1"), ("D", "5", "F", "X2"), ("E", "6", "F", "X3")], "name:string z:string s:string true_member_id:string")
    links = K.linkage(released, roll, ["z", "s"])
    assert {(r.released, r.guessed_name) for r in links.where("true_member_id is not null").collect()} == {("K1", "Ann"), ("K4", "Nil"), ("K6", "E")}
    told = K.attack(released, roll, ["z", "s"]).first()
    assert (told.n_released, told.n_roll, told.n_reidentified, told.n_unique_but_ambiguous_in_roll, told.rate) == (6, 6, 3, 1, 0.5)
    walk = table(spark, [("K1", "M1"), ("K4", "M4"), ("K6", "M6")], "member_key:string member_id:string")
    right = K.verify(links, walk).first()
    assert (right.n_checked, right.n_correct) == (3, 2) and K.verify(links.limit(0), walk).first().precision == 0
    assert [r.released for r in K.first_links(links, 2).collect()] == ["K1", "K4"]
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


def test_generalise(spark):
    rnd = random.Random(9)
    rows = [(f"K{i}", rnd.choice(["100", "200", "300"]), rnd.choice(["30-34", "35-39", "60-64", "90+"]), rnd.choice("FM")) for i in range(400)] + [("K400", None, "30-34", "F")]
    df = table(spark, rows, "member_key:string zip3:string age_band:string sex:string")
    qis = ["zip3", "age_band", "sex"]
    plain = K.generalise(df, qis, 5)
    told = K.suppression(plain).first()
    assert told.n_kept + told.n_suppressed == 401 and K.k_anonymity(plain.where("kept"), qis).first().min_k >= 5
    assert not plain.where("member_key = 'K400'").first().kept
    coarse = K.suppression(K.generalise(df, qis, 5, {"age_band": coarsen_age_band, "absent": coarsen_age_band})).first()
    assert coarse.n_suppressed <= told.n_suppressed
    dropped = K.generalise(df, qis, 5, K.STEPS[2][1]).select("zip3").distinct().collect()
    assert [r.zip3 for r in dropped] == ["***"]


def test_targets(spark):
    df = people(spark)
    told = {r.known: r for r in K.targeted(df, [(), ("cond_cancer",)]).collect()}
    assert told["cancer"].pct_unique >= told["none"].pct_unique and told["cancer"].carriers_pct_unique > told["none"].pct_unique
    assert told["none"].prevalence is None and 0.02 < told["cancer"].prevalence < 0.06


def test_a_missing_column_is_an_error(spark):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        K.k_anonymity(people(spark, 5), ["no_such_column"]).first()


def test_hash_sample_is_the_same_everywhere(spark):
    df = spark.range(4000).withColumn("k", F.col("id").cast("string"))
    a = {r.id for r in df.where(K.hash_kept("k", 0.85, 99)).collect()}
    assert a == {r.id for r in df.repartition(9).where(K.hash_kept("k", 0.85, 99)).collect()} and 0.82 < len(a) / 4000 < 0.88


def test_nothing_to_verify(spark, tmp_path):
    """Forty copies of each customer, so that nobody is alone: the query tells 0/0 like its SQL, the operator 0."""
    import duckdb

    from claimveil.oracles import ORACLES
    from claimveil.queries import QUERIES

    db = duckdb.connect()
    db.execute(f"COPY (SELECT 1 + i % 95 * 228 AS c_custkey, 0 AS c_nationkey FROM range(40 * 95) t(i)) TO '{tmp_path}/customer.parquet'")
    db.execute(f"COPY (SELECT 0 AS n_nationkey, 'X' AS n_name) TO '{tmp_path}/nation.parquet'")
    for t in ("customer", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = QUERIES["verify_attack"](spark, str(tmp_path))
    names = sorted(df.columns)
    told = db.execute(f"SELECT {', '.join(names)} FROM ({ORACLES['verify_attack']}) x").fetchall()
    assert repr([tuple(r) for r in df.select(*names).collect()]) == repr(told) and told[0][names.index("n_checked")] == 0
