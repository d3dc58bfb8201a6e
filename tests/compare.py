"""A query's rows beside those of its SQL in DuckDB, over the tables of one folder."""

import os

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(v[k]) for k in order) for v in values)


def same(spark, query, sql):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF_DIR}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    told = db.execute(sql)
    names = [c[0] for c in told.description]
    df = query(spark, SF_DIR)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, told.fetchall())
