"""The pipeline's stages, one by one, against plain versions."""

import collections
import math
import re

import numpy as np
import pytest

import corpus_pipeline
from claimveil.llm import mixing, quality
from claimveil.llm.common import fresh_dir
from tests.llm.test_llm import SCHEMA, SECRETS, corpus, frame


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [r for r in corpus() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(500 + i, t, "en", "s1", len(t or "")) for i, t in enumerate(SECRETS)]
    rows += [(600 + i, " ".join(w.upper() + "!!" for w in f"bad thing number {i} again and more of it".split()) * 4, "en", "s2", 9) for i in range(80)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 600), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), number in zip(corpus_pipeline.STAGES, (7, 2, 8, 6, 9), strict=True):
        before = {r.doc_id: r for r in docs.collect()}
        copies = collections.Counter(r.doc_id for r in docs.collect())
        at = fresh_dir(spark, name)
        stage(spark, docs, folder).write.parquet(at)
        docs = spark.read.parquet(at)
        after = docs.collect()
        if number == 7:
            model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            want = {i for i, r in before.items() if model.predict(np.array([quality.statistics((r.text or "").encode())]))[0] >= quality.THRESHOLD}
            assert {r.doc_id for r in after} == want and not any(i >= 600 for i in want)
        elif number == 2:
            words = {i: (r.text or "").encode().lower().split() for i, r in before.items()}
            prints = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
            group = {i: {i} for i in prints}
            for i in prints:
                for j in prints:
                    if i < j and len(prints[i] & prints[j]) >= 0.8 * len(prints[i] | prints[j]) and group[i] is not group[j]:
                        group[i] |= group[j]
                        for k in group[j]:
                            group[k] = group[i]
            assert {r.doc_id for r in after} == {min(g) for g in group.values()}
        elif number == 8:
            assert {r.doc_id for r in after} == set(before)
            assert not any(re.search("hunter2|aZ3kP9|AKIAABC", r.text or "") for r in after)
            assert all(r.text == before[r.doc_id].text for r in after if r.doc_id < 500)
        elif number == 6:
            told = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(list(before.values()), SCHEMA)).collect()}
            assert collections.Counter(r.doc_id for r in after) == collections.Counter({i: n for i, n in told.items() if n})
        else:
            assert collections.Counter(r.doc_id for r in after if r.piece == 0) == copies
            used = collections.defaultdict(int)
            for r in after:
                used[r.sequence_id] += r.length
            assert max(used.values()) <= 2048 and len(used) <= 1.05 * math.ceil(sum(used.values()) / 2048) + 1
        assert number == 9 or docs.columns == columns


def test_run(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and packed.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, folder):
    """Null ids, repeated rows, null texts and columns that operators use too, through each stage but the last with the same columns."""
    rows = corpus()
    docs = frame(spark, [*rows, *rows[:5], (None, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None)])
    for (name, stage), number in zip(corpus_pipeline.STAGES, (7, 2, 8, 6, 9), strict=True):
        at = fresh_dir(spark, name)
        stage(spark, docs, folder).write.parquet(at)
        after = spark.read.parquet(at)
        assert number == 9 or after.columns == docs.columns
        if number == 2:
            told = [r.text for r in after.where("doc_id is null").collect()]
            assert told == ["a b c d e f"] and after.count() == after.select("doc_id", "text").distinct().count()
        elif number in (7, 8):
            assert after.count() == docs.count() or number == 7
        docs = after


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
