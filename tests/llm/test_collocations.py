"""Collocations and the perfect hash against plain versions."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from claimveil.llm import collocations, perfect_hash
from tests.llm.test_llm import frame, words


def plain(rows, least, longest, most, percent):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\n-\\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for k in range(len(w) - size + 1):
                    f[lang][tuple(w[k : k + size])] += 1
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[k : k + size] for p, a in found.items() for size in range(2, len(p)) for k in range(len(p) - size + 1) if 100 * a >= percent * count[p[k : k + size]]}
        told = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                told.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(told)[:most])]
    return sorted(out)


def texts(seed, n):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        text = " ".join(rnd.choice([words(rnd, 3), "New York", "new york city", "à la Carte", "Of Course.", "a, b", "x\ty", "a  a a a", "\u00a0 É\u2003z", "o.k"]) for _ in range(rnd.randint(0, 30)))
        rows.append((i, text, rnd.choice(["en", "en", "fr", None, "und", "a.b", "l\nm", ""]), "s", 1))
    return rows + [(None, None, None, None, None), (1, "", "xx", None, 0), (2, "one two", "yy", None, 0), rows[0], (3, "A B " * 5000, "en", "s", 0)]


@pytest.mark.parametrize("least, longest, most, percent", [(3, 5, 2000, 100), (2, 3, 4, 60), (1, 2, 7, 100)])
def test_collocations(spark, monkeypatch, least, longest, most, percent):
    monkeypatch.setattr(collocations, "CHUNK", 3000)
    monkeypatch.setattr(collocations, "SLICE", 500)
    monkeypatch.setattr(collocations, "EACH", 2)
    rows = texts(5, 150)
    told = collocations.collocations(frame(spark, rows), least, longest, most, percent)
    assert told.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, told.collect())) == plain(rows, least, longest, most, percent)


def test_no_phrases(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, "one two", "en", "s", 1), (2, None, None, None, None)])).collect() == []


def test_perfect_hash():
    keys = [f"key {k}".encode() for k in range(5000)] + [b"", b"\0", b"\0\0", "é".encode()]
    index = perfect_hash.PerfectHash(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert [index.keys[k] for k in index.slots(keys)] == keys
    assert (index.slots([f"other {k}".encode() for k in range(5000)]) == -1).all()
    assert len(index.bits) < 8 * len(keys) and (perfect_hash.PerfectHash(keys[::-1]).slots(keys) == index.slots(keys)).all()
    assert perfect_hash.PerfectHash([]).slots([b"x"]).tolist() == [-1]
    with pytest.raises(ValueError):
        perfect_hash.PerfectHash([b"a", b"a"])


def test_tree_sum(spark):
    rows = [(p, g, np.array([g, 1, p]).tobytes()) for p, g in itertools.product(range(3), range(11))]
    told = collocations.tree_sum(spark.createDataFrame(rows, "part int, g int, totals binary"), 11).collect()
    assert {r.part: np.frombuffer(r.totals, np.int64).tolist() for r in told} == {p: [55, 11, 11 * p] for p in range(3)}
