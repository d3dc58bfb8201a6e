"""Repeated windows of words against a plain version."""

import hashlib
import math
import random
import re

import pytest

from claimveil.llm import window_dedup
from tests.llm.test_llm import SCHEMA, corpus, frame, words


def plain(rows, length):
    """Kept words and removed intervals of each row, rows without an id last."""
    order = sorted(range(len(rows)), key=lambda k: (math.inf if rows[k][0] is None else rows[k][0], (rows[k][1] or "").encode()))
    seen, out = set(), []
    for k in order:
        w = re.findall(r"[^ \t-\r]+", rows[k][1] or "")
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if key in seen:
                gone[p : p + length] = [True] * length
            seen.add(key)
        spans = [(m.start(), m.end()) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out.append((rows[k][0], " ".join(x for x, g in zip(w, gone) if not g), spans, len(w), sum(gone)))
    return out


def check(df, rows, length):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = plain(rows, length)
    told = window_dedup.remove_repeated_windows(df, length).collect()
    assert sorted(((r.doc_id, r.kept, [tuple(s) for s in r.spans]) for r in told), key=key) == sorted((x[:3] for x in want), key=key)
    told = window_dedup.remove_repeated_windows(df, length, output="digest").collect()
    assert sorted(map(tuple, told), key=key) == sorted(((i, n, m, hashlib.sha256(kept.encode()).hexdigest()) for i, kept, _, n, m in want), key=key)


@pytest.mark.parametrize("length", [20, 3, 1])
def test_windows(spark, length):
    rows = corpus()
    rows += [(900, "a\tb\n\x0bc  d " * 30, None, None, None), (901, "one two three", None, None, None), (902, "\u00a0é\u2003 x" * 50, None, None, None), (None, None, None, None, None)]
    check(frame(spark, rows), rows, length)


def test_no_rows(spark):
    assert window_dedup.remove_repeated_windows(frame(spark, [])).collect() == []
    one = [(None, None, None, None, None)]
    check(frame(spark, one), one, 20)


def test_one_passage_in_many_documents_and_chunks(spark, monkeypatch):
    """Thousands of documents that share a passage, many chunks, and negative and huge ids."""
    monkeypatch.setattr(window_dedup, "CHUNK", 20000)
    monkeypatch.setattr(window_dedup, "PART", 40000)
    rnd = random.Random(4)
    passage = words(rnd, 25)
    rows = [((i - 700) * (1 << 40) if i % 9 else None, f"{words(rnd, 8)} x{i} {passage} y{i}", "en", "s", 1) for i in range(1500)]
    check(frame(spark, rows), rows, 20)


def test_first_count_may_err(spark, monkeypatch):
    """Hashes that differ in the further bits alone aren't equal."""
    monkeypatch.setattr(window_dedup, "LOW", window_dedup.LOW & window_dedup.LOW.__class__(0xF))
    rows = corpus(seed=3)
    check(spark.createDataFrame(rows, SCHEMA), rows, 5)
