"""The trie of conversations against a plain version."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimveil.llm import prefix_trie
from claimveil.llm.prefix_trie import Entry, LoserTree, prefix_trie as trie, rebuilt, shared, sorted_run, turns_of

SCHEMA = "conv_id long, turn long, role string, text string"
NONE = hashlib.sha256(b"").hexdigest()


def plain(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made = (own.get(c - c % 5, [])[:h] + turns[h:],)[0]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append(c)
        ends[tuple(made)].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, mine in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(mine) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (min(mine), len(k), min(members[k[:-1]]) if k else None, len(mine), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k, mine in members.items()
    )


def chats(seed, n, hot=0):
    """Conversations that share first turns, many of them the same; nulls, repeated turns and rows, turns out of order."""
    rnd, rows = random.Random(seed), []
    for c in range(n):
        turns = [rnd.choice("ab") + "é" * rnd.randint(0, 2) for _ in range(rnd.randint(1, 9))]
        if c % 3 == 0:
            turns = ["hot", "and", "common", *turns[: c % 4]]
        if c < hot:
            turns = ["same"] * 7
        rows += [(c * 3 if c % 7 else 5 * c, k if k or c % 5 else None, "user" if k % 2 == 0 else None, None if t == "a" and c % 4 == 0 else t) for k, t in enumerate(turns)]
    rows += [(None, 1, "user", "x"), (None, None, None, None), (10001, None, None, None), (10002, 1, "user", ""), (10003, 1, "us", "erx"), (10004, 1, "user", "x"), rows[3], rows[3]]
    rows += [(20000, k, "user", f"turn {k % 5}") for k in range(700)] + [(20005, k, "user", f"turn {k % 5}") for k in range(650)]
    rnd.shuffle(rows)
    return rows


def told(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "n_convs": F.lit(0), "turns": F.lit(1)})
    found = trie(rebuilt(turns_of(df)))
    assert found.columns == [x for x in prefix_trie.NAMES[:8]]
    return sorted(map(tuple, found.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def same(spark, rows):
    assert told(spark, rows) == sorted(plain(rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("deep", [1, 2, 8])
def test_trie(spark, monkeypatch, deep):
    monkeypatch.setattr(prefix_trie, "DEEP", deep)
    monkeypatch.setattr(prefix_trie, "RANGE", 800)
    monkeypatch.setattr(prefix_trie, "RUN", 1500)
    same(spark, chats(deep, 300, hot=60))


def test_one_range(spark):
    same(spark, chats(9, 50))


def test_few_rows(spark):
    assert told(spark, []) == [] and told(spark, [(None, 1, "user", "x")]) == []
    same(spark, [(1, 0, "user", "x")])  # h takes the one turn away: the root alone
    same(spark, [(7, None, None, None)])


def test_ends_are_hashed_piece_by_piece():
    parts = [np.arange(k, 60000, 3) for k in range(3)]
    assert prefix_trie.ends_digest(parts) == hashlib.sha256(",".join(map(str, range(60000))).encode()).hexdigest()
    assert prefix_trie.ends_digest([np.arange(0)]) == NONE


def test_shared_turns():
    rnd = random.Random(1)
    for _ in range(500):
        a = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40)) for _ in range(prefix_trie.WIDE))
        n = rnd.randint(0, len(a) // prefix_trie.WIDE)
        b = a[: n * prefix_trie.WIDE] + bytes(rnd.choice(b"ac") for _ in range(rnd.randint(0, 5)) for _ in range(prefix_trie.WIDE))
        want = 0
        while (want + 1) * prefix_trie.WIDE <= min(len(a), len(b)) and a[: (want + 1) * prefix_trie.WIDE] == b[: (want + 1) * prefix_trie.WIDE]:
            want += 1
        assert shared(a, b) == want and shared(a, b, min(n, want)) == want


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16])
def test_loser_tree(n):
    """In order, with what neighbours share, and without comparing shared turns again."""
    rnd = random.Random(n)
    turn = [bytes([x]) * prefix_trie.WIDE for x in range(3)]
    rows = [b"".join([turn[0]] * 30 + [rnd.choice(turn) for _ in range(rnd.randint(0, 4))]) for _ in range(300)]
    runs = [sorted_run([(r, np.zeros(len(r) // prefix_trie.WIDE, np.int64), i) for i, r in enumerate(rows[k::n])]) for k in range(n)]
    tree = LoserTree([iter(r) for r in runs])
    found, before = [], b""
    for e, lcp in tree:
        assert isinstance(e, Entry) and lcp == shared(before, e.digests) or not found
        before = e.digests
        found += [e.digests] * len(e.convs)
    assert found == sorted(rows)
    assert tree.compared < 40 * n + 6 * sum(map(len, runs)) * max(1, n.bit_length())
