"""Phrases whose words come together more often than by chance, by language.

(1) Texts become numbered words, a row of some CHUNK bytes for a language's, in the shared folder; texts are read this once.
(2) Level by level chunks send hashes and counts of the phrases whose two shorter parts survived, to parts of the hash space,
which answer whether the sum may reach the limit; hashes that fall together only add to it, so no phrase is lost. (3) Chunks
send the survivors themselves. Each part has a minimal perfect hash over its phrases with the phrases as stored keys; mappers
sum counts into an array by slot, arrays are summed in a tree. (4) Parts ask each other, once for each phrase, for the counts
of their phrases' cuts, which are read by slot, and tell the longest phrases' counts on the way.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_dir, ship, shuffles, slices, table
from .hash_parts import ANSWERS, LOW, answer, by_part, flags_of, numbers_of, steps_of
from .perfect_hash import PerfectHash, digests, strings

LEAST, WORDS, MOST, PERCENT = 100, 5, 2000, 100
#: Bytes of text in a chunk and cut into words at a time; words in a part of the hash space; phrases in a part; chunks for each mapper, which are at most so many a part.
CHUNK, SLICE, PART, PHRASES, EACH, MAPPERS = 12 << 20, 1 << 20, 4 << 20, 1 << 19, 64, 16
BASE = np.uint64(0x9E3779B97F4A7C15)
#: A-Z in lower case, and a full stop for all that parts pieces.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz.........")
STATE, PHRASE = 0, 1
ROWS = "kind int, chunk long, lang string, part int, words array<binary>, ids binary, alive binary, counts array<long>, n long"


def _press(x: bytes | np.ndarray) -> bytes:
    return zlib.compress(x if isinstance(x, bytes) else x.tobytes(), 1)


def _cut_words(text: bytes) -> pa.Array:
    """Words of a text and a full stop between pieces."""
    text = text.translate(FOLD).replace(b".", b" . ")
    one = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(text)], np.int32)), pa.py_buffer(text))
    words = pc.list_flatten(pc.ascii_split_whitespace(one)).cast(pa.binary())
    return words.filter(pc.greater(pc.binary_length(words), 0))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one language each: its distinct words, and all texts as their numbers, -1 between pieces."""
    held: dict[str, list[pa.Array]] = {}
    size, task, seen = 0, TaskContext.get().partitionId() << 24, itertools.count()

    def flush() -> pa.RecordBatch:
        rows = []
        for lang, words in held.items():
            told = pa.concat_arrays(words).dictionary_encode()
            ids, names = told.indices.to_numpy().astype(np.int32), told.dictionary.to_pylist()
            stop = names.index(b".")
            ids = np.where(ids == stop, -1, ids - (ids > stop)).astype(np.int32)
            del names[stop]
            rows.append((STATE, task + next(seen), lang, None, names, _press(ids), None, None, int((ids >= 0).sum())))
        held.clear()
        return _batch(rows)

    for b in batches:
        langs = b.column(0).fill_null("und").dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = b.column(1).filter(pc.equal(langs.indices, k)).fill_null("").cast(pa.binary())
            for low, high in slices(pc.binary_length(texts).to_pylist(), SLICE):
                text = b".".join([*texts.slice(low, high - low).to_pylist(), b""])
                held.setdefault(lang, []).append(_cut_words(text))
                size += len(text)
                if size >= CHUNK:
                    yield flush()
                    size = 0
    if held:
        yield flush()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "chunk": pa.int64(), "lang": pa.string(), "part": pa.int32(), "words": pa.list_(pa.binary()), "ids": pa.binary(), "alive": pa.binary(), "counts": pa.list_(pa.int64()), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())], list(kinds))


class Chunk:
    """A chunk's words before a level: where phrases one word shorter survived, and so where the level's candidates are."""

    def __init__(self, row: dict, level: int, parts: int):
        self.lang, self.level, self.number, self.n = row["lang"], level, row["chunk"], row["n"]
        self.words = row["words"]
        self.ids = np.frombuffer(zlib.decompress(row["ids"]), np.int32)
        if level == 1:
            self.at = np.flatnonzero(self.ids >= 0)
        else:
            alive = np.unpackbits(np.frombuffer(zlib.decompress(row["alive"]), np.uint8), count=len(self.ids)).astype(bool)
            self.at = np.flatnonzero(alive[:-1] & alive[1:])
        own = digests(strings([self.lang.encode()]))[0][0]
        of = digests(strings(self.words))[0] if self.words else np.zeros(0, np.uint64)
        h = np.full(len(self.at), own, np.uint64) + np.uint64(level)
        for j in range(level):
            h = (h ^ (h >> np.uint64(31))) * BASE + of[self.ids[self.at + j]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        #: The part above 32 bits of the hash, of each candidate; distinct ones, and each candidate's among them.
        self.keys, self.which, self.counts = np.unique((h >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | h & LOW, return_inverse=True, return_counts=True)

    def survivors(self, flags: np.ndarray, parts: int) -> Iterator[tuple]:
        """The state for the next level, and the phrases that survived this one, by part of the phrases' own hash."""
        own = self.lang.encode() + b"."  # no phrase holds a full stop
        kept = self.at[flags[self.which]] if len(self.at) else self.at
        if len(kept):
            alive = np.zeros(len(self.ids), bool)
            alive[kept] = True
            near = np.zeros(len(self.ids) + 1, np.int32)
            near[kept] += 1
            near[kept + self.level] -= 1
            covered = np.cumsum(near)[:-1] > 0  # other words are not needed any more; one gap stays between those that are
            used = covered.copy()
            used[1:] |= covered[:-1]
            ids = np.where(covered, self.ids, -1)[used]
            yield STATE, self.number, self.lang, None, self.words, _press(ids), _press(np.packbits(alive[used])), None, self.n
            spelled = self.ids[kept[:, None] + np.arange(self.level)].astype(np.int64)
            code = spelled[:, 0]
            for j in range(1, self.level):  # a number for each beginning, and then for each phrase
                code = np.unique(code * len(self.words) + spelled[:, j], return_inverse=True)[1]
            _, first, count = np.unique(code, return_index=True, return_counts=True)
            names = [own + b" ".join([self.words[k] for k in row]) for row in spelled[first].tolist()]
        else:
            names, count = [], np.zeros(0, np.int64)
        if self.level == 1:  # the phrase of no words: all words of the language
            names, count = [*names, own], np.append(count, self.n)
        if names:
            part = part_of(names, parts)
            order = np.argsort(part, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                yield PHRASE, self.number, None, int(part[mine[0]]), [names[k] for k in mine], None, None, count[mine].tolist(), None


def part_of(names: list[bytes], parts: int) -> np.ndarray:
    return ((digests(strings(names))[0] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def tree_sum(arrays: DataFrame, groups: int, fan: int = 4) -> DataFrame:
    """``(part, totals)`` of rows ``(part, g, totals)``, g below groups: neighbours are added, then sums of neighbours."""

    def add(group: pa.Table) -> pa.Table:
        totals = sum(np.frombuffer(x, np.int64) for x in group.column("totals").to_pylist())
        return pa.table({"part": group.column("part")[:1], "g": pa.array([group.column("g")[0].as_py() // fan], pa.int32()), "totals": pa.array([totals.tobytes()], pa.binary())})

    while groups > 1:
        arrays = arrays.groupBy("part", F.floor(F.col("g") / fan).alias("to")).applyInArrow(add, "part int, g int, totals binary")
        groups = -(-groups // fan)
    return arrays.select("part", "totals")


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, most: int = MOST, percent: int = PERCENT, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``most`` best phrases of 2 to ``words`` words that occur ``least`` times.

    A-Z count as lower case; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. Of the cuts of a phrase that occurs a
    times the one with the lowest score floor(1000 a n / (l r)) counts, l and r being the parts' occurrences and n the language's
    words; ties go to the shorter first part. A phrase inside a longer one that occurs percent% as often is left out. Best is the
    higher score, then the higher a, then the smaller phrase by bytes. Null texts are empty, a null language is ``und``; repeated rows
    count each time; very long texts are cut into words by one task. An empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    state = _written(spark, docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).mapInArrow(_number, ROWS))
    told = state.agg(F.sum("n").alias("n"), F.count("*").alias("chunks")).first()
    parts = max(1, shuffles(spark), -(-(told.n or 0) // PART))
    kept = []
    for level in range(1, words + 1):
        rows = _written(spark, _level(state, level, parts, least))
        kept.append(rows.where(F.col("kind") == PHRASE).select("part", "chunk", "words", "counts"))
        state = rows.where(F.col("kind") == STATE)
    phrases = kept[0]
    for more in kept[1:]:
        phrases = phrases.union(more)
    counted = _counted(phrases, min(MAPPERS, -(-told.chunks // EACH)))
    asked = counted.groupBy("part").applyInArrow(lambda group: _ask(group, parts, least), "part int, asker int, words array<binary>, counts array<long>")
    replies = asked.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(lambda group, own: _reply(group, own, percent), "part int, words array<binary>, counts array<long>")
    found = counted.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(
        lambda own, told: _judge(own, told, least, most), "part int, lang string, phrase string, a long, l long, r long, n long, score long"
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = F.pmod("part", F.lit(max(1, int(parts**0.5))))
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("lang", few).orderBy(*order))).where(F.col("k") <= most)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _written(spark, df: DataFrame) -> DataFrame:
    at = fresh_dir(spark, "phrases")
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


def _level(state: DataFrame, level: int, parts: int, least: int) -> DataFrame:
    """Of each chunk the state for the next level and this one's surviving phrases: all that occur ``least`` times, and few others."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                chunk = Chunk(row, level, parts)
                full, ends = by_part(chunk.keys, parts)
                hashes = [steps_of(chunk.keys[ends[p] : ends[p + 1]] & LOW) for p in full]
                counts = [_press(chunk.counts[ends[p] : ends[p + 1]].astype(np.uint32)) for p in full]
                here = pa.array([chunk.number] * len(full), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), here, pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], ["part", "chunk", "hashes", "counts"])

    def count(group: pa.Table) -> pa.Table:
        sent = [numbers_of(x) for x in group.column("hashes").to_pylist()]
        counts = [np.frombuffer(zlib.decompress(x), np.uint32) for x in group.column("counts").to_pylist()]
        _, back = np.unique(np.concatenate(sent), return_inverse=True)
        many = (np.bincount(back, np.concatenate(counts)) >= least)[back]
        return answer(group, np.split(many, np.cumsum([len(x) for x in sent])[:-1]))

    def keep(group: pa.Table, answers: pa.Table) -> pa.Table:
        flags = np.concatenate([np.zeros(0, bool), *flags_of(answers, "bits")])
        return pa.Table.from_batches([_batch([out for row in group.to_pylist() for out in Chunk(row, level, parts).survivors(flags, parts)])])

    sent = state.mapInArrow(send, "part int, chunk long, hashes binary, counts binary")
    answers = sent.groupBy("part").applyInArrow(count, ANSWERS.replace("chunk int", "chunk long"))
    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(keep, ROWS)


def _counted(phrases: DataFrame, mappers: int) -> DataFrame:
    """``(part, words, totals)``: phrases by slot and how often each occurs."""
    mappers = max(1, mappers)

    def build(group: pa.Table) -> pa.Table:
        names = set().union(*group.column("words").to_pylist())
        return pa.table({"part": group.column("part")[:1], "words": pa.array([PerfectHash(sorted(names)).keys.tolist()], pa.list_(pa.binary()))})

    def add(group: pa.Table, index: pa.Table) -> pa.Table:
        table_ = PerfectHash(index.column("words")[0].as_py())
        totals = np.zeros(len(table_.keys), np.int64)
        for names, counts in zip(group.column("words").to_pylist(), group.column("counts").to_pylist()):
            totals += np.bincount(table_.slots(names), counts, len(totals)).astype(np.int64)
        return pa.table({"part": index.column("part")[:1], "g": index.column("g")[:1], "totals": pa.array([totals.tobytes()], pa.binary())})

    index = cut(phrases.groupBy("part").applyInArrow(build, "part int, words array<binary>"))
    dealt = phrases.withColumn("g", F.pmod(F.xxhash64("chunk"), F.lit(mappers)).cast("int"))
    cells = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(mappers - 1))))
    arrays = dealt.groupBy("part", "g").cogroup(cells.groupBy("part", "g")).applyInArrow(add, "part int, g int, totals binary")
    return cut(index.join(tree_sum(arrays, mappers), "part"))


def _own(group: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return group.column("words")[0].as_py(), np.frombuffer(group.column("totals")[0].as_py(), np.int64)


def _candidates(group: pa.Table, least: int) -> Iterator[tuple[bytes, list[bytes], int]]:
    """Language, words and count of the part's phrases of several words that occur often enough."""
    for name, a in zip(*_own(group)):
        if a >= least and b" " in name[(stop := name.rindex(b".") + 1) :]:
            yield name[:stop], name[stop:].split(b" "), int(a)


def _ask(group: pa.Table, parts: int, least: int) -> pa.Table:
    """All phrases inside the part's candidates, each once, with the largest count of those; and the languages' totals."""
    told: dict[bytes, int] = {}
    for lang, words, a in _candidates(group, least):
        told.setdefault(lang, 0)
        for size in range(1, len(words)):
            for k in range(len(words) - size + 1):
                name = lang + b" ".join(words[k : k + size])
                told[name] = max(told.get(name, 0), a)
    names = list(told)
    part = part_of(names, parts) if names else np.zeros(0, np.int64)
    here = group.column("part")[0].as_py()
    order = np.argsort(part, kind="stable")
    rows = [(int(part[m[0]]), here, [names[k] for k in m], [told[names[k]] for k in m]) for m in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(m)]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["part", "asker", "words", "counts"])


def _reply(group: pa.Table, own: pa.Table, percent: int) -> pa.Table:
    """To each asker its phrases' counts; to the part itself the phrases that a longer one leaves out."""
    names, totals = _own(own)
    table_ = PerfectHash(names)
    longest, rows = np.zeros(len(names), np.int64), []
    for asker, asked, counts in zip(*(group.column(c).to_pylist() for c in ("asker", "words", "counts"))):
        slots = table_.slots(asked)
        np.maximum.at(longest, slots, counts)
        rows.append((asker, asked, totals[slots].tolist()))
    gone = [table_.keys[k] for k in np.flatnonzero(longest > 0) if 100 * int(longest[k]) >= percent * int(totals[k])]
    rows.append((own.column("part")[0].as_py(), gone, None))
    kinds = [pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "words", "counts"])


def _judge(own: pa.Table, told: pa.Table, least: int, most: int) -> pa.Table:
    """The part's candidates with their lowest-scoring cuts, of each language the best."""
    known: dict[bytes, int] = {}
    gone: set[bytes] = set()
    for names, counts in zip(told.column("words").to_pylist(), told.column("counts").to_pylist()):
        if counts is None:
            gone.update(names)
        else:
            known.update(zip(names, counts))
    rows: dict[bytes, list[tuple]] = {}
    for lang, words, a in _candidates(own, least):
        phrase = b" ".join(words)
        if lang + phrase in gone:
            continue
        n, cuts = known[lang], []
        for k in range(1, len(words)):
            l, r = known[lang + b" ".join(words[:k])], known[lang + b" ".join(words[k:])]  # noqa: E741
            cuts.append((1000 * a * n // (l * r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        rows.setdefault(lang, []).append((-score, -a, phrase, l, r, n))
    here = own.column("part")[0].as_py() if len(own) else -1
    out = [(here, lang[:-1].decode(), x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, mine in rows.items() for x in sorted(mine)[:most]]
    kinds = [pa.int32(), pa.string(), pa.string()] + [pa.int64()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=["part", "lang", "phrase", "a", "l", "r", "n", "score"])


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d
), g AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
      SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest(range(1, {WORDS + 1})) AS size) s WHERE len(w) >= size) x) y
  GROUP BY lang, size, phrase
), n AS (
  SELECT lang, sum(f) AS n FROM g WHERE size = 1 GROUP BY lang
), c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE size >= 2 AND f >= {LEAST}
), inside AS (
  SELECT lang, phrase, max(a) AS longest FROM (
    SELECT lang, a, array_to_string(w[i:i + len - 1], ' ') AS phrase FROM (
      SELECT lang, a, w, len, unnest(range(1, size - len + 2)) AS i FROM c, (SELECT unnest(range(2, {WORDS})) AS len) s WHERE len < size) x) y
  GROUP BY lang, phrase
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:size], ' ') AS p2 FROM (SELECT *, unnest(range(1, size)) AS k FROM c) x
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, f1.f AS l, f2.f AS r, n, CAST(1000 AS HUGEINT) * a * n // (CAST(f1.f AS HUGEINT) * f2.f) AS score
  FROM cuts JOIN g f1 ON f1.lang = cuts.lang AND f1.phrase = p1 JOIN g f2 ON f2.lang = cuts.lang AND f2.phrase = p2 JOIN n ON n.lang = cuts.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS least FROM scored
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inside ON inside.lang = b.lang AND inside.phrase = b.phrase WHERE least = 1 AND (longest IS NULL OR 100 * longest < {PERCENT} * a)
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {MOST}
"""
