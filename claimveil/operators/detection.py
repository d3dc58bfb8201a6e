"""Identifiers in free text: patterns, name contexts and gazetteers, in order of priority; Python runs on the executors only in ``places``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimveil.functions import arrays
from claimveil.functions.joins import checked
from claimveil.operators.spans import PLACES, clusters
from claimveil.sources import lexicon as L

SPAN = "array<struct<start:int,end:int,type:string,value:string>>"
#: Types of spans.
KINDS = sorted({kind for kind, _ in L.PATTERNS} | {"name", "address"})


#: A character that is no part of any pattern's match but a URL's.
MARK = "\x00"
#: White space other than blanks.
SPACES = "\t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces of a text up to which a place is summed up anew for each match.
PIECES = 64
#: Candidates of a text up to which they are packed in one list.
FEW = 64
#: Bytes of a table, by Spark's estimate, up to which ``spread`` may deal its rows out.
DEALT = 256 << 20
#: Characters of a text up to which ``detect_rows`` settles its candidates where it is read.
LONG = 1 << 20


def _span(start: Column, value: Column, kind: Column) -> Column:
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), kind.alias("type"), value.alias("value"))


def _read(text: Column) -> Column:
    """What rules need of a text: ``body``, in which no character is MARK, whether it is ``ascii``, and ``shape``, with 0 for all digits and a blank for all white space.

    Texts that hold digits of other scripts have no shape. A null text is empty.
    """
    body = F.coalesce(text, F.lit(""))
    ascii = F.octet_length(body) == F.length(body)
    shape = F.when(ascii | ~body.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(body, "123456789" + SPACES, "000000000" + " " * len(SPACES)))
    return F.struct(F.replace(body, F.lit(MARK), F.lit("\x01")).alias("body"), ascii.alias("ascii"), shape.alias("shape"))


def _whole(text: Column, spans: Column) -> Column:
    """Spans whose values hold what the text does, where its MARKs were changed."""
    own = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("value"))
    return arrays.bind(spans, lambda found: F.when(text.contains(MARK), F.transform(found, own)).otherwise(found))


def matches(
    read: Column, pattern: str, kind: str | Callable[[Column], Column], groups: tuple[int, ...] = (), parts: int = 0, keep: Callable[[Column], Column] | None = None, signs: list[str] | None = None
) -> Column:
    """Spans of all matches of a pattern, from the left, in code points; read: what ``_read`` tells of a text.

    With groups, which must tile the match, each named group is a span of its own; keep says which words count, if not all. signs: strings
    of which the shape of every match holds one, looked for first. One pass sets MARK around matches and their groups, and the text is
    cut there: what stands before a match, its groups, what stands before the next.
    """
    step, taken = max(parts, 1) + 1, groups or (1,)
    marked = MARK + MARK.join(f"${k}" for k in (range(1, parts + 1) if parts else (0,))) + MARK
    # of ASCII, Unicode's classes hold the same characters as the plain ones, which are faster
    told = F.when(read["ascii"], F.regexp_replace(read["body"], F.lit(pattern), F.lit(marked))).otherwise(F.regexp_replace(read["body"], F.lit("(?U)" + pattern), F.lit(marked)))
    typed = kind if callable(kind) else lambda _: F.lit(kind)
    span = lambda at, value: _span(at, value, typed(value))

    def one(cut: Column) -> Column:
        piece = lambda k: F.get(cut, F.lit(k))
        at, out = F.length(piece(0)), []
        for k in range(1, step):
            if k in taken:
                out.append(span(at, piece(k)))
            at = at + F.length(piece(k))
        return F.filter(F.array(*out), lambda x: keep(x["value"])) if keep else F.array(*out)

    def few(cut: Column) -> Column:
        which = F.sequence(F.lit(1), F.size(cut) - 1, F.lit(2 if step == 2 else 1))
        if step > 2 or keep:
            held = lambda i: reduce(lambda a, b: a | b, [i % step == k for k in taken]) if step > 2 else F.lit(True)
            which = F.filter(which, lambda i: held(i) & keep(F.get(cut, i)) if keep else held(i))
        before = lambda i: F.aggregate(F.slice(cut, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
        return F.transform(F.transform(which, lambda i: F.struct(before(i).alias("at"), F.get(cut, i).alias("value"))), lambda x: span(x["at"], x["value"]))

    def many(cut: Column) -> Column:
        ends = arrays.running(F.transform(cut, lambda x: F.length(x)))
        spans = F.filter(F.zip_with(cut, ends, lambda x, e: F.struct((e - F.length(x)).alias("at"), x.alias("value"))), lambda _, i: reduce(lambda a, b: a | b, [i % step == k for k in taken]))
        spans = F.filter(spans, lambda x: keep(x["value"])) if keep else spans
        return F.transform(spans, lambda x: span(x["at"], x["value"]))

    none = F.array().cast(SPAN)

    def spans(cut: Column) -> Column:
        n = F.size(cut)  # rules with signs mostly match once; each way is part of the plan that all tasks read, so none has all three
        return F.when(n == 1, none).when(*((n == step + 1, one(cut)) if signs else (n <= PIECES, few(cut)))).otherwise(many(cut))

    found = arrays.bind(F.split(told, MARK, -1), spans)
    if not signs:
        return found
    return F.when(read["shape"].isNull() | reduce(lambda a, b: a | b, [read["shape"].contains(x) for x in signs]), found).otherwise(none)


def _packed(candidates: Column) -> Column:
    """Of candidates in order of priority, those that overlap none taken before; by start."""

    def free(taken: Column, x: Column) -> Column:
        clash = F.exists(taken, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))
        return F.when(clash, taken).otherwise(F.array_append(taken, x))

    return F.array_sort(F.aggregate(candidates, F.array().cast(SPAN), free))


def _packed_apart(candidates: Column) -> Column:
    """The same for many candidates: where none reaches over a place in the text, what lies before and after is packed apart."""
    spans = F.transform(candidates, lambda x, i: F.struct(x["start"].alias("start"), i.alias("rank"), x.alias("span")))

    def clusters(by_start: Column) -> Column:
        far = arrays.running(F.transform(by_start, lambda x: x["span"]["end"]), lambda a, b: F.greatest(a, b))
        first = lambda reach: F.filter(F.transform(by_start, lambda x, i: F.when(x["start"] >= F.coalesce(F.get(reach, i - 1), F.lit(0)), i)), lambda i: i.isNotNull())

        def cut(begins: Column) -> Column:
            size = lambda k: F.coalesce(F.get(begins, k + 1), F.size(by_start)) - F.get(begins, k)
            of = lambda b, k: F.transform(F.array_sort(F.transform(F.slice(by_start, b + 1, size(k)), lambda x: F.struct(x["rank"], x["span"]))), lambda x: x["span"])
            return F.flatten(F.transform(begins, lambda b, k: F.when(size(k) == 1, F.array(F.get(by_start, b)["span"])).otherwise(_packed(of(b, k)))))

        return arrays.bind(arrays.bind(far, first), cut)

    return arrays.bind(F.array_sort(spans), clusters)


def rules(read: Column) -> list[Column]:
    """Spans by each pattern and each context, in order of priority; gazetteers come after them."""
    found = [matches(read, pattern, kind, signs=L.SIGNS[kind]) for kind, pattern in L.PATTERNS]
    for (pattern, groups), signs in zip(L.CONTEXTS, L.CONTEXT_SIGNS):
        found.append(matches(read, pattern, "name", groups, pattern.count("(") - pattern.count("(?:"), lambda x: ~x.isin(L.STOP_WORDS), signs))
    return found


#: Words that a gazetteer may hold: a capital and small letters.
TOKEN = r"\b[A-Z][a-z]+\b"


def _detect(text: Column, kind: str | Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans by all rules and, of the capitalised words that are kept, those that overlap none of these; by start."""

    def found(read: Column) -> Column:
        return arrays.bind(F.concat(*rules(read), matches(read, TOKEN, kind, keep=keep)), lambda c: F.when(F.size(c) > FEW, _packed_apart(c)).when(F.size(c) > 1, _packed(c)).otherwise(c))

    return _whole(text, arrays.bind(_read(text), found))


def detect(text: Column) -> Column:
    """Spans of identifiers in a text, by start; of two that overlap, the one found by the earlier rule. Null text: none."""
    names = {*L.SURNAMES_KNOWN, *L.SURNAME_DECOYS, *L.FIRST_KNOWN, *L.FIRST_DECOYS} - set(L.STOP_WORDS)
    kind = lambda x: F.when(x.isin(L.GAZETTEER_CITIES), "address").otherwise("name")
    return _detect(text, kind, lambda x: x.isin(sorted({*names, *L.GAZETTEER_CITIES}))).cast(SPAN)


def finder() -> Callable[[pa.Array], tuple[list[int], list[tuple[int, int, int]]]]:
    """A function of a batch of ASCII texts as binary: how many spans ``detect`` finds in each, and these as ``(start, end, number of the type in KINDS)``, by start.

    Made here so that workers need nothing of this package. Arrow tells for the whole batch in which texts a rule matches at all, and only
    these are searched. Taken places are marked, so the time grows with the texts and their matches.
    """
    name, address, stop = KINDS.index("name"), KINDS.index("address"), frozenset(w.encode() for w in L.STOP_WORDS)
    known = {w.encode(): name for w in {*L.SURNAMES_KNOWN, *L.SURNAME_DECOYS, *L.FIRST_KNOWN, *L.FIRST_DECOYS} - set(L.STOP_WORDS)} | {w.encode(): address for w in L.GAZETTEER_CITIES}
    listed = rf"\b(?:{'|'.join(sorted(w.decode() for w in known))})\b"
    steps = [(p, p, (0,), KINDS.index(kind), frozenset(), None) for kind, p in L.PATTERNS] + [(p, p, groups, name, stop, None) for p, groups in L.CONTEXTS] + [(listed, TOKEN, (0,), name, frozenset(), known)]
    steps = [(seen, re.compile(p.encode()), *rest) for seen, p, *rest in steps]

    def find(batch: pa.Array) -> tuple[list[int], list[tuple[int, int, int]]]:
        texts = batch.to_pylist()
        taken: list[bytearray | None] = [None] * len(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for seen, pattern, groups, kind, never, words in steps:
            for i in np.flatnonzero(pc.match_substring_regex(batch, seen).to_numpy(zero_copy_only=False)).tolist():
                marks, own = taken[i], found[i]
                if marks is None:
                    marks = taken[i] = bytearray(len(texts[i]))
                for m in pattern.finditer(texts[i]):
                    if words:
                        kind = words.get(m[0])
                        if kind is None:
                            continue
                    for g in groups:
                        start, end = m.span(g)
                        if marks.find(1, start, end) < 0 and (not never or m[g] not in never):
                            marks[start:end] = b"\1" * (end - start)
                            own.append((start, end, kind))
        for own in found:
            own.sort()
        return [len(own) for own in found], [x for own in found for x in own]

    return find


def places(notes: DataFrame, key: str = "note_id", text: str = "text") -> DataFrame:
    """``(key, spans)``: what ``detect`` finds, by start and without values; a row for each text.

    Texts of ASCII, where bytes are characters, are read in batches by ``finder``: ``detect`` evaluates some thousand expressions for a short
    text, which took most of its time. Other texts come back unread, and only for them ``detect`` is evaluated; so do those with a vertical
    tab, which Arrow's patterns don't count as white space.
    """
    find, kinds, kind = finder(), KINDS, StructType([notes.schema[key]]).simpleString()[7:-1].replace(":", " ", 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            odd = pc.fill_null(pc.match_substring_regex(texts, r"[^\x00-\x0a\x0c-\x7f]"), False)
            n, flat = find(pc.if_else(odd, b"", pc.fill_null(texts, b"")))
            start, end, of = np.array(flat, np.int32).reshape(-1, 3).T
            spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end), pa.array(kinds).take(pa.array(of))], ["start", "end", "type"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pc.if_else(odd, texts, None)], names=[key, "spans", "_rest"])

    told = notes.select(key, F.col(text).cast("binary")).mapInArrow(read, f"{kind}, spans {PLACES}, _rest binary")
    other = F.transform(detect(F.col("_rest").cast("string")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))
    return told.select(key, F.when(F.col("_rest").isNotNull(), other).otherwise(F.col("spans")).alias("spans"))


def gazetteer(names: DataFrame | None = None, cities: DataFrame | None = None, word: str = "word") -> DataFrame:
    """``(word, type)`` for ``detect_rows``, from tables of names and of cities; stop words, short names and what isn't a capitalised word are left out."""
    told = []
    if cities is not None:
        told.append(cities.select(F.col(word).alias("word"), F.lit("address").alias("type")))
    if names is not None:
        known = names.select(F.col(word).alias("word"), F.lit("name").alias("type"))
        told.append(known.where((F.length("word") > 2) & ~F.col("word").isin(L.STOP_WORDS)))
    return reduce(DataFrame.union, told).where(F.col("word").rlike("^[A-Z][a-z]+$")).distinct()


def own_gazetteer(spark: SparkSession) -> DataFrame:
    """The lists that ``detect`` knows."""
    names = {*L.SURNAMES_KNOWN, *L.SURNAME_DECOYS, *L.FIRST_KNOWN, *L.FIRST_DECOYS}
    listed = [spark.createDataFrame([(w,) for w in sorted(x)], "word string") for x in (names, set(L.GAZETTEER_CITIES))]
    return gazetteer(*listed)


def detect_rows(notes: DataFrame, words: DataFrame | None = None, key: str = "note_id", text: str = "text") -> DataFrame:
    """``(key, start, end, type, value)``: what ``detect`` finds, for any gazetteer, a table ``words`` ``(word, type)``.

    Gazetteers come after all rules, and capitalised words don't overlap each other. So a text's rules are settled with its words where it is
    read, and only words that no rule's span overlaps meet the table in a join, which is broadcast only if the plan says it is small.
    Of texts of over LONG characters no array of all candidates is made: each rule makes rows of its own, those that nothing overlaps
    are taken as they are, and those of a cluster are packed by priority. Rows of one key are one text, so keys must differ; a null text has no spans.
    """
    words = own_gazetteer(notes.sparkSession) if words is None else words
    best = F.min(F.struct((F.col("type") != "address").alias("later"), "type"))  # of a word that is listed twice
    known = checked(words.groupBy(F.col("word").alias("_word")).agg(best["type"].alias("_type")))
    told = [key, "start", "end", F.coalesce("_type", "type").alias("type"), "value"]

    def met(rows: DataFrame) -> DataFrame:
        """Rows without the tokens that the table lacks; what is no token has a word of its own kind, which no table holds, and is dealt by it."""
        word = F.when(F.col("type") == "token", F.col("value")).otherwise(F.concat(F.lit(" "), "value"))
        return rows.withColumn("_at", word).join(known, F.col("_at") == F.col("_word"), "left").where("type != 'token' or _word is not null")

    length = F.length(F.coalesce(text, F.lit("")))
    short = met(spans_of(notes.where(length <= LONG).select(key, _detect(F.col(text), "token").alias("_spans")), key, "_spans")).select(*told)

    body = F.col("_body")
    found = [*rules(F.col("_read")), matches(F.col("_read"), TOKEN, "token")]
    cases = F.when(F.col("rule") == 0, found[0])
    for k, x in enumerate(found[1:], 1):
        cases = cases.when(F.col("rule") == k, x)
    long = notes.where(length > LONG).select(key, F.col(text).alias("_body")).withColumn("_read", _read(body))
    dealt = long.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(found) - 1))).alias("rule"))
    rows = met(dealt.select(key, "rule", F.inline_outer(_whole(body, cases))).where("type is not null")).select(*told, "rule")
    placed = clusters(rows, key, F.col("start"), F.col("end"))
    span = F.struct("start", "end", "type", "value")
    packed = placed.groupBy(key, "cluster").agg(F.array_sort(F.collect_list(F.struct("rule", "start", span.alias("span")))).alias("c"))
    packed = packed.select(key, F.inline(_packed(F.transform("c", lambda x: x["span"].cast(SPAN[6:-1])))))
    return short.union(packed)


def with_spans(notes: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """notes with their detected spans; works on a stream as well, since every row is on its own."""
    return notes.withColumn(name, detect(F.col(text)))


def spans_of(notes: DataFrame, key: str = "note_id", spans: str = "spans") -> DataFrame:
    """``(key, start, end, type, value)``, a row for each span."""
    # an outer generator: for others Spark infers filters on the spans, and would detect again for each of them
    return notes.select(key, F.inline_outer(spans)).where("type is not null")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df itself, or dealt out by a key where files so small that they take one read would leave cores without work; larger texts are never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > DEALT or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
