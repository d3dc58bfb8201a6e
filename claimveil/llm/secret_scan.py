"""Secrets in texts: named patterns, and strings whose characters are too evenly spread to be words; DataFrame operations alone.

Where a pattern matches comes from splitting the text by it. A candidate string's entropy is taken over a window that slides
one character at a time: the counts of the character that enters and of the one that leaves change by one, and so does their
share of the sum. Counts are kept five bits each in a few long integers, so a step costs the same however long the string. Limits differ by class of characters,
the window's or the whole string's, whichever is lower, so a key or path before a value doesn't raise the value's limit; an
allow-list drops what looks random but isn't secret. Strings too short for the usual window have a shorter one, which must
also mix letters of both cases. All offsets are code points; everything happens within a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimveil.functions.arrays import bind, chunks, matches, part, running

from .common import table

#: Base patterns in the order in which kinds are listed; the group to measure and its least length.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: Quick patterns that every text with a match of the kind has; hex: the same matches, as runs can't be longer or shorter.
HAS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BODY = "[A-Za-z0-9+/_=-]"
#: Characters of a window, and of one in strings shorter than that.
WINDOW, SHORT = 20, 16
CANDIDATE = rf"(?<!{BODY})(?=[a-z+/_=-]*[A-Z0-9]){BODY}{{{SHORT},}}"
#: Least entropy in bits a character by class: hexadecimal of one case; letters and digits; with signs as well.
LIMITS = (("^(?:[0-9a-f]+|[0-9A-F]+)$", 2.8), ("^[A-Za-z0-9]+$", 3.6), ("", 3.8))
#: Not secrets: UUIDs, numbers and dates, samples from manuals, strings that count up, and those without two letters and two digits.
ALLOWED = (
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "^[0-9+/_=-]*$", "(?i)example|sample|placeholder|changeme|dummy",
    "(?i)0123456789|1234567890|abcdefghij|qwertyuiop", "^[^0-9]*[0-9]?[^0-9]*$", "^[^A-Za-z]*[A-Za-z]?[^A-Za-z]*$",
)
#: Of the allow-list, what only speaks of the windows that hold such a word, and what not of windows of letters alone.
SAMPLES, PLAIN = ALLOWED[2], ALLOWED[4:]
#: Windows of letters alone: least entropy, and least number of letters of either case.
LETTERS, CASES = 3.8, 6
#: Short windows but hexadecimal ones: least entropy, and least number of letters of either case beside two digits, and beside fewer.
MIXED, BESIDE, ALONE = 3.4, 3, 5
#: A string with a run like this has no short windows but hexadecimal ones: it is made of words.
WORDLIKE = "[a-z]{5}"
#: Takes the place of each character of a sample word; no candidate holds it.
MARK = "~"
#: What a character adds to its window's tally: a digit, a-f, A-F, a sign, g-z, G-Z or a mark; sums of twenty stay apart.
DIGIT, LOWER, UPPER, SIGN, SMALL, CAPITAL, MARKED = (100**k for k in range(7))
TALLY = [DIGIT if c in "0123456789" else LOWER if c in "abcdef" else UPPER if c in "ABCDEF" else SMALL if c.islower() else CAPITAL if c.isupper() else SIGN for c in ALPHABET] + [MARKED]
#: Counts of at most WINDOW in a long integer, their bits, and how many long integers there are.
EACH, BITS = 12, 5
HOLDERS = -(-(len(ALPHABET) + 1) // EACH)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _found(text: Column, pattern: str, kind: str, group: int, least: int) -> Column:
    """Spans of a pattern's matches, leftmost and without overlaps, whose group has the least length."""
    rank, part = [*KINDS, "entropy"].index(kind), f"g{group}" if group else "match"
    long = F.filter(matches(text, pattern, (group,) if group else ()), lambda x: F.length(x[part]) >= least)
    return F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)


def _random_part(word: Column, window: int) -> Column:
    """First and end place of the windows in a word whose entropy reaches the limit of their class, or null.

    A window of hexadecimal digits in a word of other characters needs two letters and two digits, one in a word without both
    letters of both cases and nothing else. Windows that hold a sample word don't count, unlike what stands beside it. Short
    windows hold letters of both cases, and no signs.
    """
    plogp = [c * math.log2(c) if c else 0.0 for c in range(window + 3)]
    #: What the sum of c log c gains when the n-th of a character enters, and loses when the n-th leaves.
    gains, losses = F.array(*[F.lit(plogp[c + 1] - plogp[c]) for c in range(window + 2)]), F.array(F.lit(0.0), *[F.lit(plogp[c] - plogp[c - 1]) for c in range(1, window + 2)])
    limit = F.lit(LIMITS[-1][1])
    for pattern, bits in reversed(LIMITS[:-1]):
        limit = F.when(word.rlike(pattern), bits).otherwise(limit)
    tally = F.array(*[F.lit(x).cast("long") for x in (0, *TALLY)])
    marked = word
    for sample in SAMPLES.removeprefix("(?i)").split("|"):
        marked = F.regexp_replace(marked, f"(?i){sample}", MARK * len(sample))
    plain = F.lit(False)
    for pattern in (WORDLIKE,) if window == SHORT else PLAIN:
        plain = plain | word.rlike(pattern)
    #: By place in the alphabet (0: none): the long integer that holds the count, the bits before it, and one in its place.
    where = [(-1, 0, 0), *(((p // EACH), p % EACH * BITS, 1 << p % EACH * BITS) for p in range(len(ALPHABET) + 1))]
    holder, shift, one = F.array(*[F.lit(h) for h, _, _ in where]), F.array(*[F.lit(x) for _, x, _ in where]), F.array(*[F.lit(u).cast("long") for _, _, u in where])

    def moves(places: Column) -> Column:
        """For each character that enters the window and the one that leaves it, where their counts are."""
        pairs = F.transform(places, lambda p, i: F.struct((p + 1).alias("into"), (F.coalesce(F.get(places, i - window), F.lit(0)) + 1).alias("out")))
        return F.transform(pairs, lambda x: F.struct(
            *[F.element_at(table_, x[side]).alias(f"{side}_{name}") for side in ("into", "out") for name, table_ in (("at", holder), ("shift", shift), ("one", one))],
            (F.element_at(tally, x["into"]) - F.element_at(tally, x["out"])).alias("tally"), (x["into"] == x["out"]).cast("int").alias("same"),
        ))

    def high(s: Column) -> Column:
        """Whether the window that ends here reaches the limit of its class."""
        of = lambda unit: F.call_function("div", s["tally"], F.lit(unit)) % 100 if unit > 1 else s["tally"] % 100
        digits, low, up, sign = of(DIGIT), of(LOWER), of(UPPER), of(SIGN) > 0
        hexadecimal = digits.between(2, window - 2) & ((digits + low == window) | (digits + up == window))
        either = F.least(low + of(SMALL), up + of(CAPITAL))
        never = F.lit(math.log2(WINDOW) + 1)
        if window == SHORT:
            told = F.when(~s["plain"] & ~sign & (either >= F.when(digits >= 2, BESIDE).otherwise(ALONE)), MIXED).otherwise(never)
        else:
            letters = (digits == 0) & ~sign & (either >= CASES)
            usual = F.when(sign, s["limit"]).otherwise(F.least(s["limit"], F.lit(LIMITS[1][1])))
            told = F.when(s["plain"], F.when(letters, LETTERS).otherwise(never)).otherwise(usual)
        least = F.when(hexadecimal, LIMITS[0][1]).when(of(MARKED) > 0, never).otherwise(told)
        return (s["n"] >= window) & (math.log2(window) + 1e-9 - s["sum"] / window >= least)

    def judged(s: Column) -> list[Column]:
        first = F.when(s["first"].isNotNull(), s["first"]).when(high(s), s["n"] - window)
        return [first.alias("first"), F.when(high(s), s["n"]).otherwise(s["end"]).alias("end")]

    def step(s: Column, x: Column) -> Column:
        """The window so far is judged, then moves on."""

        def count(side: str) -> Column:
            held = s[f"c{HOLDERS - 1}"]
            for k in reversed(range(HOLDERS - 1)):
                held = F.when(x[f"{side}_at"] == k, s[f"c{k}"]).otherwise(held)
            return F.call_function("shiftright", held, x[f"{side}_shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

        # the one that enters counts already when another leaves
        gone = F.when(x["out_at"] >= 0, F.element_at(losses, count("out") + x["same"] + 1)).otherwise(0.0)
        total = s["sum"] + F.element_at(gains, count("into") + 1) - gone
        held = [s[f"c{k}"] + F.when(x["into_at"] == k, x["into_one"]).otherwise(0) - F.when(x["out_at"] == k, x["out_one"]).otherwise(0) for k in range(HOLDERS)]
        return F.struct(
            *[c.alias(f"c{k}") for k, c in enumerate(held)], total.alias("sum"), (s["n"] + 1).alias("n"), *judged(s),
            s["limit"].alias("limit"), (s["tally"] + x["tally"]).alias("tally"), s["plain"].alias("plain"),
        )

    start = F.struct(
        *[F.lit(0).cast("long").alias(f"c{k}") for k in range(HOLDERS)], F.lit(0.0).alias("sum"), F.lit(0).alias("n"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("end"), limit.alias("limit"), F.lit(0).cast("long").alias("tally"), plain.alias("plain"),
    )
    places = F.transform(F.regexp_extract_all(marked, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET + MARK), c))
    found = F.aggregate(bind(places, moves), start, step, lambda s: F.struct(*judged(s)))
    allowed = F.lit(False)
    for pattern in (x for x in ALLOWED if x != SAMPLES and x not in PLAIN):
        allowed = allowed | word.rlike(pattern)
    return F.when(~allowed, found)


def _entropy(text: Column) -> Column:
    """Spans of candidate strings' random parts."""
    def random(word: Column) -> Column:
        return F.when(F.length(word) >= WINDOW, _random_part(word, WINDOW)).otherwise(_random_part(word, SHORT))

    parts = F.transform(matches(text, CANDIDATE), lambda w: F.struct(w["start"].alias("start"), random(w["match"]).alias("p")))
    found = F.filter(parts, lambda x: x["p"]["first"].isNotNull())
    kind = [F.lit(len(KINDS)).alias("rank"), F.lit("entropy").alias("kind")]
    return F.transform(found, lambda x: F.struct((x["start"] + x["p"]["first"]).alias("start"), kind[0], (x["start"] + x["p"]["end"]).alias("end"), kind[1])).cast(SPAN)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``_base`` and ``_spans``: arrays of (start, rank, end, kind) in order, base patterns' and all.

    Spans found by entropy are added unless they lie inside a base span. Null and empty texts have none.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    by_kind = [
        F.when(whole.rlike(HAS[kind]), _found(whole, pattern if kind != "hex" else "[0-9a-f]{16,}", kind, group, least)).otherwise(none)
        for kind, (pattern, group, least) in KINDS.items()
    ]
    found = docs.withColumn("_base", F.array_sort(F.concat(*by_kind)))
    found = found.withColumn("_random", F.when(whole.rlike(CANDIDATE), _entropy(whole)).otherwise(none))
    # base spans that begin no later, up to the one whose end lies farthest, tell whether one holds a span
    def outside(base: Column) -> Column:
        reach = running(F.transform(base, lambda b: b["end"]), lambda a, b: F.greatest(a, b))
        told = F.zip_with(base, reach, lambda b, far: F.struct(b["start"].alias("start"), F.lit(1).alias("new"), far.alias("far"), F.lit(None).cast("struct<start:int,rank:int,end:int,kind:string>").alias("span")))
        asked = F.transform("_random", lambda r: F.struct(r["start"].alias("start"), F.lit(2).alias("new"), F.lit(0).alias("far"), r.alias("span")))
        both = F.array_sort(F.concat(told, asked))
        seen = running(F.transform(both, lambda x: x["far"]), lambda a, b: F.greatest(a, b))
        kept = F.filter(F.zip_with(both, seen, lambda x, far: F.when(far < x["span"]["end"], x["span"])), lambda x: x.isNotNull())
        return F.array_sort(F.concat(base, kept))

    return found.withColumn("_spans", F.when(F.size("_random") > 0, bind(F.col("_base"), outside)).otherwise(F.col("_base"))).drop("_random")


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of docs.

    Null and empty texts have no spans; repeated rows, ids and null ids stay as they are; an empty table gives none. Very long
    texts are read whole, in time that grows little faster than their length. Other columns are not read.
    """
    found = scan(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))

    def number(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of their texts replaced by a mark; overlapping spans become one. Null texts stay null.

    All columns stay as they are, whatever their names; repeated rows stay; an empty table gives none.
    """

    def cleaned(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def joined(far: Column) -> Column:
            before = lambda i: F.coalesce(F.get(far, i - 1), F.lit(0))
            fresh = F.filter(F.transform(spans, lambda s, i: F.struct(before(i).alias("at"), s["start"].alias("start"))), lambda x: x["start"] >= x["at"])
            pieces = bind(chunks(F.col("text")), lambda c: F.concat(F.transform(fresh, lambda x: F.concat(part(c, x["at"], x["start"]), F.lit(mark))), F.array(part(c, F.element_at(far, -1), F.length("text")))))
            return F.array_join(pieces, "")

        return bind(reach, joined)

    found = scan(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(text).alias("text")))
    new = F.when(F.size("_spans") > 0, bind(F.col("_spans"), cleaned)).otherwise(F.col("text"))
    return found.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _sql_matches(kind: str, rank: int, pattern: str, group: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(generate_series(1, len(m))) AS i, unnest(g[1:len(m)]) AS gap, unnest(m) AS w, unnest(p) AS part FROM (
      SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS p FROM d) x"""


_ALL = [*((k, r, p, g) for r, (k, (p, g, _)) in enumerate(KINDS.items())), ("entropy", 3, f"{BODY}+", 0)]
_LEAST = " ".join(f"WHEN '{k}' THEN {n}" for k, (_, _, n) in KINDS.items())
_ALLOW = " OR ".join(f"regexp_matches(w, '{p}')" for p in ALLOWED if p != SAMPLES and p not in PLAIN)
_PLAIN = " OR ".join(f"regexp_matches(w, '{p}')" for p in PLAIN)
_MARKED = "w"
for _x in SAMPLES.removeprefix("(?i)").split("|"):
    _MARKED = f"regexp_replace({_MARKED}, '(?i){_x}', '{MARK * len(_x)}', 'g')"
_NUMBER = lambda of: f"length(regexp_replace(v, '[^{of}]', '', 'g'))"
_LETTERS = f"regexp_full_match(v, '[A-Za-z]+') AND {_NUMBER('a-z')} >= {CASES} AND {_NUMBER('A-Z')} >= {CASES}"
_ONE_CASE = "regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') AND length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 2 AND wide - 2"
_EITHER = f"least({_NUMBER('a-z')}, {_NUMBER('A-Z')})"
_MIXED = f"regexp_full_match(v, '[A-Za-z0-9]+') AND NOT regexp_matches(w, '{WORDLIKE}') AND {_EITHER} >= CASE WHEN {_NUMBER('0-9')} >= 2 THEN {BESIDE} ELSE {ALONE} END"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_matches(*x) for x in _ALL)}),
placed AS (
  SELECT doc_id, kind, rank, w, length(part) AS n, sum(length(gap)) OVER o + sum(length(w)) OVER o - length(w) AS s
  FROM found WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)
), base AS (
  SELECT doc_id, kind, rank, s, s + length(w) AS e FROM placed WHERE kind <> 'entropy' AND n >= CASE kind {_LEAST} END
), words AS (
  SELECT doc_id, s, w, CASE WHEN length(w) >= {WINDOW} THEN {WINDOW} ELSE {SHORT} END AS wide, CASE WHEN regexp_matches(w, '{LIMITS[0][0]}') THEN {LIMITS[0][1]} WHEN regexp_matches(w, '{LIMITS[1][0]}') THEN {LIMITS[1][1]} ELSE {LIMITS[2][1]} END AS bits
  FROM placed WHERE kind = 'entropy' AND length(w) >= {SHORT} AND regexp_matches(w, '[A-Z0-9]') AND NOT ({_ALLOW})
), windows AS (
  SELECT doc_id, s, w, bits, wide, k, substr({_MARKED}, k + 1, wide) AS v FROM (SELECT *, unnest(generate_series(0, length(w) - wide)) AS k FROM words) x
), classed AS (
  SELECT doc_id, s, wide, k, v, CASE WHEN {_ONE_CASE} THEN {LIMITS[0][1]} WHEN contains(v, '{MARK}') THEN log2({WINDOW}) + 1
         WHEN wide = {SHORT} THEN CASE WHEN {_MIXED} THEN {MIXED} ELSE log2({WINDOW}) + 1 END
         WHEN {_PLAIN} THEN CASE WHEN {_LETTERS} THEN {LETTERS} ELSE log2({WINDOW}) + 1 END
         WHEN regexp_matches(v, '[^A-Za-z0-9]') THEN bits ELSE least(bits, {LIMITS[1][1]}) END AS bits FROM windows
), letters AS (
  SELECT doc_id, s, bits, wide, k, c, count(*) AS n FROM (SELECT *, unnest(string_split(v, '')) AS c FROM classed) x GROUP BY ALL
), high AS (
  SELECT doc_id, s, wide, k FROM letters GROUP BY doc_id, s, wide, k, bits HAVING -sum(n / wide * log2(n / wide)) >= bits - 1e-9
), random AS (
  SELECT doc_id, 'entropy' AS kind, 3 AS rank, s + min(k) AS s, s + max(k) + any_value(wide) AS e FROM high GROUP BY doc_id, high.s
), every AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM random r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND r.e <= b.e)
), told AS (
  SELECT doc_id, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) AS spans,
         string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) FILTER (kind <> 'entropy') AS base,
         {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}
  FROM every GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told ON told.doc_id = d.doc_id
"""
