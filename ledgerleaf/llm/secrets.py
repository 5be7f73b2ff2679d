"""Operator 1: secret scans, with DataFrame functions only.

Base rules are patterns (``assign``, ``access``, ``hex``). The method adds spans:
candidate strings are hexadecimal runs and runs of key characters, and a window slides
over each. The window's counts change by one character that leaves and one that enters,
and with them the sum of ``c * log2(c)``, so its Shannon entropy
``log2(window) - sum / window`` is had in constant work a step. Each character class has
its own threshold: hexadecimal, grouped hexadecimal, lower case with digits, upper case
with digits, and mixed. A candidate whose highest entropy exceeds its class's threshold
is reported whole, unless the allow list suppresses it: of the parts between separators
numbers, words, camel-case names and parts with placeholders don't count, and ``LEFT``
characters at least must be left. Base spans are never suppressed, and a candidate that
overlaps one is not reported twice.

Positions are code points. They come from the lengths of the pieces between matches,
so nothing leaves the JVM and nothing is shuffled. Sums over many matches are taken in
blocks of ``BLOCK``, and spans meet others in one fold over both in order, so long texts
with very many matches stay cheap. Null texts are
empty; repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base rules: kind -> pattern; an assignment's value has 6 characters at least.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

_KEY = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Candidates: name -> (pattern, alphabet, window).
CANDIDATES = {"entropy_hex": (r"[0-9A-Fa-f]{32,}", "0123456789abcdefABCDEF", 32), "run": (r"[A-Za-z0-9+/_-]{24,}={0,2}", _KEY, 24)}
#: Kinds of candidates -> (what a candidate of the kind looks like, threshold in bits); of the kinds of runs the first that fits.
CLASSES = {
    "entropy_hex": (r"^", 3.05),
    "entropy_grouped": (r"^(?:[0-9a-f-]+|[0-9A-F-]+)$", 3.3),
    "entropy_lower": (r"^[a-z0-9_-]+$", 3.6),
    "entropy_upper": (r"^[A-Z0-9_-]+={0,2}$", 3.3),
    "entropy_base64": (r"^", 4.05),
}
#: Allow list: parts of candidates that don't count, and how many characters of others there must be.
SEPARATORS = r"[+/_=-]+"
ALLOWED = r"^(?:[a-z]+|[A-Z]+)?(?:[A-Z][a-z]+|[AI])*[0-9]{0,4}$|^[0-9]+$|(?i:example|sample|placeholder|changeme|dummy|redacted|0123456789|abcdefgh|deadbeef)"
LEFT = 16
KINDS = [*BASE, *CLASSES]
_RUNS = list(CLASSES)[1:]
#: Matches that are added up one after the other.
BLOCK = 64
MARK = "[SECRET]"

_SPANS = "array<struct<start: int, rank: int, finish: int, hit: string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def max_window_entropy(candidate: Column, alphabet: str, window: int) -> Column:
    """The highest Shannon entropy, in bits, over all windows of ``candidate``; of the whole of a shorter one.

    The state holds the counts as one character per member of the alphabet, and the
    sum of c * log2(c). A step replaces two of these characters; characters outside
    of the alphabet count as none.
    """
    plog = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    size = F.least(F.lit(window), F.length(candidate)).cast("double")

    def moved(state: Column, char: Column, by: int) -> Column:
        def at_place(at: Column) -> Column:
            def changed(was: Column) -> Column:
                return F.struct(F.overlay(state["counts"], F.char(was + 32 + by), at, F.lit(1)).alias("counts"), (state["total"] + F.get(plog, was + by) - F.get(plog, was)).alias("total"))

            return F.when(at > 0, _let(F.ascii(F.substr(state["counts"], at, F.lit(1))) - 32, changed)).otherwise(F.struct(state["counts"].alias("counts"), state["total"].alias("total")))

        return _let(F.instr(F.lit(alphabet), char), at_place)

    def over(chars: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            def left(entered: Column) -> Column:
                return F.when(i > window, moved(entered, F.get(chars, i - window - 1), -1)).otherwise(entered)

            def done(now: Column) -> Column:
                full = i >= F.least(F.lit(window), F.size(chars))
                return F.struct(now["counts"].alias("counts"), now["total"].alias("total"), F.when(full, F.least(state["least"], now["total"])).otherwise(state["least"]).alias("least"))

            return _let(_let(moved(state, F.get(chars, i - 1), 1), left), done)

        start = F.struct(F.lit(" " * len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e300).alias("least"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda s: F.log2(size) - s["least"] / size)

    return _let(F.split(candidate, ""), over)


def _blocks(values: Column) -> Column:
    """``values`` in arrays of ``BLOCK``."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK)))


def _by_blocks(values: Column, measure: Callable[[Column], Column], combine: Callable[[Column, Column], Column], use: Callable[[Column, Column, Column], Column]) -> Column:
    """``use(block, start, end)`` for each block: what ``combine`` makes of its predecessors' measures from 0 on, and with its own."""

    def with_blocks(blocks: Column) -> Column:
        def with_sums(sums: Column) -> Column:
            upto = lambda b: F.aggregate(F.slice(sums, F.lit(1), b), F.lit(0), combine)
            return F.transform(blocks, lambda block, b: _let(F.struct(upto(b).alias("a"), upto(b + 1).alias("b")), lambda at: use(block, at["a"], at["b"])))

        return _let(F.transform(blocks, measure), with_sums)

    return _let(_blocks(values), with_blocks)


def _spans(text: Column, rank: int, pattern: str) -> Column:
    """All matches, in code points from 0; ``rank`` is the kind's place in KINDS."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda piece, hit: F.struct(F.length(piece).alias("before"), F.length(hit).alias("size"), hit.alias("hit")))
    empty = F.array().cast(_SPANS)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["before"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("finish"), x["hit"].alias("hit"))
        return F.struct((start + x["size"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def placed(block: Column, start: Column, _: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), empty.alias("spans")), step, lambda s: s["spans"])

    size = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["before"] + x["size"])
    found = _let(F.filter(pairs, lambda x: x["hit"].isNotNull()), lambda hits: F.flatten(_by_blocks(hits, size, lambda n, x: n + x, placed)))
    return F.when(text.rlike(pattern), F.coalesce(found, empty)).otherwise(empty)


def _of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda x: x["rank"] == rank


#: Beyond all places.
_FAR = 1 << 30


def _clear(spans: Column, others: Column, key: Callable[[Column], Column], reach: Callable[[Column], Column], against: Callable[[Column], Column]) -> Column:
    """The spans that no other one before them, in order of ``key``, reaches: whose greatest ``reach`` so far isn't above ``against``.

    One fold over both in order, block by block.
    """
    marked = lambda own: lambda x: F.struct(key(x).alias("key"), F.lit(own).alias("own"), x.alias("span"))
    both = F.array_sort(F.concat(F.transform(others, marked(0)), F.transform(spans, marked(1))))
    empty = F.array().cast(_SPANS)

    def step(state: Column, x: Column) -> Column:
        other = x["own"] == 0
        kept = ~other & (state["at"] <= against(x["span"]))
        return F.struct(F.when(other, F.greatest(state["at"], reach(x["span"]))).otherwise(state["at"]).alias("at"), F.when(kept, F.concat(state["out"], F.array(x["span"]))).otherwise(state["out"]).alias("out"))

    def clear(block: Column, at: Column, _: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda s: s["out"])

    furthest = lambda block: F.aggregate(block, F.lit(0), lambda n, x: F.when(x["own"] == 0, F.greatest(n, reach(x["span"]))).otherwise(n))
    return _let(both, lambda sorted_: F.flatten(_by_blocks(sorted_, furthest, lambda n, x: F.greatest(n, x), clear)))


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: none that begins no later and ends behind their start, and none that begins later and before their end."""
    before = _clear(spans, others, lambda x: x["start"], lambda x: x["finish"], lambda x: x["start"])
    both = _let(before, lambda left: _clear(left, others, lambda x: _FAR - x["start"], lambda x: _FAR - x["start"], lambda x: _FAR - x["finish"]))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.coalesce(both, F.array().cast(_SPANS))).otherwise(spans)


def _counting(hit: Column) -> Column:
    """Characters of the parts that the allow list doesn't hold."""
    return F.aggregate(F.filter(F.split(hit, SEPARATORS), lambda part: ~part.rlike(ALLOWED)), F.lit(0), lambda n, part: n + F.length(part))


def _kind(hit: Column) -> Column:
    """Rank of the first kind of run that fits."""
    fits = F.lit(KINDS.index(_RUNS[-1]))
    for kind in reversed(_RUNS[:-1]):
        fits = F.when(hit.rlike(CLASSES[kind][0]), F.lit(KINDS.index(kind))).otherwise(fits)
    return fits


def _above(name: str) -> Callable[[Column], Column]:
    _, alphabet, window = CANDIDATES[name]
    thresholds = F.array(*(F.lit(CLASSES[k][1] if k in CLASSES else 99.0) for k in KINDS))
    return lambda x: (_counting(x["hit"]) >= LEFT) & (max_window_entropy(x["hit"], alphabet, window) > F.get(thresholds, x["rank"]))


def with_spans(docs: DataFrame) -> DataFrame:
    """(row, base, more): each row of ``docs`` as a struct, and arrays of (start, rank, finish, hit) from the base rules and from the method."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    base = {k: _spans(text, r, p) for r, (k, p) in enumerate(BASE.items())}
    base["assign"] = F.filter(base["assign"], lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= ASSIGN_VALUE)
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"))
    out = rows.withColumn("base", F.array_sort(F.concat(*base.values())))
    hexes = _let(_spans(text, KINDS.index("entropy_hex"), CANDIDATES["entropy_hex"][0]), lambda found: _apart(found, F.col("base")))
    out = out.withColumn("hexes", F.filter(hexes, _above("entropy_hex")))
    runs = _let(_spans(text, -1, CANDIDATES["run"][0]), lambda found: _apart(found, F.concat("base", "hexes")))
    runs = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), _kind(x["hit"]).alias("rank"), x["finish"].alias("finish"), x["hit"].alias("hit")))
    return out.select("row", "base", F.array_sort(F.concat("hexes", F.filter(runs, _above("run")))).alias("more"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["finish"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    found = with_spans(docs.select("doc_id", "text"))
    counts = (F.size(F.filter(F.col("base"), _of_rank(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE))
    return found.select("row.doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_entropy"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by MARK and ``n_chars``, where there is one, counted again.

    Secrets that overlap have one mark. Other columns stay, whatever their names.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))

    def pieces(block: Column, start: Column, end: Column) -> Column:
        """What stands before each span of the block, from the furthest end before it on, and marks."""

        def within(segment: Column) -> Column:
            def step(state: Column, x: Column) -> Column:
                new = F.array(F.substr(segment, state["at"] - start + 1, x["start"] - state["at"]), F.lit(MARK))
                return F.struct(F.greatest(state["at"], x["finish"]).alias("at"), F.when(x["start"] >= state["at"], F.concat(state["parts"], new)).otherwise(state["parts"]).alias("parts"))

            return F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<string>").alias("parts")), step, lambda s: F.array_join(s["parts"], ""))

        return _let(F.substr(text, start + 1, end - start), within)

    furthest = lambda block: F.aggregate(block, F.lit(0), lambda n, x: F.greatest(n, x["finish"]))
    cut = _let(F.array_sort(F.concat("base", "more")), lambda spans: F.concat(F.array_join(_by_blocks(spans, furthest, lambda n, x: F.greatest(n, x), pieces), ""), F.substr(text, furthest(spans) + 1)))
    found = F.size("base") + F.size("more") > 0
    out = with_spans(docs).select("row", F.when(found, cut).otherwise(F.col("row.text")).alias("clean"), found.alias("found"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("found"), F.length("clean").cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def _oracle() -> str:
    sql = lambda p: "'" + p.replace("'", "''") + "'"
    parts = [f"SELECT doc_id, n, '{k}' AS name, string_split_regex(text, {sql(p)}) AS pieces, regexp_extract_all(text, {sql(p)}) AS hits FROM d" for k, p in [*BASE.items(), *((k, c[0]) for k, c in CANDIDATES.items())]]
    kind = " ".join(f"WHEN regexp_matches(hit, {sql(CLASSES[k][0])}) THEN '{k}'" for k in _RUNS)
    rank = " ".join(f"WHEN '{k}' THEN {r}" for r, k in enumerate(KINDS))
    entropy = " ".join(f"WHEN name = '{k}' THEN (SELECT max(list_aggregate(string_split(substr(rtrim(hit, '='), CAST(i AS BIGINT), {w}), ''), 'entropy')) FROM range(1, greatest(length(rtrim(hit, '=')) - {w} + 1, 1) + 1) t(i))" for k, (_, _, w) in CANDIDATES.items())
    threshold = " ".join(f"WHEN '{k}' THEN {t}" for k, (_, t) in CLASSES.items())
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
h AS (SELECT doc_id, n, name, pieces, hits, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
x AS (
  SELECT doc_id, n, name, hits[i] AS hit,
         CAST(length(array_to_string(pieces[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS BIGINT) AS start
  FROM h),
s AS (SELECT *, start + length(hit) AS finish, CASE WHEN name <> 'run' THEN name {kind} END AS kind FROM x),
base AS (SELECT * FROM s WHERE name IN ('access', 'hex') OR name = 'assign' AND length(regexp_extract(hit, {sql(ASSIGN)}, 2)) >= {ASSIGN_VALUE}),
e AS (
  SELECT * FROM s
  WHERE name IN ('entropy_hex', 'run') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.n = s.n AND b.start < s.finish AND s.start < b.finish)
    AND coalesce(list_sum(list_transform(list_filter(string_split_regex(hit, {sql(SEPARATORS)}), lambda p: NOT regexp_matches(p, {sql(ALLOWED)})), lambda p: length(p))), 0) >= {LEFT}
    AND CASE {entropy} END > CASE kind {threshold} END),
more AS (
  SELECT * FROM e WHERE name = 'entropy_hex' OR NOT EXISTS (SELECT 1 FROM e b WHERE b.name = 'entropy_hex' AND b.n = e.n AND b.start < e.finish AND e.start < b.finish)),
a AS (SELECT *, CASE kind {rank} END AS rank, kind || ':' || start || ':' || finish AS span FROM (SELECT * FROM base UNION ALL SELECT * FROM more))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans, count(*) FILTER (WHERE rank >= {len(BASE)}) AS n_entropy
FROM d LEFT JOIN a ON a.n = d.n GROUP BY d.doc_id, d.n
"""


ORACLE_SQL = _oracle()
