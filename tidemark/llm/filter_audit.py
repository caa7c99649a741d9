"""Filter interaction audit: what each filter removes in every order, and its fair share.

A document fails a set of the five filters: one of 32 patterns.  Counts by pattern tabulate the
removals of all 32 coalitions (a coalition removes what fails any of its filters), and all else
is arithmetic on these tables: a step's removals are the difference of two coalitions, and the
Shapley values solve a least squares problem over the coalitions' removals with kernel weights
and one exact constraint, that the shares add up to what all filters remove.  Its normal
equations are solved in rationals.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialize, slices, small_batches

#: The filters by letter: too short, too repetitive, too many capitals, symbols, copy of a smaller id.
FILTERS = "ABCDE"
_A, _B, _C, _D, _E = (1 << k for k in range(5))
_CAPITALS, _SYMBOLS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"


def word_counts(text: bytes) -> tuple[int, int]:
    """Words between [\\x20\\x09-\\x0D] and distinct words; long texts are split a slice at a time."""
    n, seen = 0, set()
    for part in slices(text):
        words = part.split()
        n += len(words)
        seen.update(words)
    return n, len(seen)


def failures(text: bytes, characters: int) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    symbols = len(text) != len(text.translate(None, _SYMBOLS))
    return _A * (n < 100) | _B * (100 * distinct < 80 * n) | _C * (100 * capitals > 10 * characters) | _D * symbols


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits, digest of every row: what its own text fails, and the text's SHA-256."""
    names = ["doc_id", "part", "bits", "digest"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            text = b.column(2)
            bits, digests = [], []
            for t, n in zip(text.cast(pa.binary()), pc.utf8_length(text).to_pylist(), strict=True):
                t = t.as_py()
                bits.append(failures(t, n))
                digests.append(hashlib.sha256(t).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=names)

    kept = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(rows, "doc_id long, part string, bits int, digest binary")


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: documents by the set of filters that they fail; at most 32 rows a part.

    A row whose text a smaller doc_id has fails E.  Equal rows are counted together before any
    shuffle by id, the smallest id of a text is found by an aggregate, and only (text, id) pairs are
    joined, so no group of copies meets in a task.
    """
    rows = materialize(judged(docs).groupBy("doc_id", "part", "bits", "digest").agg(F.count("*").alias("n")), "judged")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    told = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").where("doc_id is not null")
    told = told.groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("bad"))
    whole = rows.join(first, ["digest", "doc_id"], "left").join(F.broadcast(told) if few(told) else told, "doc_id", "left")
    counted = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).cast("long")
    bits = F.col("bits").bitwiseOR(F.when(copy, _E).otherwise(0))
    table = whole.groupBy("part", bits.alias("bits")).agg(F.sum("n").cast("long").alias("n"), counted("good").alias("good"), counted("bad").alias("toxic"))
    table = materialize(table, "patterns")
    discard(rows)
    return table


def coalitions(by_pattern: list[int]) -> list[int]:
    """What each set of filters removes: documents whose pattern meets the set."""
    inside = list(by_pattern)  # becomes, for each set, the documents that fail nothing outside of it
    for k in range(len(by_pattern).bit_length() - 1):
        for s in range(len(inside)):
            if s >> k & 1:
                inside[s] += inside[s ^ 1 << k]
    full = len(inside) - 1
    return [inside[full] - inside[full ^ s] for s in range(len(inside))]


@lru_cache
def shapley_weights(m: int) -> tuple[tuple[Fraction, ...], ...]:
    """For each of m filters the weight of every coalition's removals in its Shapley value.

    The least squares problem: phi minimises the sum over coalitions S of w(S) (v(S) - phi(S))^2,
    with w(S) = (m - 1) / (C(m, s) s (m - s)), under phi(all) = v(all).  Its normal equations, with a
    multiplier for the constraint, are linear in v, so they are solved once, for v as unknowns.
    """
    full = (1 << m) - 1
    size = m + 1
    rows = [[Fraction(0)] * (size + full + 1) for _ in range(size)]
    for s in range(1, full):
        ones = [k for k in range(m) if s >> k & 1]
        w = Fraction(m - 1, math.comb(m, len(ones)) * len(ones) * (m - len(ones)))
        for i in ones:
            for j in ones:
                rows[i][j] += w
            rows[i][size + s] += w
    for i in range(m):
        rows[i][m] = rows[m][i] = Fraction(1)
    rows[m][size + full] = Fraction(1)
    for k in range(size):
        at = next(i for i in range(k, size) if rows[i][k])
        rows[k], rows[at] = rows[at], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(size):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k], strict=True)]
    return tuple(tuple(row[size:]) for row in rows[:m])


def shapley(removed: list[int]) -> list[Fraction]:
    """Shapley values of the filters from the removals of all coalitions."""
    return [sum((w * v for w, v in zip(weights, removed, strict=True)), Fraction(0)) for weights in shapley_weights(len(removed).bit_length() - 1)]


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders_of(part: str, by_pattern: dict[str, list[int]]) -> list[tuple]:
    """A row for each order of the filters and step: differences of coalitions."""
    m = len(FILTERS)
    out, good, bad = (coalitions(by_pattern[c]) for c in ("n", "good", "toxic"))
    total, every = sum(by_pattern["n"]), len(out) - 1
    # Summed over all orders instead of averaged.
    shares = [phi * math.factorial(m) for phi in shapley(out)]
    assert all(x.denominator == 1 for x in shares)
    rows = []
    for order in itertools.permutations(range(m)):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            after, alone = before | 1 << k, every ^ 1 << k
            removed = out[after] - out[before]
            rows.append((part, name, step, total - out[after], removed, out[1 << k] - removed, out[every] - out[alone], good[after] - good[before], bad[after] - bad[before], int(shares[k])))
            before = after
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each lang, order of the five filters and step: kept, removed, redundant and lost documents, and the share.

    Null texts are empty; a null lang is the part of the empty string.  Repeated rows count each time,
    but are no copies of themselves: E needs a smaller doc_id, which a null id neither has nor is.
    Several labels of a document count as one, which holds if any does; null labels say nothing.
    Further columns are no matter; an empty table gives an empty result.
    """
    columns = [x.split()[0] for x in _REPORT.split(", ")]

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {c: [0] * (1 << len(FILTERS)) for c in ("n", "good", "toxic")}
        for r in pdf.itertuples():
            for c in by:
                by[c][r.bits] += int(getattr(r, c))
        return pd.DataFrame(orders_of(pdf["part"].iloc[0], by), columns=columns)

    return patterns(docs, labels).groupBy("part").applyInPandas(report, _REPORT)  # at most 32 rows a group


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
b AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > least] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
f AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n FROM b LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT chr(CAST(65 + i AS INTEGER)) AS c FROM range(5) r(i)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, ascii(substr(filter_order, i, 1)) - 64 AS j, list_transform(range(1, i), lambda x: ascii(substr(filter_order, x, 1)) - 64) AS earlier FROM o, range(1, 6) r(i)),
x AS (SELECT part, filter_order, step, j, n, good, bad, fails[j] AS here, len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone, len(list_filter(fails, lambda v: v)) = 1 AS alone FROM f, s),
g AS (SELECT part, filter_order, step, j, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (here AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (here AND alone), 0) AS unique_fails, coalesce(sum(n) FILTER (here AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT gone AND bad), 0) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, j) AS BIGINT) AS shapley FROM g
"""
