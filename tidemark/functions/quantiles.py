"""Exact quantiles of continuous columns without gathering their values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows inside a bracket that are listed at the end; a wider bracket is narrowed by another pass.
MOST = 1 << 18


def _near(x: Column, ps: list[float], accuracy: int) -> Column:
    """For each p the approximate quantiles a little below and above it; one summary of the column serves all."""
    slack = 2.0 / accuracy
    return F.percentile_approx(x, F.array(*[F.lit(q) for p in ps for q in (max(0.0, p - slack), min(1.0, p + slack))]), accuracy)


def exact_quantiles(rows: DataFrame, columns: list[str], probabilities: list[float], accuracy: int = 2000, most: int = MOST) -> dict[str, list[float | None]]:
    """For each column its quantiles, interpolated between neighbours; nulls take no part, no values give None.

    The first pass brackets each quantile by approximate ones, whose rank error is 1 / accuracy.
    Each further pass counts, in one aggregate for all brackets, what lies below and inside.  A
    bracket of one value is the answer; one that missed its place is opened again; one
    with more than `most` rows inside gets quantiles of these alone.  What is left inside is listed
    by value, so the largest task has `most` rows, or the values that a bracket can't divide, however many rows there are.
    """
    first = rows.agg(*[x for k, c in enumerate(columns) for x in (F.count(c).alias(f"n{k}"), F.min(c).cast("double").alias(f"lo{k}"), F.max(c).cast("double").alias(f"hi{k}"))], *[_near(F.col(c), probabilities, accuracy).alias(f"q{k}") for k, c in enumerate(columns)]).collect()[0]
    at = {k: F.col(c).cast("double") for k, c in enumerate(columns)}
    bracket = {(k, j): tuple(map(float, first[f"q{k}"][2 * j : 2 * j + 2])) for k in range(len(columns)) for j in range(len(probabilities)) if first[f"n{k}"]}
    # Places of the two neighbours of each quantile among all values, from 0.
    place = {(k, j): (first[f"n{k}"] - 1) * probabilities[j] for k, j in bracket}
    ends = {b: (math.floor(h), math.ceil(h)) for b, h in place.items()}
    value: dict[tuple[int, int, int], float] = {}
    below: dict[tuple[int, int], int] = {}
    outer: dict[tuple[int, int], tuple[float, float]] = {}
    asked, listed, narrowed = set(bracket), set(), set()
    while asked:
        name = lambda b: f"{b[0]}_{b[1]}"
        inside = {b: (at[b[0]] >= bracket[b][0]) & (at[b[0]] <= bracket[b][1]) for b in asked}
        told = rows.agg(*[x for b in asked for x in (F.count_if(at[b[0]] < bracket[b][0]).alias(f"b{name(b)}"), F.count_if(inside[b]).alias(f"i{name(b)}"))]).collect()[0]
        wide = {}
        for b in sorted(asked):
            (lo, hi), n = bracket[b], told[f"i{name(b)}"]
            below[b] = told[f"b{name(b)}"]
            if ends[b][0] < below[b] or ends[b][1] >= below[b] + n:
                # A narrower bracket that missed: the one before it is listed.
                bracket[b] = outer.get(b, (first[f"lo{b[0]}"], first[f"hi{b[0]}"]))
                narrowed |= {b} & set(outer)
                continue
            if lo == hi:
                value |= {(*b, r): lo for r in ends[b]}
            elif n <= most or b in narrowed:
                listed.add(b)
            else:
                wide[b] = n
                continue
            asked.discard(b)
        if wide:
            p = {b: (ends[b][0] - below[b]) / n for b, n in wide.items()}
            again = rows.agg(*[_near(F.when(inside[b], at[b[0]]), [p[b]], accuracy).alias(name(b)) for b in wide]).collect()[0]
            for b in wide:
                found = tuple(again[name(b)])
                # Two values that hold nearly all inside can't be told apart by quantiles.
                narrowed |= {b} if found == bracket[b] else set()
                outer[b], bracket[b] = bracket[b], found
    if listed:
        inside = {b: (at[b[0]] >= bracket[b][0]) & (at[b[0]] <= bracket[b][1]) for b in listed}
        anywhere = F.lit(False)
        for c in inside.values():
            anywhere = anywhere | c
        cells = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), F.lit(j).alias("j"), at[k].alias("x"))) for (k, j), c in inside.items()]))
        upto = rows.where(anywhere).select(F.explode(cells).alias("c")).groupBy("c.k", "c.j", "c.x").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(Window.partitionBy("k", "j").orderBy("x")))
        wanted = F.broadcast(rows.sparkSession.createDataFrame([(*b, r - below[b]) for b in listed for r in set(ends[b])], "k int, j int, place long"))
        value |= {(r.k, r.j, r.place + below[r.k, r.j]): r.x for r in upto.join(wanted, ["k", "j"]).where("place >= end - n and place < end").select("k", "j", "place", "x").collect()}
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for b, h in place.items():
        lo, hi = value[*b, ends[b][0]], value[*b, ends[b][1]]
        out[columns[b[0]]][b[1]] = lo + (hi - lo) * (h - math.floor(h))
    return out
