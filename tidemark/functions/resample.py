"""Bootstrap weights from a counter: a hash of (seed, repetition, unit) and nothing else.

The weight of a unit in a repetition is the same in every task, after every retry and in any
engine that has MD5.  One hash of a unit and a block serves four repetitions, eight hexadecimal
digits each, which are compared with the thresholds of a Poisson distribution of mean one as
text.  A cell of n like records needs no hash for each: its weight is Poisson with mean n, by the
normal point of the digits with the correction for skewness; cells of few records are
drawn record by record.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Repetitions that one hash serves, and records of a cell that are drawn one by one.
LANES, FEW = 4, 16


def thresholds() -> list[str]:
    """Of 32 bits in hexadecimal digits: as many as are at most the digits is the weight."""
    below, term, out = 0.0, math.exp(-1), []
    for k in range(1, 12):
        below += term
        term /= k
        out.append(f"{min(math.ceil(below * 2**32), 2**32 - 1):08x}")
    return out


def block_hash(seed: int, *key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def block_hash_sql(seed: int, *key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(key)}))"


def digits(hash_: Column, lane: int) -> Column:
    """The eight digits of a lane."""
    return F.substring(hash_, 1 + 8 * lane, 8)


def poisson_one(digits_: Column) -> Column:
    """Weight of a unit, Poisson with mean one."""
    out = F.lit(0)
    for t in thresholds():
        out = out + (digits_ >= t).cast("int")
    return out


def poisson_one_sql(hash_: str, lane: str) -> str:
    return "(" + " + ".join(f"CAST(substr({hash_}, 1 + 8 * {lane}, 8) >= '{t}' AS INTEGER)" for t in thresholds()) + ")"


#: Coefficients of a rational approximation of the normal distribution's inverse (relative error 1e-9).
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
_LOW = 0.02425


def _horner(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _horner_sql(x: str, coefficients) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def uniform(digits_: Column) -> Column:
    return (F.conv(digits_, 16, 10).cast("double") + 0.5) / 2.0**32


def tail(u: Column) -> Column:
    """What the expansion of the far ends is in."""
    return F.sqrt(-2 * F.ln(F.least(u, 1 - u)))


def normal_point(u: Column, tail_: Column) -> Column:
    """Where the normal distribution has the share u below it; 0 < u < 1; tail_ is tail(u), best a column of its own."""
    far = _horner(tail_, _C) / (_horner(tail_, _D) * tail_ + 1)
    q = u - 0.5
    near = _horner(q * q, _A) * q / (_horner(q * q, _B) * (q * q) + 1)
    return F.when(u < _LOW, far).when(u > 1 - _LOW, -far).otherwise(near)


def normal_point_sql(u: str) -> str:
    tail = f"sqrt(-2 * ln(CASE WHEN {u} < 0.5 THEN {u} ELSE 1 - {u} END))"
    far = f"({_horner_sql(tail, _C)} / ({_horner_sql(tail, _D)} * {tail} + 1))"
    q = f"({u} - 0.5)"
    near = f"({_horner_sql(f'({q} * {q})', _A)} * {q} / ({_horner_sql(f'({q} * {q})', _B)} * ({q} * {q}) + 1))"
    return f"(CASE WHEN {u} < {_LOW!r} THEN {far} WHEN {u} > 1 - {_LOW!r} THEN -{far} ELSE {near} END)"


def poisson_many(z: Column, n: Column) -> Column:
    """Weight of a cell of n records, more than FEW, Poisson with mean n; z: its normal point."""
    return F.greatest(F.lit(0), F.floor(n + F.sqrt(n.cast("double")) * z + (z * z - 1) / 6 + 0.5)).cast("long")


def poisson_many_sql(z: str, n: str) -> str:
    return f"CAST(greatest(0, floor({n} + sqrt(CAST({n} AS DOUBLE)) * {z} + ({z} * {z} - 1) / 6 + 0.5)) AS BIGINT)"


def uniform_sql(hash_: str, lane: str) -> str:
    return f"((CAST('0x' || substr({hash_}, 1 + 8 * {lane}, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"
