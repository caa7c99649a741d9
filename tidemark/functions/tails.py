"""Tail probabilities as column expressions: fixed numbers of terms inside `aggregate`, no Python.

erfc is a series of positive terms up to BEND and a continued fraction beyond it; the incomplete
beta function is its continued fraction in Lentz's form.  Each has its SQL beside it, with the
same terms, as a recursive query over rows of (key, arguments).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the three expansions, and where erfc changes from the one to the other.
SERIES, FRACTION, LENTZ, BEND = 80, 60, 160, 2.5
_TINY = 1e-300
#: Stirling's series, of 1 / z, 1 / z^3 and so on.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
_SHIFT = 12


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def erfc(x: Column) -> Column:
    """Of x >= 0; null for null."""
    term = F.struct(x.alias("term"), x.alias("sum"))
    grown = lambda s, k: s["term"] * (2 * x * x) / (2 * k + 1)
    series = F.aggregate(_steps(SERIES), term, lambda s, k: F.struct(grown(s, k).alias("term"), (s["sum"] + grown(s, k)).alias("sum")))["sum"]
    near = 1 - series * F.exp(-x * x) * (2 / math.sqrt(math.pi))
    inner = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1)), F.lit(1.0), lambda s, k: 1 + k / (2 * x * x) / s)
    far = F.exp(-x * x) / (x * math.sqrt(math.pi)) / inner
    return F.when(x.isNotNull(), F.when(x < BEND, near).otherwise(far))


def log_gamma(z: Column) -> Column:
    """Of z > 0, by Stirling's series at z + 12."""
    big = z + _SHIFT
    out = (big - 0.5) * F.ln(big) - big + 0.5 * math.log(2 * math.pi)
    for k, c in enumerate(_STIRLING):
        out = out + c / F.pow(big, F.lit(2 * k + 1))
    for k in range(_SHIFT):
        out = out - F.ln(z + k)
    return out


def _not_zero(c: Column) -> Column:
    return F.when(F.abs(c) > _TINY, c).otherwise(_TINY)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    first = 1 / _not_zero(1 - (a + b) * x / (a + 1))

    def step(s, num):
        d = 1 / _not_zero(1 + num * s["d"])
        c = _not_zero(1 + num / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["out"] * c * d).alias("out"))

    even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
    odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    # Numerators in turn, so that a step of the fold is one of the fraction.
    numerators = F.flatten(F.transform(_steps(LENTZ), lambda m: F.array(even(m.cast("double")), odd(m.cast("double")))))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("out"))
    return F.aggregate(numerators, start, step)["out"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised I_x(a, b), for 0 <= x <= 1; null for null."""
    swap = x >= (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.ln(y) + q * F.ln(1 - y))
    part = front * _beta_fraction(p, q, y) / p
    inside = F.when(swap, 1 - part).otherwise(part)
    return F.when(x.isNotNull(), F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside))


def _column(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def normal_two_sided(z: Column | str) -> Column:
    """P(|Z| >= |z|)."""
    return erfc(F.abs(_column(z)) / math.sqrt(2))


def chi_square_one(x: Column | str) -> Column:
    """Upper tail with one degree of freedom."""
    return erfc(F.sqrt(_column(x) / 2))


def student_two_sided(t: Column | str, df: Column | str) -> Column:
    """P(|T| >= |t|) with df degrees of freedom."""
    t, df = _column(t), _column(df)
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def erfc_sql(name: str, source: str) -> str:
    """Recursive tables that end in `name` (key, p): erfc(x) for the rows (key, x) of `source`."""
    return f"""{name}s AS (SELECT key, CAST(x AS DOUBLE) AS x, CAST(x AS DOUBLE) AS term, CAST(x AS DOUBLE) AS total, 0 AS k FROM {source} WHERE x IS NOT NULL
  UNION ALL SELECT key, x, term * (2 * x * x) / (2 * (k + 1) + 1), total + term * (2 * x * x) / (2 * (k + 1) + 1), k + 1 FROM {name}s WHERE k < {SERIES}),
{name}f AS (SELECT key, CAST(x AS DOUBLE) AS x, CAST(1.0 AS DOUBLE) AS v, {FRACTION} AS k FROM {source} WHERE x IS NOT NULL UNION ALL SELECT key, x, 1 + k / (2 * x * x) / v, k - 1 FROM {name}f WHERE k > 0),
{name} AS (SELECT s.key, CASE WHEN s.x < {BEND!r} THEN 1 - s.total * exp(-s.x * s.x) * (2 / sqrt(pi())) ELSE exp(-s.x * s.x) / (s.x * sqrt(pi())) / f.v END AS p FROM {name}s s JOIN {name}f f USING (key) WHERE s.k = {SERIES} AND f.k = 0)"""


def incomplete_beta_sql(name: str, source: str) -> str:
    """Recursive tables that end in `name` (key, p): I_x(a, b) for the rows (key, a, b, x) of `source`, 0 < x < 1."""
    tiny = lambda c: f"(CASE WHEN abs({c}) > {_TINY!r} THEN {c} ELSE {_TINY!r} END)"
    even, odd = "m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))", "-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))"
    return f"""{name}w AS (SELECT key, x >= (a + 1) / (a + b + 2) AS swap, CAST(a AS DOUBLE) AS a0, CAST(b AS DOUBLE) AS b0, CAST(x AS DOUBLE) AS x0 FROM {source} WHERE x IS NOT NULL),
{name}a AS (SELECT key, swap, CASE WHEN swap THEN b0 ELSE a0 END AS a, CASE WHEN swap THEN a0 ELSE b0 END AS b, CASE WHEN swap THEN 1 - x0 ELSE x0 END AS x FROM {name}w),
{name}r AS (SELECT key, swap, a, b, x, CAST(1.0 AS DOUBLE) AS c, 1 / {tiny("(1 - (a + b) * x / (a + 1))")} AS d, 1 / {tiny("(1 - (a + b) * x / (a + 1))")} AS o, 0 AS k FROM {name}a
  UNION ALL SELECT key, swap, a, b, x, c1, d1, o * c1 * d1, k + 1 FROM (SELECT *, 1 / {tiny("(1 + num * d)")} AS d1, {tiny("(1 + num / c)")} AS c1 FROM (SELECT *, CASE WHEN k % 2 = 0 THEN {even} ELSE {odd} END AS num FROM (SELECT *, CAST(k // 2 + 1 AS DOUBLE) AS m FROM {name}r WHERE k < {2 * LENTZ})))),
{name} AS (SELECT key, CASE WHEN swap THEN 1 - v ELSE v END AS p FROM (SELECT key, swap, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * o / a AS v FROM {name}r WHERE k = {2 * LENTZ}))"""
