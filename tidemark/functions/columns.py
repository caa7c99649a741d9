"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four event types that are known.
EVENT_TYPES = ("view", "cart", "remove_from_cart", "purchase")
#: Prefixes of 16 hexadecimal digits that equal shares of the 64-bit range.
HALF, THREE_FIFTHS, FOUR_FIFTHS = "8000000000000000", "9999999999999999", "cccccccccccccccc"
TENTH, TWENTIETH = "1999999999999999", "0ccccccccccccccc"
MONEY = "decimal(38,2)"


def blank(c: Column) -> Column:
    """Empty or only ASCII white space."""
    return c.rlike(r"\A[ \t\r\n\x0b\x0c]*\z")


def digits(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\z")


def money(c: Column) -> Column:
    return c.cast(MONEY)


def count_where(c: Column) -> Column:
    """How many rows hold; 0 over no rows."""
    return F.count_if(c).cast("long")


def amount_state(purchases: Column, bad: Column, valid: Column) -> Column:
    """What is known of an amount: none asked for, all, a part, nothing."""
    return F.when(purchases == 0, "no_purchases").when(bad == 0, "complete_observed").when(valid > 0, "partial_observed").otherwise("unknown")


def ratio(a: Column, b: Column, places: int = 6) -> Column:
    """a / b as a rounded double; null where b is not positive."""
    return F.round(F.when(b > 0, F.try_divide(a.cast("double"), b.cast("double"))), places)


def ratio_status(b: Column) -> Column:
    return F.when(b > 0, "defined").otherwise("zero_denominator")


def well_formed_category(code: Column) -> Column:
    return code.rlike(r"\A[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*\z")


def category(code: Column) -> Column:
    """Label of the first dotted segment; null unless the whole code is well formed."""
    return F.when(well_formed_category(code), F.split_part(code, F.lit("."), F.lit(1)))


#: Lower ends and labels of the price bands.
PRICE_BANDS = ((0, "[0,20)"), (20, "[20,50)"), (50, "[50,200)"), (200, "[200,+inf)"))


def price_band(price: Column) -> Column:
    out = F.lit("unknown")
    for low, label in PRICE_BANDS:
        out = F.when(price >= low, label).otherwise(out)
    return out


def hash16(*parts: Column | str) -> Column:
    """First 64 bits of SHA-256 over the parts, as text that sorts like the unsigned number."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.substring(F.sha2(text, 256), 1, 16)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson bounds for k of n; null for n = 0."""
    p = k.cast("double") / F.when(n > 0, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half
