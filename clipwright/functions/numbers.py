"""Media time and decimal rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ms_key(seconds: Column) -> Column:
    """Whole milliseconds, ties to even."""
    return F.rint(seconds * 1000).cast("bigint")


def round3(x: Column) -> Column:
    """Ties to even of a thousandth of the product."""
    return F.rint(x * 1000) / 1000


#: A double's factor of 2**27 + 1 splits it into halves whose products are exact.
_SPLIT = 134217729.0
#: Doubles from here on are whole, and longs hold them up to ``_LONG``.
_WHOLE, _LONG = float(1 << 52), float(1 << 63)


def _halves(x: Column) -> tuple[Column, Column]:
    big = x * _SPLIT
    high = big - (big - x)
    return high, x - high


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is written into the plan once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _thousandths(r: Column) -> Column:
    """The nearest whole number of thousandths to an ``r`` in [0, 1), ties to even, of its exact binary value.

    1000 r is p + e without error (a product of halves; 1000 is short enough to
    be one half); with n and f the whole part and the rest of p, the sign of
    (f - 1/2) + e decides, as f - 1/2 is exact and a rounded sum has the sign
    of the true one.
    """

    def decided(v: Column) -> Column:
        n = F.floor(v["p"])
        beyond = (v["p"] - n - 0.5) + v["e"]
        return n + F.when((beyond > 0) | ((beyond == 0) & (n % 2 == 1)), 1).otherwise(0)

    def exact(x: Column) -> Column:
        high, low = _halves(x)
        return F.struct((x * 1000.0).alias("p"), ((high * 1000.0 - x * 1000.0) + low * 1000.0).alias("e"))

    return _let(_let(r, exact), decided)


def _parts(size: Column) -> Column:
    """(whole, part): whole part and thousandths, 0 to 999, of a magnitude below ``_LONG``."""

    def carried(v: Column) -> Column:
        return F.struct((v["whole"] + F.when(v["part"] == 1000, 1).otherwise(0)).alias("whole"), F.when(v["part"] == 1000, 0).otherwise(v["part"]).alias("part"))

    whole = F.floor(size)  # a long
    return _let(F.struct(whole.alias("whole"), F.when(size < _WHOLE, _thousandths(size - whole)).otherwise(F.lit(0).cast("bigint")).alias("part")), carried)


def _is_negative(x: Column) -> Column:
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def fixed3(x: Column) -> Column:
    """Text with three decimals of the exact binary value, ties to even; null and NaN give null.

    From 2**63 on values are written by their shortest digits, filled up with
    zeros.
    """
    x = x.cast("double")
    size, sign = F.abs(x), F.when(_is_negative(x), F.lit("-")).otherwise(F.lit(""))
    plain = _let(_parts(size), lambda v: F.concat(v["whole"].cast("string"), F.lit("."), F.lpad(v["part"].cast("string"), 3, "0")))
    large = F.when(size == float("inf"), F.lit("inf")).otherwise(F.format_string("%.3f", size))
    # away from the middle of two thousandths the rounded product tells them, too
    scaled = x * 1000
    clear = (x > 0) & (x < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    exact = F.concat(sign, F.when(size < _LONG, plain).otherwise(large))
    return F.when(x.isNotNull() & ~F.isnan(x), F.when(clear, fixed3_of_ms(ms_key(x))).otherwise(exact))


def rounded_exactly(x: Column) -> Column:
    """The double nearest to the three decimals that ``fixed3`` writes; NaN and what is whole stay."""
    x = x.cast("double")
    near = F.abs(x) < float(1 << 43)  # whole part and thousandths together are exact
    value = _let(_parts(F.abs(x)), lambda v: (v["whole"] * 1000 + v["part"]) / F.lit(1000.0))
    return F.when(near, F.when(_is_negative(x), -value).otherwise(value)).when(F.abs(x) < _WHOLE, fixed3(x).cast("double")).otherwise(x)


def fixed3_of_ms(ms: Column) -> Column:
    """Whole milliseconds as text with three decimals."""
    return F.format_string("%s%d.%03d", F.when(ms < 0, F.lit("-")).otherwise(F.lit("")), F.floor(F.abs(ms) / 1000).cast("bigint"), F.pmod(F.abs(ms), F.lit(1000)).cast("bigint"))
