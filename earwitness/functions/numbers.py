"""Decimal rounding of binary doubles, decided on their exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earwitness.functions.text import let

_SPLIT = float(2**27 + 1)


def _halves(value: float) -> tuple[float, float]:
    high = value * _SPLIT - (value * _SPLIT - value)
    return high, value - high


def round_exact(value: Column, places: int) -> Column:
    """Round half to even on the exact binary value, as Python's ``round`` does.

    Built-in rounding works on the shortest decimal print, so 2.675 (stored as
    2.67499...) would go the wrong way. The scaled value is kept as product plus
    exact residual (Dekker), and the residual decides what the product cannot.
    """
    scale = float(10**places)
    sh, sl = _halves(scale)

    def rounded(x: Column) -> Column:
        big = x * _SPLIT
        xh = big - (big - x)
        xl = x - xh
        p = x * scale
        rest = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
        k = F.floor(p)
        beyond = p - (k + F.lit(0.5))
        up = (beyond > 0) | ((beyond == 0) & ((rest > 0) | ((rest == 0) & (F.pmod(k, F.lit(2)) == 1))))
        return F.when(F.abs(p) < float(2**52), (k + F.when(up, 1).otherwise(0)).cast("double") / scale).otherwise(x)

    return let(value.cast("double"), rounded)


def round_exact_sql(value: str, places: int) -> str:
    """The same rule as a SQL expression, for checking."""
    scale = f"1e{places}::DOUBLE"
    sh, sl = (f"{v!r}::DOUBLE" for v in _halves(float(10**places)))
    c = "134217729::DOUBLE"
    xh = f"(x*{c} - (x*{c} - x))"
    xl = f"(x - {xh})"
    p = f"(x*{scale})"
    rest = f"((({xh}*{sh} - {p}) + {xh}*{sl} + {xl}*{sh}) + {xl}*{sl})"
    beyond = f"({p} - (floor({p}) + 0.5::DOUBLE))"
    up = f"CASE WHEN {beyond} > 0 OR ({beyond} = 0 AND ({rest} > 0 OR ({rest} = 0 AND floor({p})::BIGINT & 1 = 1))) THEN 1 ELSE 0 END"
    return f"list_transform([({value})::DOUBLE], lambda x: (floor({p}) + {up}) / {scale})[1]"
