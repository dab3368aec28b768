"""Rates and averages with the rounding of the reference numbers.

One-decimal rounding must follow the *binary* value of the double (0.05 is a
little above five hundredths, 0.35 a little below thirty-five). ``bround`` works
on the printed digits instead, so the half-way cases are decided here by an
exact remainder. The arguments are SQL expressions, so a rate is parsed in one
go and not assembled call by call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tenths(x: str, tie: str) -> str:
    """Nearest whole number of tenths of a double, as a double.

    With k the nearest whole number of twentieths, an even k names the tenth.
    Else 20x - k decides; both of its steps combine values of like size and so
    leave no rounding error. ``tie`` is the tenth for an exact half.
    """
    k = f"rint(({x}) * 20)"
    rest = f"((({x}) * 16 - {k}) + ({x}) * 4)"
    up = f"(({k} + 1) / 2)"
    return (f"case when pmod({k}, 2D) = 0 then {k} / 2 when {rest} > 0 then {up} "
            f"when {rest} < 0 then {up} - 1 else {tie.format(up=up)} end")


_TO_EVEN = "case when pmod({up}, 2D) = 0 then {up} else {up} - 1 end"


def _round1(x: str) -> str:
    return f"({_tenths(x, _TO_EVEN)}) / 10"


def round1(x: str) -> Column:
    """Round a double to one decimal by its binary value, true ties to even."""
    return F.expr(_round1(x))


def pct(numerator: str, denominator: str) -> Column:
    """Percentage with one decimal; 0.0 for an empty denominator."""
    share = f"(100D * ({numerator}) / nullif(({denominator}), 0))"
    return F.expr(f"case when ({denominator}) = 0 then 0D else {_round1(share)} end")


def avg1(total: str, n: str) -> Column:
    """Average with one decimal; 0.0 for no values."""
    mean = f"(cast(({total}) as double) / nullif(({n}), 0))"
    return F.expr(f"case when ({n}) = 0 then 0D else {_round1(mean)} end")


def format_latency(ms: str) -> Column:
    """``1.2s`` from a second upwards, else ``850ms``."""
    q = f"cast({_tenths(f'(({ms}) / 1000D)', '{up}')} as bigint)"
    return F.expr(
        f"case when ({ms}) >= 1000 then concat(cast({q} div 10 as string), '.', cast({q} % 10 as string), 's') "
        f"else concat(cast(cast(floor(({ms}) + 0.5D) as bigint) as string), 'ms') end")
