"""Scalar and aggregate column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetfold.schema import COLOURS

DIGITS = 4


def fixed_units(value: Column | str, digits: int = DIGITS) -> Column:
    """The value as a whole number of ``10**-digits`` units."""
    return F.rint(_col(value) * float(10**digits)).cast("bigint")


def fixed_sum(value: Column | str, digits: int = DIGITS) -> Column:
    """Sum that does not depend on row order.

    Whole units add exactly in a long buffer, so the result is the same for
    every partitioning; an overflow raises an error instead of wrapping.
    """
    return F.sum(fixed_units(value, digits)) / F.lit(float(10**digits))


def safe_quotient(value: Column | str, weight: Column | str) -> Column:
    """value / weight, and 0 where the weight is not positive."""
    return F.when(_col(weight) > 0, _col(value) / _col(weight)).otherwise(F.lit(0.0))


def percent_error(value: Column | str, expected: Column | str) -> Column:
    """Absolute error in percent of the expected value; null when that is 0."""
    return F.try_divide(F.abs(_col(value) - _col(expected)) * 100.0, _col(expected))


def rounded_count(value: Column | str) -> Column:
    """A real-valued count estimate as a whole number, 1 when absent."""
    return F.round(F.coalesce(_col(value), F.lit(1.0))).cast("bigint")


def seconds_to_ms(seconds: Column | str) -> Column:
    return (_col(seconds) * 1000).cast("bigint")


def unix_seconds(ts: Column | str) -> Column:
    return F.unix_seconds(_col(ts).cast("timestamp"))


def unix_ms(ts: Column | str) -> Column:
    return F.unix_millis(_col(ts).cast("timestamp"))


def epoch_start(ts: Column | str, period: int) -> Column:
    """Start of the epoch a moment lies in.

    Epochs of ``period`` seconds restart at every full minute, so they equal
    tumbling windows only when the period divides 60.
    """
    seconds = unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60)) % period)


def triple(text: Column | str) -> Column:
    """``"x,y,z"`` as a struct; null unless there are exactly three numbers."""
    parts = F.split(_col(text), ",")
    numbers = [F.get(parts, i).try_cast("double") for i in range(3)]
    whole = F.size(parts) == 3
    for number in numbers:
        whole = whole & number.isNotNull()
    return F.when(whole, F.struct(*[n.alias(a) for n, a in zip(numbers, "xyz")]))


def known_colour(colour: Column | str) -> Column:
    return _col(colour).isin(*COLOURS)


def octets(*parts: Column | str) -> Column:
    """Bytes the parts take together, absent parts counting as empty."""
    total = F.lit(0).cast("bigint")
    for part in parts:
        total = total + F.coalesce(F.octet_length(_col(part)), F.lit(0))
    return total


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
