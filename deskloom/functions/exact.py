"""Sums and means of doubles that don't depend on the order of the rows.

A sum of doubles rounds at every step, so its last bits follow from how the rows
are dealt out, and a figure rounded for a report can change with them. Here every
value is cut into whole numbers of 30 bits at fixed places of the binary point.
Their sums are exact in any order and combine on the map side like other sums;
the double nearest to the total is made once, at the end.

Values are exact down to 2**-90 (finer bits are rounded value by value, the same
in any order) and up to 2**93 in size; larger ones, and sums of over some 10**11
of the largest, overflow. Nulls are passed over; the total of none is null. NaN
and infinite values raise an error under ANSI rules.
"""

from pyspark.sql import Column, functions as F

BITS = 30
# Places of the parts: multiples of 2**30, of 1, of 2**-30, 2**-60 and 2**-90.
PLACES = range(-1, 4)
_BASE = 1 << BITS


def _whole(x: Column, place: int) -> Column:
    return F.rint(x * F.lit(2.0 ** (BITS * place)))


def parts(x: Column) -> list[Column]:
    """Whole numbers whose multiples, by place, add up to a double."""
    # Both numbers of a difference are whole and what they differ by is small: no bit is lost.
    rest = [_whole(x, k) - _whole(x, k - 1) * F.lit(float(_BASE)) for k in PLACES[1:]]
    return [part.cast("bigint") for part in (_whole(x, PLACES[0]), *rest)]


def _joined(totals: list[Column]) -> Column:
    """The double nearest to the sums of parts: carried from the lowest place up, then added.

    Carrying leaves parts of at most half the base, so the first that isn't zero
    decides sign and size, and nothing cancels.
    """
    base, half = F.lit(_BASE).cast("decimal(10,0)"), F.lit(_BASE // 2).cast("decimal(10,0)")
    carry, small = F.lit(0).cast("decimal(30,0)"), []
    for total in reversed(totals[1:]):
        carried = (total + carry).cast("decimal(32,0)")
        left = F.pmod(carried + half, base) - half
        small.append(left.cast("double"))
        carry = ((carried - left) / base).cast("decimal(30,0)")
    value = F.lit(0.0)
    for part in small[:-1]:
        value = (value + part) / F.lit(float(_BASE))
    return (totals[0] + carry).cast("double") * F.lit(float(_BASE)) + (value + small[-1])


def total(x: Column | str) -> Column:
    """Aggregate: the sum of a double column, the same bits in any order of the rows."""
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    return _joined([F.sum(part.cast("decimal(20,0)")) for part in parts(value)])


def mean(x: Column | str) -> Column:
    """Aggregate: the mean of a double column, the same bits in any order of the rows."""
    return F.try_divide(total(x), F.count(x))
