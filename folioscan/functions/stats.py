"""Order statistics of arrays, as the layout rules need them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def median(values: Column) -> Column:
    """Of the positive values; the mean of the middle two for an even number; 0 if there is none."""
    xs = F.array_sort(F.filter(values, lambda x: x > 0))
    n = F.size(xs)
    mid = (F.element_at(xs, F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int"))) + F.element_at(xs, F.greatest(F.lit(1), F.floor(n / 2).cast("int") + 1))) / 2
    return F.when(n > 0, mid).otherwise(0.0)


def lower_quantile(values: Column, q: float) -> Column:
    """The value of nearest rank round((n - 1) * q), not interpolated; ``q`` is taken as it is written, so a half is a half (90 * 0.35 is one)."""
    xs = F.array_sort(values)
    rank = F.floor((F.size(xs) - 1) * F.lit(Decimal(str(q))) + F.lit(Decimal("0.5"))).cast("int")
    return F.when(F.size(xs) > 0, F.element_at(xs, rank + 1))


def weighted_quantile_index(counts: Column, q: float) -> Column:
    """The first index whose running count exceeds floor(total * q); the last index where none does."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    state = F.aggregate(
        counts, F.struct(F.lit(0).cast("long").alias("run"), F.lit(-1).alias("hit"), F.lit(0).alias("i")),
        lambda a, x: F.struct((a["run"] + x).alias("run"), F.when((a["hit"] < 0) & (a["run"] + x > F.floor(total * q)), a["i"]).otherwise(a["hit"]).alias("hit"), (a["i"] + 1).alias("i")),
    )
    return F.when(state["hit"] < 0, F.size(counts) - 1).otherwise(state["hit"])


def running_sums(values: Column) -> Column:
    """Inclusive running sums of whole numbers, in blocks of about the square root of their number: n ** 1.5 steps in place of n ** 2.

    ``values`` should be a plain column: it is read several times.
    """

    def within(xs: Column, start: Column) -> Column:
        state = F.struct(F.lit([]).cast("array<bigint>").alias("sums"), start.cast("long").alias("run"))
        return F.aggregate(xs, state, lambda a, x: F.struct(F.array_append(a["sums"], a["run"] + x).alias("sums"), (a["run"] + x).alias("run")))["sums"]

    n = F.size(values)
    step = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda k: F.slice(values, k * step + 1, step))
    begins = F.array_prepend(within(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.lit(0).cast("long"))
    large = F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), within))
    return F.when(n <= 48, within(values, F.lit(0))).otherwise(large)
