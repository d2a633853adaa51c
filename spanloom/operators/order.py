"""Order statistics without a task that sees all rows: running sums over ranges of a value, exact quantiles.

A value's range is cut at about evenly filled places. The cuts are literals, so every later step
is an ordinary window within one range and lost tasks repeat alike; only where ranges are cut
depends on an approximation, no result does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range is meant to hold.
RANGE_ROWS = 500_000


def ranged(df: DataFrame, value: str, name: str, rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """df with the number of the range that value falls into, and the number of ranges."""
    n = df.count()
    if n <= rows:
        return df.withColumn(name, F.lit(0.0)), 1
    k = -(-n // rows)
    at = sorted(set(df.approxQuantile(value, [i / k for i in range(1, k)], 1 / (4 * k))))
    marked = Bucketizer(splits=[float("-inf"), *at, float("inf")], inputCol=value, outputCol=name).transform(df)
    return marked, len(at) + 1


def same(by: list[str], left: DataFrame, right: DataFrame) -> Column:
    """Equal on all of by, nulls alike."""
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in by))


def running(df: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds a column for each of sums (name: column to add up): its total over the rows of the group up to and
    with this one, in order of value, a double. Rows of a group must differ in value."""
    marked, ranges = ranged(df, value, "_range", rows)
    order = (F.desc if descending else F.asc)
    inside = Window.partitionBy(*by, "_range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.withColumns({name: F.sum(c).over(inside) for name, c in sums.items()})
    if ranges == 1:
        return out.drop("_range")
    total = marked.groupBy(*by, "_range").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = total.select(*by, "_range", *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums))
    joined = out.join(before, same([*by, "_range"], out, before))
    return joined.select(*(out[c] for c in df.columns), *((out[name] + before[f"_{name}"]).alias(name) for name in sums))


def quantiles(df: DataFrame, by: list[str], values: list[str], shares: dict[str, float], rows: int = RANGE_ROWS) -> DataFrame:
    """by, then for each value and share {name}_{value}: the exact quantile, interpolated between neighbours
    as percentile() does. Equal values are counted before they move; nulls do not count, NaN neither; a group without
    values has null."""
    each = F.inline(F.array(*(F.struct(F.lit(v).alias("_value"), F.col(v).cast("double").alias("_x")) for v in values)))
    counts = df.select(*by, each).filter(F.col("_x").isNotNull() & ~F.isnan("_x")).groupBy(*by, "_value", "_x").agg(F.count("*").alias("_n"))
    upto = running(counts, [*by, "_value"], "_x", {"_upto": "_n"}, rows=rows)
    whole = counts.groupBy(*by, "_value").agg(F.sum("_n").alias("_all"))
    placed = upto.join(whole, same([*by, "_value"], upto, whole)).select(*(upto[c] for c in [*by, "_value", "_x", "_n"]), (F.col("_upto") - upto["_n"]).alias("_from"), "_upto", "_all")
    found = []
    for v in values:
        for name, share in shares.items():
            place = (F.col("_all") - 1) * share
            within = lambda r: F.when((F.col("_value") == v) & (F.col("_from") <= r) & (r < F.col("_upto")), F.col("_x"))  # noqa: B023, E731
            low, high = F.max(within(F.floor(place))), F.max(within(F.ceil(place)))
            part = F.max(F.when(F.col("_value") == v, place - F.floor(place)))
            found.append((low + (high - low) * part).alias(f"{name}_{v}"))
    groups = df.select(*by).distinct()
    got = placed.groupBy(*by).agg(*found)
    return groups.join(got, same(by, groups, got), "left").select(*(groups[c] for c in by), *(got[f"{n}_{v}"] for v in values for n in shares)) if by else got


def with_medians(summary: DataFrame, df: DataFrame, by: list[str], values: list[str], name: str = "median") -> DataFrame:
    """A summary of df by some columns, with exact medians {name}_{value} beside it."""
    if not values:
        return summary
    m = quantiles(df, by, values, {name: 0.5})
    if not by:
        return summary.crossJoin(m)  # one row each
    return summary.join(m, same(by, summary, m)).select(*(summary[c] for c in summary.columns), *(m[f"{name}_{v}"] for v in values))
