"""Row operators with a defined order: dedup, top-k, gaps-and-islands, reshape, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.order import with_medians


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_group(df: DataFrame, by: list, order: list, n: int) -> DataFrame:
    return ranked(df, by, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def review_mixture(df: DataFrame, by: list, n: int, score: str, errors: str, recall: str, tie: str) -> DataFrame:
    """Of each group the n // 3 best and worst by score and, for the rest of n, the most errors (then
    the least recall); a row that is picked twice counts once. Nulls in score are never best or worst
    before a value; missing errors count as 0, missing recall as 1. tie, ascending, breaks ties."""
    third = max(1, n // 3)
    picks = {
        "_best": ([F.col(score).desc_nulls_last()], third), "_worst": ([F.col(score).asc_nulls_last()], third),
        "_errors": ([F.coalesce(errors, F.lit(0)).desc(), F.coalesce(recall, F.lit(1.0)).asc()], max(1, n - 2 * third)),
    }
    out = df
    for name, (order, _) in picks.items():
        out = ranked(out, by, [*order, F.col(tie)], name)
    picked = [F.col(name) <= most for name, (_, most) in picks.items()]
    turn = F.when(picked[0], F.col("_best")).when(picked[1], third + F.col("_worst")).otherwise(2 * third + F.col("_errors"))
    kept = out.filter(picked[0] | picked[1] | picked[2]).withColumn("_turn", turn)
    return top_per_group(kept, by, [F.col("_turn")], n).drop("_turn", *picks)


def keep_best(df: DataFrame, by: list, order: Column, largest: bool = True) -> DataFrame:
    """One row a key, by an aggregate rather than a window: rows of a key are combined before they are shuffled."""
    row = F.struct(*df.columns)
    best = (F.max_by if largest else F.min_by)(row, order)
    return df.groupBy(*by).agg(best.alias("_row")).select("_row.*")


def first_rows(df: DataFrame, by: list, order: Column) -> DataFrame:
    return keep_best(df, by, order, largest=False)


def islands(df: DataFrame, by: list, order: list, starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows that begin where starts holds."""
    return df.withColumn(name, F.sum(starts.cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def pairs_within(df: DataFrame, group: str, key: str) -> DataFrame:
    """Unordered pairs a < b of distinct keys in a group. Groups are baskets of bounded size by nature
    (elements of one sentence, items of one order)."""
    rows = df.select(group, key).filter(F.col(group).isNotNull() & F.col(key).isNotNull()).distinct()
    return rows.withColumnRenamed(key, "a").join(rows.withColumnRenamed(key, "b"), group).filter("a < b")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def candidate_column(df: DataFrame, names: list[str], required: bool = False) -> str | None:
    """The first of names that the table has, case-insensitive."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[n.lower()] for n in names if n.lower() in have), None)
    if found is None and required:
        raise ValueError(f"none of the columns {names} in {df.columns}")
    return found


def project(df: DataFrame, wanted: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Renames candidate columns to canonical names; absent optional ones are null."""
    found = {k: candidate_column(df, v, k in required) for k, v in wanted.items()}
    return df.select(*((F.col(c) if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()))


def available(df: DataFrame, aggregates: dict[str, Column]) -> list[Column]:
    """Only the aggregates whose column the table has."""
    return [expression.alias(f"{name}_agg") for name, expression in aggregates.items() if name in df.columns]


def without_blank_columns(df: DataFrame) -> DataFrame:
    """Drops columns that are null or blank in every row; one aggregate decides."""
    longest = df.agg(*(F.max(F.length(F.trim(F.col(c).cast("string")))).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if longest[c]))


def audit(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """metric, value rows from one aggregate."""
    one = df.agg(*(x.cast("double").alias(k) for k, x in metrics.items()))
    return one.unpivot([], list(metrics), "metric", "value")


def most_common(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return top_per_group(counts, by, [F.desc("n"), F.asc(value)], n)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds number (from 0) in a global order: rows are sorted by a range exchange and written with
    their place in their part, then each part's offset is added; no single task sees all rows."""
    from spanloom.session import stored

    part = F.spark_partition_id()
    rows = stored(df.orderBy(*order).select("*", part.alias("_part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("_at")), "numbered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each part
    return rows.join(F.broadcast(offsets), "_part").withColumn("number", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def in_order(values: list, x: Column) -> Column:
    """Sort key of a custom category order; what is not listed comes last."""
    at = F.array_position(F.array(*map(F.lit, values)), x)
    return F.when(at > 0, at).otherwise(len(values) + 1)


def split_rows(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """A row for each non-empty part of a joined column."""
    parts = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), separator), lambda p: F.trim(p)), lambda p: p != "")
    return df.withColumn(column, F.explode(parts))


def count_map(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and a map from value to its number of rows."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def count_distribution(df: DataFrame, row: str, member: str) -> DataFrame:
    """How many rows have how many distinct members."""
    return df.groupBy(row).agg(F.countDistinct(member).alias("n_members")).groupBy("n_members").agg(F.count("*").alias("n_rows"))


def grouped_or_all(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """df with those keys that it has; with none of them, one group of all rows."""
    there = [k for k in keys if k in df.columns]
    return (df, there) if there else (df.withColumn("__all__", F.lit("all")), ["__all__"])


def mean_difference(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, mean_1, mean_0 and their difference."""
    rows = df.select(label, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))))
    m = rows.groupBy("feature").agg(F.avg(F.when(F.col(label) == 1, F.col("x"))).alias("mean_1"), F.avg(F.when(F.col(label) == 0, F.col("x"))).alias("mean_0"))
    return m.withColumn("difference", F.col("mean_1") - F.col("mean_0"))


def paired(df: DataFrame, key: list[str], kind: str, one: str, other: Column, metrics: list[str]) -> DataFrame:
    """Rows of one kind beside every row of another, on key; metrics become one_x and other_x."""
    a = df.filter(F.col(kind) == one).select(*key, *(F.col(m).alias(f"one_{m}") for m in metrics))
    b = df.filter(other).select(*key, F.col(kind).alias("other"), *(F.col(m).alias(f"other_{m}") for m in metrics))
    return a.join(b, key)


def win_rates(pairs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """n, mean and median difference, and shares of wins, losses and ties by keys."""
    d = F.col(f"one_{metric}") - F.col(f"other_{metric}")
    share = lambda c: F.avg(c.cast("int"))
    s = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.avg(d).alias("mean_delta"), share(d > 0).alias("win_rate"), share(d < 0).alias("loss_rate"), share(d == 0).alias("tie_rate"))
    return with_medians(s, pairs.select(*keys, d.alias("delta")), keys, ["delta"])


def best_other(df: DataFrame, key: list[str], other: Column, metric: str, tie: str) -> DataFrame:
    """Of the other kinds' rows, the best of each key."""
    return df.filter(other).groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(metric, tie)).alias("_b")).select("_b.*")


def by_status(df: DataFrame, column: str, values: list) -> dict:
    """A table's rows by the value of a column, one frame for each value, from one scan each."""
    return {v: df.filter(F.col(column) == v) for v in values}
