"""Ordered-series building blocks that stay balanced when one key holds most rows.

A plain ``Window.partitionBy(symbol)`` puts a whole symbol in one task. Every operator of
this package that needs order goes through the functions below instead. They first measure
the largest group (one small aggregate). Groups that fit a slice keep the plain window.
Otherwise rows get their exact position in the group by counting per time bucket, are cut
into slices of equal row count, and each slice gets the rows before it (and, if asked,
behind it) that its frames can reach. The result is the same rows and values either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.session import cut

SLICE_ROWS = 1 << 20
#: Rows that a task gets as a rule where whole groups are dealt to tasks.
TASK_ROWS = 1 << 18
#: Distinct values that one task sorts at most, and the bins into which a fuller one is cut at once.
BIN_ROWS, BIN_WAYS = 1 << 18, 64


@dataclass(frozen=True)
class Slicing:
    """How the rows of an oversized group are bucketed: by ``width`` units of the order column."""

    rows: int
    origin: int
    width: int


def axis(df: DataFrame, on: str) -> Column:
    """The first order column as a BIGINT: microseconds for times, the value for integers."""
    kind = df.schema[on].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(on).cast("timestamp"))
    return F.col(on).cast("bigint")


def measure(df: DataFrame, by: Sequence[str], order: Sequence[str],
            rows: int = SLICE_ROWS) -> Slicing | None:
    """None when every group fits one slice, else a bucket width that spreads the largest group.

    The width is halved until no bucket holds more than a slice, or until it is one unit.
    """
    return surveyed(df, by, order, rows)[0]


def surveyed(df: DataFrame, by: Sequence[str], order: Sequence[str],
             rows: int = SLICE_ROWS) -> tuple[Slicing | None, int]:
    """What ``measure`` says, and the number of rows, from the same pass."""
    on = axis(df, order[0])
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("lo"), F.max(on).alias("hi"))
    top = groups.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.sum("n").alias("total"),
                     F.max(F.col("hi") - F.col("lo")).alias("span")).first()
    if top.n is None or top.n <= rows:
        return None, top.total or 0
    pieces = max(2, 4 * -(-top.n // rows))
    width = max(1, top.span // pieces)
    while width > 1:
        bucket = F.floor((on - F.lit(top.lo)) / F.lit(width))
        fullest = (df.groupBy(*by, bucket.alias("_b")).count().agg(F.max("count").alias("n")).first().n)
        if fullest <= rows:
            break
        width = max(1, width // max(2, -(-fullest // rows)))
    return Slicing(rows, int(top.lo), int(width)), top.total


def dealt(df: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Deals whole groups of ``size`` rows in all to tasks of about ``TASK_ROWS`` rows; a table that fits one task stays as it is.

    A shuffle that Spark plans by itself packs rows by their bytes, and sorted window rows take many times as many.
    """
    if size <= TASK_ROWS:
        return df
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(size / TASK_ROWS)), *by)


def _resolve(df, by, order, slicing, rows):
    return measure(df, by, order, rows) if slicing == "measure" else slicing


def _descending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in order]


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "_pos",
             slicing: Slicing | None | str = "measure", rows: int = SLICE_ROWS,
             total: str | None = None) -> DataFrame:
    """Adds the 1-based position of each row in its group, and optionally the group's row count.

    ``order`` must end in a column that is unique inside a group.
    """
    by, order = list(by), list(order)
    slicing = _resolve(df, by, order, slicing, rows)
    if slicing is None:
        w = Window.partitionBy(*by)
        df = df.withColumn(out, F.row_number().over(w.orderBy(*order)).cast("bigint"))
        return df.withColumn(total, F.count(F.lit(1)).over(w)) if total else df
    bucket = F.floor((axis(df, order[0]) - F.lit(slicing.origin)) / F.lit(slicing.width)).cast("bigint")
    marked = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*by)))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return (marked.withColumn("_in", inside).join(offsets.drop("_n"), [*by, "_bucket"])
            .withColumn(out, (F.col("_before") + F.col("_in")).cast("bigint"))
            .drop("_bucket", "_before", "_in"))


def framed(df: DataFrame, by: Sequence[str], order: Sequence[str],
           compute: Callable[[DataFrame, list[str], list[str]], DataFrame], *, back: int, ahead: int = 0,
           slicing: Slicing | None | str = "measure", rows: int = SLICE_ROWS,
           numbered_already: bool = False) -> DataFrame:
    """Runs ``compute(df, partition_columns, order_columns)`` whose frames reach at most
    ``back`` rows before and ``ahead`` rows after the current one.

    The input gains ``_pos``. In sliced mode the output also keeps ``_slice``.
    """
    by, order = list(by), list(order)
    slicing = _resolve(df, by, order, slicing, rows)
    if not numbered_already:
        df = numbered(df, by, order, slicing=slicing)
    if slicing is None:
        return compute(df, by, order)
    if max(back, ahead) > slicing.rows:
        raise ValueError("frames may not reach further than one slice")
    home = F.floor((F.col("_pos") - 1) / F.lit(slicing.rows)).cast("bigint")
    inside = (F.col("_pos") - 1) % F.lit(slicing.rows)
    targets = F.array_compact(F.array(
        home,
        F.when(inside >= slicing.rows - back, home + 1),
        F.when(inside < ahead, home - 1),
    ))
    spread = df.withColumn("_slice", F.explode(targets))
    return compute(spread, [*by, "_slice"], ["_pos"]).filter(F.col("_slice") == home)


def series_window(part: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*part).orderBy(*order)


def trailing_frame(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n − 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def guarded(agg: Column, x: Column, w: WindowSpec, least: int) -> Column:
    """Null unless the frame holds ``least`` non-null values of x."""
    return F.when(F.count(x).over(w) >= least, agg.over(w))


RECURRENCE_BLOCK = 256


def decayed(df: DataFrame, part: Sequence[str], order: Sequence[str], terms: dict[str, tuple[Column, float]],
            block: int = RECURRENCE_BLOCK) -> DataFrame:
    """y_t = q·y_{t−1} + x_t for every ``out: (x, q)``, in time linear in the rows.

    Inside a block of rows the recurrence is a running sum of x·q^−r. Earlier blocks enter through
    their end values, of which two are enough once q^block is below machine precision squared.
    """
    inside = (F.col("_pos") - 1) % F.lit(block)
    df = df.withColumn("_r", inside.cast("int")).withColumn(
        "_blk", F.floor((F.col("_pos") - 1) / F.lit(block)).cast("bigint"))
    within = (Window.partitionBy(*part, "_blk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    by_block = Window.partitionBy(*part).orderBy("_blk")
    if any(q ** (2 * block) > 1e-15 for _, q in terms.values()):
        raise ValueError("block too short for this decay")
    df = df.withColumns({
        f"_l_{out}": F.sum(x * F.pow(F.lit(q), -F.col("_r"))).over(within) * F.pow(F.lit(q), F.col("_r"))
        for out, (x, q) in terms.items()})
    carried = {}
    for out, (_, q) in terms.items():
        end = F.when(F.col("_r") == block - 1, F.col(f"_l_{out}"))
        one = F.coalesce(F.sum(end).over(by_block.rangeBetween(-1, -1)), F.lit(0.0))
        two = F.coalesce(F.sum(end).over(by_block.rangeBetween(-2, -2)), F.lit(0.0))
        carried[out] = (F.col(f"_l_{out}")
                        + F.pow(F.lit(q), F.col("_r") + 1) * (one + F.lit(q ** block) * two))
    df = df.withColumns(carried)
    return df.drop("_r", "_blk", *[f"_l_{o}" for o in terms])


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column],
                slicing: Slicing | None) -> DataFrame:
    """Running sums from the start of each group. Input carries ``_pos`` and, if sliced, ``_slice``."""
    by = list(by)
    if slicing is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({k: F.sum(c).over(w) for k, c in sums.items()})
    for k, c in sums.items():
        df = df.withColumn(f"_x_{k}", c)
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, "_slice").agg(*[F.sum(f"_x_{k}").alias(f"_s_{k}") for k in sums])
    offsets = totals.select(*by, "_slice", *[
        F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0.0)).alias(f"_o_{k}") for k in sums])
    w = Window.partitionBy(*by, "_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(offsets, [*by, "_slice"])
    df = df.withColumns({k: F.sum(f"_x_{k}").over(w) + F.col(f"_o_{k}") for k in sums})
    return df.drop(*[f"_x_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def value_bins(df: DataFrame, by: Sequence[str], value: str, rows: int = BIN_ROWS, ways: int = BIN_WAYS) -> DataFrame | None:
    """Adds ``_bin``, which grows with the value within a group, so that no bin has more than ``rows`` rows; None where no group has more.

    Bins that are too full are cut at quantiles of a mergeable sketch, again until none is. Outliers do not matter, since
    cuts follow the rows. ``df`` has one row for each (by, value) and is read several times.
    """
    by = list(by)
    keys, binned = [*by, "_bin"], df.withColumn("_bin", F.lit(0).cast("bigint"))
    sizes = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows)
    if sizes.isEmpty():
        return None
    while True:
        shares = [k / ways for k in range(1, ways)]
        cuts = binned.join(sizes, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(value, shares, 100 * ways).alias("_cuts"))
        beyond = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(value)))
        binned = binned.join(cuts, keys, "left").withColumn("_bin", F.col("_bin") * ways + F.when(F.col("_cuts").isNull(), 0).otherwise(beyond))
        binned = cut(binned.drop("_cuts"), "bins")
        sizes = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows)
        if sizes.isEmpty():
            return binned


def cumulative_by_value(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], rows: int = BIN_ROWS) -> DataFrame:
    """For one row per (by, value): ``<c>_before`` and ``<c>_total`` of every summed column.

    Groups of more than ``rows`` rows are cut in bins. Their totals form a small table whose running sum gives each bin its
    offset, so no task sorts more than ``rows`` rows of a group.
    """
    by = list(by) or ["_all"]
    keyed = cut(df.withColumn("_all", F.lit(0)) if by == ["_all"] else df, "values")
    binned = value_bins(keyed, by, value, rows)
    whole = Window.partitionBy(*by)
    if binned is None:
        w = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        out = keyed.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums} | {f"{c}_total": F.sum(c).over(whole) for c in sums})
        return out.drop("_all")
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy(*by, "_bin").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*by, "_bin", *[
        F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums], *[
        F.sum(f"_t_{c}").over(whole).alias(f"{c}_total") for c in sums])
    w = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(offsets, [*by, "_bin"]).withColumns({
        f"{c}_before": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums})
    return out.drop("_bin", "_all", *[f"_o_{c}" for c in sums])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), rows: int = BIN_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per probability."""
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulative_by_value(counts, by, value, ["_n"], rows)
    first, last, n = F.col("_n_before"), F.col("_n_before") + F.col("_n"), F.col("_n_total")

    def at(k: Column) -> Column:
        return F.max(F.when((first <= k) & (k < last), F.col(value)))

    picks = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (n - 1)
        picks += [at(F.floor(h)).alias(f"_a_{name}"), at(F.ceil(h)).alias(f"_b_{name}"),
                  F.max(h - F.floor(h)).alias(f"_f_{name}")]
    out = ranked.groupBy(*by).agg(*picks)
    return out.select(*by, *[
        (F.col(f"_a_{k}") + F.col(f"_f_{k}") * (F.col(f"_b_{k}") - F.col(f"_a_{k}"))).alias(k) for k in probs])


def newest(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, rank: str | None = None) -> DataFrame:
    """The n last rows of every group. Spark cuts each input partition to n rows per group first."""
    w = Window.partitionBy(*by).orderBy(*_descending(order))
    out = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. Two-phase, so duplicates of a hot key never meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    n = len(order)
    packed = F.min(F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)],
                            F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(packed.alias("_best")).select(*keys, "_best._row.*").select(*df.columns)
