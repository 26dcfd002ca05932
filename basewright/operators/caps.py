"""Row caps: arbitrary rows, reproducible rows, and one cap per combination."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import LATENESS, SEGMENT
from ..sinks.shared import written
from .cutoffs import cutoffs, split_at

#: So many slices are merged into one in each step.
FAN_IN = 32


def slices_for(df: DataFrame) -> tuple[int, ...]:
    """Rows are ranked in so many slices, the survivors in fewer, and so on down to `FAN_IN`.

    There are at least as many first slices as shuffle partitions. Each number divides
    the one before, so a later slice is a union of earlier ones.
    """
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [FAN_IN]
    while steps[0] < wanted:
        steps.insert(0, steps[0] * FAN_IN)
    return tuple(steps)


def checked_cap(cap: int) -> int:
    if isinstance(cap, bool) or not isinstance(cap, int) or cap <= 0:
        raise ValueError(f"a row cap must be a positive whole number, not {cap!r}")
    return cap


#: Up to this cap a plain `limit` is cheap: its last task is sent at most the cap by each other task.
SMALL_CAP = 1000


def any_rows(df: DataFrame, cap: int) -> DataFrame:
    """At most `cap` rows, whichever Spark reaches first.

    A large cap is dealt out as quotas. Every task writes its rows up to the cap, the counts of
    the tasks before one tell how many of its rows still fit, and each keeps that many. No task is sent
    the rows of another.
    """
    if checked_cap(cap) <= SMALL_CAP:
        return df.limit(cap)
    row = F.monotonically_increasing_id()
    # A row's number has its task in the upper bits and its place in the task in the other 33.
    numbered = df.withColumn("_task", F.shiftright(row, 33)).withColumn("_place", row.bitwiseAND(2**33 - 1))
    stored = written(numbered.where(F.col("_place") < cap), "quota")
    # One row for each task that has rows.
    held = stored.groupBy(F.col("_task").alias("_of")).agg(F.count(F.lit(1)).alias("_held"))
    before = F.sum("_held").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    quotas = held.select("_of", (cap - F.coalesce(before, F.lit(0))).alias("_quota")).where("_quota > 0")
    kept = stored.join(quotas, (F.col("_task") == F.col("_of")) & (F.col("_place") < F.col("_quota")), "leftsemi")
    return kept.select(*df.columns)


def _salted(df: DataFrame, slices: int) -> DataFrame:
    # Any salt gives the same result; this one also spreads rows that are equal
    # in every column, as long as they come from different input partitions.
    return df.withColumn("_source", F.spark_partition_id()).withColumn(
        "_salt", F.pmod(F.xxhash64("_source", *df.columns), F.lit(slices))
    )


def _first_in_slices(
    df: DataFrame,
    cap: Column,
    largest: int,
    by: Sequence[str],
    order: Sequence[str],
    slices: Sequence[int],
) -> DataFrame:
    """Rows that can still be among the first of their group: the first of every slice.

    A slice of the whole holds a small part of a group; from the second step on it
    holds at most `slices[i - 1] / slices[i] * cap` rows. So no task has to rank a
    whole group, however few groups there are and however large one is. For small caps
    Spark also cuts every slice inside each task before it shuffles.
    """
    rows = _salted(df, slices[0])
    for n in slices:
        in_slice = Window.partitionBy("_slice", *by).orderBy(*order)
        rows = (
            rows.withColumn("_slice", F.col("_salt") % n)
            .withColumn("_rank", F.row_number().over(in_slice))
            .where((F.col("_rank") <= largest) & (F.col("_rank") <= cap))
        )
    return rows.select(*df.columns)


def _total_order(df: DataFrame, order_by: Sequence[str], by: Sequence[str] = ()) -> list[str]:
    """`order_by`, then every other column that can still tell two rows of a group apart."""
    return [*order_by, *(c for c in df.columns if c not in (*order_by, *by))]


def _is_large(df: DataFrame, cap: int) -> bool:
    """Whether Spark would no longer cut groups to `cap` inside each task, before it shuffles."""
    return cap > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def _first_by_cutoffs(df: DataFrame, cap: Column, largest: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first rows of each group for large caps: the base is written once, then counted; only last buckets are ranked."""
    stored = written(df, "base")
    sure, last = split_at(stored, cutoffs(stored, by, order, cap), by, order)
    need = F.col("_need")
    kept = _first_in_slices(last, need, largest, by, order, slices_for(df))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return sure.unionByName(ranked.where(F.col("_rank") <= need).select(*df.columns))


def first_rows(
    df: DataFrame, cap: int, order_by: Sequence[str], slices: Sequence[int] | None = None
) -> DataFrame:
    """The first `cap` rows by `order_by`, other columns breaking ties.

    A small cap is taken in slices, sorted: the last step sees at most `FAN_IN * cap` rows, however many
    tasks read the input. For a large one the place of the cut is counted out (`cutoffs`), and the base
    is not shuffled; the result is not sorted.
    """
    order = _total_order(df, order_by)
    if slices is None and _is_large(df, checked_cap(cap)):
        return _first_by_cutoffs(df, F.lit(cap), cap, (), order)
    kept = _first_in_slices(df, F.lit(checked_cap(cap)), cap, (), order, slices or slices_for(df))
    return kept.orderBy(*order).limit(cap)


def combo_key(*values: str | None) -> str:
    """Name of a combination, as used for caps and table names: 'multi_debt_long'."""
    return "_".join(v for v in values if v is not None)


def cap_column(by: Sequence[str], caps: Mapping[str, int], default: int) -> Column:
    """The cap of a row's combination; combinations without their own get the default."""
    combo = F.concat_ws("_", *by)
    return reduce(
        lambda otherwise, item: F.when(combo == item[0], checked_cap(item[1])).otherwise(otherwise),
        caps.items(),
        F.lit(checked_cap(default)),
    )


def cap_per_combo(
    df: DataFrame,
    default: int | None,
    caps: Mapping[str, int] | None = None,
    by: Sequence[str] = (SEGMENT, LATENESS),
    order_by: Sequence[str] = (),
    slices: Sequence[int] | None = None,
) -> DataFrame:
    """At most so many rows of each combination, the first ones by `order_by`.

    Combinations that `caps` does not name get `default`; None leaves them whole.
    Other columns break ties, so the result does not depend on how rows are spread.
    Small caps are taken in slices: the last ranking sees at most `FAN_IN * cap` rows of a combination,
    however many tasks read the input. For large ones the cuts are counted out (`cutoffs`): only the last bucket
    of each combination is shuffled and ranked.
    """
    if default is None:
        if not caps:
            raise ValueError("without a cap of their own or a default no combination is capped")
        named = F.concat_ws("_", *by).isin(*caps)
        return df.where(~named).unionByName(cap_per_combo(df.where(named), max(caps.values()), caps, by, order_by, slices))
    order = _total_order(df, order_by, by)
    cap = cap_column(by, caps or {}, default)
    largest = max(default, *(caps or {}).values()) if caps else default
    if slices is None and _is_large(df, largest):
        return _first_by_cutoffs(df, cap, largest, by, order)
    in_combo = Window.partitionBy(*by).orderBy(*order)
    return (
        _first_in_slices(df, cap, largest, by, order, slices or slices_for(df))
        # The largest cap as a plain number is what Spark needs to drop rows early.
        .withColumn("_rank", F.row_number().over(in_combo))
        .where((F.col("_rank") <= largest) & (F.col("_rank") <= cap))
        .drop("_rank")
    )
