"""Cut-offs: where the first n rows of each group end, found by counting instead of sorting.

Ranking all rows of a base to keep the first million of each group would shuffle and sort the
whole base. Here the order is searched like a number: a small random sample of each group
proposes a few rows as bounds, one pass counts exactly how many rows lie at or before each of them,
and the two bounds next to the wanted count close in on the cut. Counts are partial sums, so only
one row for each group and task is shuffled. Rows up to the lower bound are kept as they stream by;
only those of the last bucket, between the bounds, are ranked. The sample decides how small the bucket gets,
never which rows are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import written

#: Rows sampled from each bucket, and how far around the expected place bounds are proposed
#: (in standard deviations of that place).
SAMPLED = 1000
AROUND = (-3.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 3.0)
#: A bucket is small enough at so many rows plus a part of the cap.
ENOUGH, PART_OF_CAP = 1024, 8
#: Equal rows cannot be told apart by more rounds.
ROUNDS = 6


def _key_names(by: Sequence[str]) -> list[str]:
    return [f"_by{i}" for i in range(len(by))]


def with_cut(rows: DataFrame, cuts: DataFrame, by: Sequence[str]) -> DataFrame:
    """`rows` with `_cut`, the struct of their group's cut. Without keys there is one cut, a scalar."""
    values = F.struct(*(c for c in cuts.columns if c not in _key_names(by))).alias("_cut")
    if not by:
        return rows.withColumn("_cut", cuts.select(values).scalar())
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, _key_names(by), strict=True)]
    return rows.join(cuts.select(*_key_names(by), values), same, "inner").drop(*_key_names(by))


def _place(order: Sequence[str]) -> Column:
    """A row's place in the order, as one comparable value: nulls first, then column by column."""
    return F.struct(*order)


def _in_bucket(order: Sequence[str]) -> Column:
    lower, upper = F.col("_cut.lower"), F.col("_cut.upper")
    return (lower.isNull() | (_place(order) > lower)) & (upper.isNull() | (_place(order) <= upper))


def _counted(rows: DataFrame, by: Sequence[str], order: Sequence[str], cap: Column) -> DataFrame:
    """The first cut of each group: no bounds yet, all of its rows in one bucket."""
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_upper")).withColumn("cap", cap.cast("long"))
    none = F.lit(None).cast(rows.select(_place(order).alias("p")).schema["p"].dataType)
    keys = [F.col(c).alias(k) for c, k in zip(by, _key_names(by), strict=True)]
    return written(
        whole.select(*keys, "cap", F.lit(0).cast("long").alias("n_lower"), none.alias("lower"), "n_upper", none.alias("upper")), "cuts"
    )


def _is_open(enough: int) -> Column:
    left = F.col("n_upper") - F.col("n_lower")
    return (F.col("n_lower") < F.col("cap")) & (F.col("n_upper") > F.col("cap")) & (left > enough + F.col("cap") / PART_OF_CAP)


def _proposed(rows: DataFrame, cuts: DataFrame, by: Sequence[str], order: Sequence[str], seed: int) -> DataFrame:
    """The open cuts with the proposed bounds b0, b1, ... of each, in order."""
    open_rows = with_cut(rows, cuts, by).where(_in_bucket(order))
    left = F.col("_cut.n_upper") - F.col("_cut.n_lower")
    sample = open_rows.where(F.rand(seed) * left < SAMPLED).select(*by, "_cut", _place(order).alias("_place"))
    group = Window.partitionBy(*by)
    wanted = (F.col("_cut.cap") - F.col("_cut.n_lower")) / left
    size = F.col("_size")
    ranked = sample.withColumn("_size", F.count(F.lit(1)).over(group)).withColumn("_nth", F.row_number().over(group.orderBy("_place")))
    spread = F.sqrt(size * wanted * (1 - wanted)) + 1
    nth = [F.greatest(F.lit(1), F.least(size, F.round(size * wanted + x * spread).cast("int"))) for x in AROUND]
    bounds = [F.max(F.when(F.col("_nth") == n, F.col("_place"))).alias(f"b{i}") for i, n in enumerate(nth)]
    found = ranked.groupBy(*by).agg(F.first("_cut").alias("_cut"), *bounds)
    keys = [F.col(c).alias(k) for c, k in zip(by, _key_names(by), strict=True)]
    return written(found.select(*keys, "_cut.*", *(f"b{i}" for i in range(len(AROUND)))), "cuts")


def _closer(rows: DataFrame, proposed: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The proposed cuts with the nearest bounds that exact counts allow."""
    n = range(len(AROUND))
    bucket = with_cut(rows, proposed, by).where(_in_bucket(order))
    counts = [F.count_if(_place(order) <= F.col(f"_cut.b{i}")).alias(f"n{i}") for i in n]
    # Counts alone are hashed as rows stream by; with the cut's structs among them every task would sort its rows.
    counted = with_cut(bucket.groupBy(*by).agg(*counts), proposed, by)
    keys = [F.col(c).alias(k) for c, k in zip(by, _key_names(by), strict=True)]
    at = counted.select(*keys, "_cut.*", *((F.col(f"n{i}") + F.col("_cut.n_lower")).alias(f"n{i}") for i in n))

    def nearest(below: bool, value: str, otherwise: str) -> Column:
        """Of the bounds with at most (at least) `cap` rows, the last (first)."""
        tried = reversed(n) if below else n
        fits = [(F.col(f"n{i}") <= F.col("cap")) if below else (F.col(f"n{i}") >= F.col("cap")) for i in n]
        return F.coalesce(*(F.when(F.col(f"b{i}").isNotNull() & fits[i], F.col(f"{value}{i}")) for i in tried), F.col(otherwise))

    return at.select(
        *_key_names(by), "cap", nearest(True, "n", "n_lower").alias("n_lower"), nearest(True, "b", "lower").alias("lower"),
        nearest(False, "n", "n_upper").alias("n_upper"), nearest(False, "b", "upper").alias("upper"),
    )


def cutoffs(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], cap: Column, enough: int = ENOUGH
) -> DataFrame:
    """One row for each group: its cap, and the last bucket around the cap-th row.

    n_lower rows lie at or before `lower` (null: none do), n_upper at or before `upper` (null: all do).
    `cap` may use the columns in `by`. `rows` is read two times, and two more in each round: hand in
    something stored. A round makes a bucket about a hundred times smaller.
    """
    cuts = _counted(rows, by, order, cap)
    for seed in range(ROUNDS):
        wide = cuts.where(_is_open(enough))
        if wide.isEmpty():
            break
        closer = _closer(rows, _proposed(rows, wide, by, order, seed), by, order)
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in _key_names(by)] or [F.lit(True)]
        if by:
            both = cuts.alias("old").join(closer.alias("new"), same, "left")
            pick = [F.when(F.col("new.cap").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in cuts.columns]
            cuts = written(both.select(*(F.col(f"old.{k}").alias(k) for k in _key_names(by)), *pick[len(by) :]), "cuts")
        else:
            stored = written(closer, "cuts")
            cuts = cuts if stored.isEmpty() else stored
    return cuts


def split_at(rows: DataFrame, cuts: DataFrame, by: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that are surely among the first, and those of the last buckets with `_need`, how many of them are."""
    columns = rows.columns
    at = with_cut(rows, cuts, by)
    all_fit = F.col("_cut.n_upper") <= F.col("_cut.cap")
    sure = (F.col("_cut.lower").isNotNull() & (_place(order) <= F.col("_cut.lower"))) | (all_fit & _in_bucket(order))
    need = (F.col("_cut.cap") - F.col("_cut.n_lower")).alias("_need")
    last = at.where(_in_bucket(order) & ~all_fit).select(*columns, need).where("_need > 0")
    return at.where(sure).select(*columns), last
