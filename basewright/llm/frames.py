"""Small helpers shared by the operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, and the ASCII letters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows that a Python task looks at together.
ROWS_AT_ONCE = 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` computed once per row however often it is used."""
    return F.transform(F.array(value), use)[0]


#: Values that `running` goes over in one go.
IN_ONE_GO = 64


def running(values: Column, combine: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """`values` (an array of int) combined up to each place: running sums with `+`, running maxima with `F.greatest`.

    Long arrays go in blocks, and the blocks' totals the same way, so that no array grows element by element to
    its full length.
    """
    before = lambda xs: F.get(xs, F.size(xs) - 1)

    def plain(xs: Column) -> Column:
        grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(combine(before(acc), x), x)))
        return F.aggregate(xs, F.array().cast("array<int>"), grow)

    def in_blocks(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / IN_ONE_GO).cast("int")), lambda b: plain(F.slice(xs, b * IN_ONE_GO + 1, IN_ONE_GO)))

        def joined(parts: Column, totals: Column) -> Column:
            shifted = lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: combine(F.get(totals, i - 1), v)))
            return F.flatten(F.transform(parts, shifted))

        return bound(blocks, lambda parts: bound(running(F.transform(parts, before), combine, levels - 1), lambda totals: joined(parts, totals)))

    if levels == 1:
        return plain(values)
    return bound(values, lambda xs: F.when(F.size(xs) <= IN_ONE_GO, plain(xs)).otherwise(in_blocks(xs)))


def apart(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns named _c0, _c1, ..., which no name of an operator's own clashes with; and old -> new names."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in names.items())), names


def together(df: DataFrame, names: dict[str, str], **changed: Column) -> DataFrame:
    """The columns of `apart` under their own names again; `changed` gives other values by new name."""
    return df.select(*(changed.get(n, F.col(n)).alias(c) for c, n in names.items()))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_has_package", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._has_package = True


def _smaller(batches: Iterator, rows: int) -> Iterator:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """`mapInArrow`, with this package at hand where the function runs.

    The function sees at most `rows` at once, so that a task holds few texts as Python objects. What
    workers remember beyond a task is cut down at its end.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        yield from function(_smaller(batches, rows))
        end_of_task()

    return df.mapInArrow(run, schema)


#: Called when a task of this worker ends.
_at_end: list[Callable[[], None]] = []


def at_end_of_task(forget: Callable[[], None]) -> None:
    """Have `forget` called at the end of this worker's tasks: a worker lives on through later stages."""
    _at_end.append(forget)


def end_of_task() -> None:
    for forget in _at_end:
        forget()
