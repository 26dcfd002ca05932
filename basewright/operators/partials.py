"""One row per customer from stored partial results, so that a new day costs one day.

The maximum of maxima is the maximum: a day's collections are grouped once, and stored by day as
the greatest measures of each key. Whole months can be rolled up, each into one partition. The
grouping over all history then reads one row per key for each rolled-up month and each later day, instead of all
collections. A day that is stored again replaces its old rows, and the roll-up of its month.

    <path>/day/date=2026-03-01/...       one row per key, written by `add`
    <path>/month/month=2026-02/...       one row per key, written by `roll_up`
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.vocabulary import DATE
from .grouping import one_row_per

MONTH = "month"


def _month() -> Column:
    return F.date_format(DATE, "yyyy-MM")


class Partials:
    """Stored maxima of `measures` for each of `keys`, by day and month, below `path`.

    `like` is a DataFrame with the columns of the collections; only its types are used.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], measures: Sequence[str], like: DataFrame):
        if not keys:
            raise ValueError("grouping needs at least one key")
        if DATE in (*keys, *measures):
            raise ValueError(f"{DATE!r} tells the days apart; it cannot be a key or a measure")
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.measures = list(keys), list(measures)
        wanted = like.select(*self.keys, *self.measures)
        #: Types as grouping leaves them; partitions by day and month.
        self.schema = one_row_per(wanted, self.keys, self.measures).schema

    def _stored(self, kind: str, part: str, type_: str) -> DataFrame:
        """The stored rows of one kind; none if nothing has been stored yet."""
        schema = StructType.fromDDL(f"{part} {type_}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], StructType([*self.schema, *schema]))
        return self.spark.read.schema(StructType([*self.schema, *schema])).parquet(f"{self.path}/{kind}")

    def days(self) -> DataFrame:
        return self._stored("day", DATE, "date")

    def months(self) -> DataFrame:
        return self._stored("month", MONTH, "string")

    def _replace(self, rows: DataFrame, kind: str, part: str) -> None:
        """Write rows, replacing the partitions that they are in and no others."""
        dealt = rows.repartition(part, *self.keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{self.path}/{kind}")

    def add(self, collections: DataFrame) -> None:
        """Store some days, whole: all collections of each, already filtered as the base wants them.

        Costs a grouping of these days. Months among them that were rolled up are rolled up again.
        """
        rows = collections.where(F.col(DATE).isNotNull())
        self._replace(one_row_per(rows, [*self.keys, DATE], self.measures), "day", DATE)
        closed = self.months().select(MONTH).distinct()
        # At most a row for each month of the history.
        again = [r[MONTH] for r in rows.select(_month().alias(MONTH)).distinct().join(closed, MONTH, "leftsemi").collect()]
        if again:
            self.roll_up(again)

    def roll_up(self, months: Sequence[str]) -> None:
        """Merge the days of whole months ('2026-02'), each into one partition."""
        rows = self.days().withColumn(MONTH, _month()).where(F.col(MONTH).isin(*months))
        self._replace(one_row_per(rows, [*self.keys, MONTH], self.measures), "month", MONTH)

    def total(self) -> DataFrame:
        """The grouping over all stored days: the same as `one_row_per` of their collections."""
        columns = [*self.keys, *self.measures]
        months = self.months()
        closed = [r[MONTH] for r in months.select(MONTH).distinct().collect()]
        open_days = self.days().where(~_month().isin(*closed)) if closed else self.days()
        return one_row_per(months.select(*columns).unionByName(open_days.select(*columns)), self.keys, self.measures)
