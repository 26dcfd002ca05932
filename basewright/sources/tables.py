"""Named input tables, opened only when a plan asks for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from .naming import renamed


class Tables(Mapping[str, DataFrame]):
    """A mapping from table name to DataFrame whose entries are built on first use.

    A pipeline that needs only the credit-card table never touches the others, so
    unused inputs are neither listed nor read.
    """

    def __init__(self, openers: Mapping[str, Callable[[], DataFrame]]):
        self._openers = dict(openers)
        self._opened: dict[str, DataFrame] = {}

    @classmethod
    def from_parquet(cls, spark: SparkSession, paths: Mapping[str, str]) -> Tables:
        return cls({name: lambda p=path: spark.read.parquet(p) for name, path in paths.items()})

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: Mapping[str, str]) -> Tables:
        return cls({name: lambda t=table: spark.table(t) for name, table in names.items()})

    def with_column_names(self, names: Mapping[str, Mapping[str, str]]) -> Tables:
        """These tables for a lake with other column names: per table, name there -> name here.

        Columns are renamed when a table is opened; one that the table lacks is an error.
        """
        if unknown := sorted(set(names) - set(self)):
            raise ValueError(f"column names are given for {unknown}, which are no tables here")
        return Tables({t: lambda t=t: renamed(self[t], names.get(t, {})) for t in self})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            if name not in self._openers:
                raise KeyError(f"no table named {name!r}; known: {sorted(self._openers)}")
            self._opened[name] = self._openers[name]()
        return self._opened[name]

    def __contains__(self, name: object) -> bool:
        return name in self._openers

    def __iter__(self) -> Iterator[str]:
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)
