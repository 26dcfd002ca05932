"""Saved tables that are replaced in one step.

The rows of a save go to a folder of their own, a version, and a saved name is a view. Nothing that readers
see changes until all rows are written and have been counted; then one view is replaced, the pointer, which is a
single call to the catalog. The names of a split are views over the pointer, one for each combination, so all of them
change with it. A save that fails before that leaves everything as it was, and a base can
read the table that it replaces.

The pointer's properties name its version and those before it. `KEPT` earlier versions stay for readers that are
still at work; older ones, and only folders that a pointer names, are deleted after the switch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Earlier versions that are kept.
KEPT = 1
VERSIONS = "basewright.versions"


def quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def new_version(spark: SparkSession, name: str, folder: str | None) -> str:
    """A folder for the rows of a save, below `folder` or the warehouse."""
    root = folder or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name.split('.')[-1]}-{uuid.uuid4().hex}"


def versions_of(spark: SparkSession, pointer: str) -> list[str]:
    """The folders that a pointer names, the newest first; none if it is no pointer yet."""
    if not spark.catalog.tableExists(pointer) or spark.catalog.getTable(pointer).tableType != "VIEW":
        return []
    listed = spark.sql(f"SHOW TBLPROPERTIES {quoted(pointer)}").where(f"key = '{VERSIONS}'").first()
    return json.loads(listed["value"]) if listed else []


def _make_room(spark: SparkSession, name: str) -> str | None:
    """Rename a plain table that bears the name of a view to be; it is dropped when the view is there."""
    if not spark.catalog.tableExists(name) or spark.catalog.getTable(name).tableType == "VIEW":
        return None
    aside = f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(aside)}")
    return aside


def replace_view(spark: SparkSession, name: str, select: str, properties: dict[str, str] | None = None) -> None:
    aside = _make_room(spark, name)
    listed = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in (properties or {}).items())
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(name)} {f'TBLPROPERTIES ({listed})' if listed else ''} AS {select}")
    if aside:
        spark.sql(f"DROP TABLE {quoted(aside)}")


def deleted(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it lies in; False if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checked_version(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of a version, read back; fails if they cannot be or if columns are missing."""
    stored = spark.read.parquet(path)
    if missing := [c for c in columns if c not in stored.columns]:
        raise RuntimeError(f"the version in {path} lacks {missing}")
    return stored


def _switched(spark: SparkSession, pointer: str, version: str, source: str) -> list[str]:
    """Replace the pointer; returns the versions that nobody needs any more."""
    before = versions_of(spark, pointer)
    replace_view(spark, pointer, f"SELECT * FROM {source}", {VERSIONS: json.dumps([version, *before[:KEPT]])})
    return before[KEPT:]


def switch(spark: SparkSession, pointer: str, path: str) -> None:
    """Let `pointer` show the version in `path`: the one step in which a save takes effect."""
    escaped = path.replace("`", "``")
    for old in _switched(spark, pointer, path, f"parquet.`{escaped}`"):
        deleted(spark, old)


def switch_table(spark: SparkSession, pointer: str, table: str) -> None:
    """The same for versions that are managed tables."""
    for old in _switched(spark, pointer, table, quoted(table)):
        spark.sql(f"DROP TABLE IF EXISTS {quoted(old)}")
