"""Build a base and save it: as one table, or as one table per combination."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..functions.vocabulary import LATENESS, LATENESS_VALUES, SEGMENT, SEGMENTS
from ..sinks.tables import save_split, save_table, split_values
from .build import base_for, enriched_base
from .spec import BaseSpec


def save_base(
    tables: Mapping[str, DataFrame],
    spec: BaseSpec,
    name: str,
    split: str | None = None,
    segments: Sequence[str] = SEGMENTS,
    lateness: Sequence[str] = LATENESS_VALUES,
    caps: Mapping[str, int] | None = None,
    order_by: Sequence[str] = (),
    folder: str | None = None,
    staged: bool | None = None,
) -> dict[str, DataFrame]:
    """Save the base of a spec; returns the saved tables by name.

    `split` is None for a single table, or 'segment', 'lateness' or 'segment_lateness'
    for one table per combination of the given values. The spec's row cap holds for
    every table that `caps` does not mention, by combination ('multi_debt_long').
    """
    if split is None:
        if caps:
            raise ValueError("caps per combination need a split")
        return {name: save_table(base_for(tables, spec, staged), name, folder)}
    columns = split_values(split, segments, lateness)
    if spec.segment is not None:
        raise ValueError("keeping one segment and splitting exclude each other")
    if SEGMENT in columns and not spec.product_segment:
        raise ValueError(f"the split {split!r} needs product_segment")
    if LATENESS in columns and spec.lateness_cutoff is None:
        raise ValueError(f"the split {split!r} needs a lateness cutoff")
    return save_split(
        enriched_base(tables, spec, staged),
        name,
        split,
        spec.columns,
        segments=segments,
        lateness=lateness,
        row_cap=spec.row_cap,
        caps=caps,
        order_by=order_by,
        folder=folder,
    )
