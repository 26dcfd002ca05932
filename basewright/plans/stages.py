"""How many rows survive each stage of a spec, counted in one pass over the source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocabulary import CUSTOMER, SEGMENT
from ..operators.lookups import audience
from .build import labelled, lookups, measures, row_filter, source_rows
from .spec import BaseSpec

STAGES = ("input", "filtered", "grouped", "compliant", "enriched", "saved")


def stage_counts(tables: Mapping[str, DataFrame], spec: BaseSpec) -> DataFrame:
    """Rows after input, filters, grouping, tag removal, lookups and output.

    The source is aggregated once, to one row per key with two counts; the later
    stages only mark those rows. Each stage is then a sum over the marked rows, in
    place of one run per stage.
    """
    keep = row_filter(spec)
    rows = source_rows(tables, spec)
    if spec.group_by:
        kept_measures = [F.max(F.when(keep, F.col(m))).alias(m) for m in measures(spec)]
        keys = list(spec.group_by)
    else:
        rows, kept_measures = labelled(rows, spec), []
        keys = [CUSTOMER, SEGMENT] if spec.segment is not None else [CUSTOMER]
    counted = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_input"), F.count_if(keep).alias("_filtered"), *kept_measures
    )
    if spec.group_by:
        counted = labelled(counted, spec)
    wanted = lookups(tables, spec)
    forbidden = wanted.pop("forbidden")
    if forbidden is not None:
        marked = forbidden.withColumn("_forbidden", F.lit(True))
        counted = counted.join(marked, CUSTOMER, "left")
    chosen = audience(**wanted)
    if chosen is not None:
        known = chosen.select(CUSTOMER).withColumn("_known", F.lit(True))
        counted = counted.join(known, CUSTOMER, "left")

    is_compliant = F.lit(True) if forbidden is None else F.col("_forbidden").isNull()
    is_known = F.lit(True) if chosen is None else F.col("_known").isNotNull()
    in_segment = F.lit(True) if spec.segment is None else F.col(SEGMENT) == spec.segment
    weight = F.least("_filtered", F.lit(1)) if spec.group_by else F.col("_filtered")

    def total(amount, *conditions):
        for condition in conditions:
            amount = F.when(condition, amount).otherwise(0)
        return F.coalesce(F.sum(amount), F.lit(0)).cast("bigint")

    saved = total(weight, is_compliant, is_known, in_segment)
    if spec.row_cap is not None:
        saved = F.least(saved, F.lit(spec.row_cap)).cast("bigint")
    totals = (
        total(F.col("_input")),
        total(F.col("_filtered")),
        total(weight),
        total(weight, is_compliant),
        total(weight, is_compliant, is_known),
        saved,
    )
    named = [t.alias(stage) for stage, t in zip(STAGES, totals)]
    return (
        counted.agg(*named)
        .select(
            F.inline(
                F.array(
                    *(
                        F.struct(
                            F.lit(i).alias("stage_no"),
                            F.lit(stage).alias("stage"),
                            F.col(stage).alias("rows"),
                        )
                        for i, stage in enumerate(STAGES, 1)
                    )
                )
            )
        )
    )
