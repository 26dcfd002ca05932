"""Customers that must not be contacted, found by their tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_tag_contains
from ..functions.vocabulary import CUSTOMER, EXACT_TAGS, TAG_NEEDLES, TAGS
from .skew import joinable, with_own_shuffle

#: Longer lists of tags are joined instead of being part of the plan.
FEW_TAGS = 500


def exploded_tags(customers: DataFrame, key: str = CUSTOMER) -> DataFrame:
    """One row per tag; customers with a null or empty array have none."""
    return customers.select(key, F.explode(TAGS).alias("tag"))


def forbidden_by_exact_tag(
    customers: DataFrame, forbidden: Sequence[str] | DataFrame = EXACT_TAGS, key: str = CUSTOMER
) -> DataFrame:
    """Keys carrying at least one of the listed tags, each once.

    Tags are filtered as they are exploded, within one generated stage; only the
    keys of matching tags are shuffled. A list of any size can be a table whose first column holds the tags: it is
    joined, and how is left to Spark. Long sequences become such a table.
    """
    tags = exploded_tags(customers, key)
    if not isinstance(forbidden, DataFrame) and len(forbidden) > FEW_TAGS:
        forbidden = customers.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(forbidden)], "tag string")
    if isinstance(forbidden, DataFrame):
        listed = forbidden.select(F.col(forbidden.columns[0]).alias("tag")).distinct()
        # Tags that very many customers carry are split over tasks by Spark's skew handling.
        hits = tags.join(with_own_shuffle(listed), "tag", "leftsemi")
    else:
        hits = tags.where(F.col("tag").isin(*forbidden))
    return hits.select(key).distinct()


def forbidden_by_substring(
    tagged: DataFrame,
    needles: Sequence[str] = TAG_NEEDLES,
    fold_needles: bool = False,
    key: str = CUSTOMER,
) -> DataFrame:
    """Keys with a tag that, lowercased, ever contained one of the needles.

    Only the tags are lowercased: a needle with capitals matches nothing unless
    `fold_needles` is set. Customers whose tags are null are not flagged.
    """
    return tagged.where(any_tag_contains(TAGS, needles, fold_needles)).select(key).distinct()


def without_forbidden(
    df: DataFrame, forbidden: DataFrame, key: str = CUSTOMER, one_per_key: bool = False
) -> DataFrame:
    """Drop flagged keys; rows without a key stay.

    `one_per_key` says that `df` has at most one row per key, so that no key is hot.
    """
    return df.join(joinable(forbidden, one_per_key), key, "leftanti")
