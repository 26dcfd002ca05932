"""Removing flagged keys from a large base without shuffling it.

Where the flagged keys are too many to be sent to every task, an anti-join would shuffle the whole
base to find the few rows it drops. A Bloom filter over the keys, of bounded size, first tells most rows that they
are surely not flagged: those stay and are never shuffled. Only possible hits go to the exact
anti-join, which puts back what the filter held up by mistake. The result is that of the anti-join.

The filter is an array of 64-bit words. A key's hash chooses one word and `BITS` bits in it, so
a test reads one word. It is built by a bitwise-or per word and reaches the tasks as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import written
from .skew import with_own_shuffle

BITS = 5
#: Bits of the filter for each key, and bounds on its words (at most 8 MB).
BITS_PER_KEY, LEAST_WORDS, MOST_WORDS = 16, 1 << 6, 1 << 20
#: With fewer bits than this for each key too many rows would pass: then the plain join is used.
WORTH_BITS_PER_KEY = 6


def words_for(keys: int) -> int:
    """How many words a filter over so many keys has: a power of two."""
    words = LEAST_WORDS
    while words < MOST_WORDS and words * 64 < keys * BITS_PER_KEY:
        words *= 2
    return words


def is_worthwhile(keys: int) -> bool:
    return 0 < keys * WORTH_BITS_PER_KEY <= MOST_WORDS * 64


def _word(key: Column, words: int) -> Column:
    return F.xxhash64(key).bitwiseAND(words - 1).cast("int")


def _mask(key: Column) -> Column:
    hashed = F.xxhash64(key, F.lit(1))
    place = lambda i: F.shiftright(hashed, 6 * i).bitwiseAND(63).cast("int")
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(i)))
    return mask


def filter_of(keys: DataFrame, key: str, words: int) -> DataFrame:
    """One row: the words of a Bloom filter over the column `key`, written. At most `MOST_WORDS` rows are gathered."""
    spark = keys.sparkSession
    known = keys.where(F.col(key).isNotNull())
    bits = known.groupBy(_word(F.col(key), words).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("mask"))
    every = spark.range(words).select(F.col("id").cast("int").alias("word"))
    filled = every.join(bits, "word", "left").select(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")).alias("at"))
    gathered = filled.agg(F.sort_array(F.collect_list("at")).alias("at"))
    return written(gathered.select(F.transform("at", lambda a: a["mask"]).alias("words")), "filter")


def maybe_in(key: Column, words_row: DataFrame, words: int) -> Column:
    """Whether a key may be in the filter; false for no key. `words_row` comes from `filter_of`."""
    held = F.get(words_row.select("words").scalar(), _word(key, words))
    mask = _mask(key)
    return key.isNotNull() & (held.bitwiseAND(mask) == mask)


def without_keys(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """`df` without the rows whose key is flagged; rows without a key stay.

    `flagged` has one column, the key, and should be stored: it is counted, and read twice. `df` is
    read twice as well, once for the rows that the filter clears and once for possible hits.
    """
    n = flagged.count()
    if not is_worthwhile(n):
        return df.join(with_own_shuffle(flagged), key, "leftanti")
    words = words_for(n)
    suspect = maybe_in(F.col(key), filter_of(flagged, key, words), words)
    hits = df.where(suspect).join(with_own_shuffle(flagged), key, "leftanti")
    return df.where(~suspect).unionByName(hits.select(*df.columns))


def is_broadcast(df: DataFrame) -> bool:
    """Whether Spark would broadcast `df` in a join, by the size it knows."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit
