"""Language-model scores by Katz backoff, trained on the corpus itself.

Tokens are words, lower-cased, and one end per text. The model has two tables, made by
grouped counts over all training documents and written partitioned:

- unigrams: every word, with its Good-Turing discounted probability; what the discounts
  take goes to unknown words as one event,
- bigrams: every adjacent pair of words (a start of text before the first), however rare.

A token's probability is looked up recursively: that of the bigram if it has been seen,

    P(b | a) = d(n) * n / c(a),     else     alpha(a) * P(b),

where alpha(a) is what the seen bigrams of a leave, divided by the unigram probability
of all words not seen after it, so that P(. | a) sums to exactly 1. A context never seen
has alpha 1.

The most frequent words (at most `coded`) have small codes, all others a hash of 63 bits.

Evaluation: what concerns coded words and hot pairs alone is computed where the text is
read, from broadcast arrays of a fixed bound. All other words and pairs of a text meet the
tables in the part of their key, and the counts found there come back to the chunk of texts
that asked. Both ways rows are blocks: arrays of all that goes from one chunk to one part.
A seen pair needs only its count and c(a); the pairs that aren't found, of held-out texts
only, go on to the words' table for alpha(a) and P(b).

Defined results: a null or empty text is an end alone. Documents with a null id are
trained on. Repeated rows count and are scored each. An empty table gives an empty result;
without training documents every token is unknown. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import with_own_shuffle
from ..sinks.shared import written
from . import shingling
from .frames import map_batches, shuffle_partitions
from .shingling import GOLDEN, mixed

#: A pair of coded words is hot from one in so many tokens on, at most so many of them; so many words have codes.
COMMON, HOT_PAIRS, CODED = 4_000_000, 400_000, 200_000
#: The pairs of words that are more frequent than one in so many tokens are dealt by both words, those of others by the first.
WIDE = 20_000
#: Tokens of a chunk of texts, at the least, and its texts, of which a batch may add another 1,024.
CHUNK_TOKENS, CHUNK_TEXTS = 1_000_000, 16_384
#: Rows of tables taken together.
ENTRIES_AT_ONCE = 500_000
#: Kinds of blocks: what a text has of its own; table entries; pairs asked by trained and by held-out texts, words; pairs not found.
OWN, ENTRY, TRAINED, HELD_OUT, WORD, MISSED = range(6)
#: Counts up to this are discounted (Katz).
LARGE = 5
#: Counts of words a task holds before it adds them up; it passes them on if more than half are left.
HELD_WORDS = 2_000_000
END = b"\n"  # no word, as it is white space


def _word_keys(words):
    """Keys of words: odd and negative, so that they are never a pair's."""
    import numpy as np

    return (shingling.hashed(words) >> np.uint64(1) | np.uint64(1 << 63) | np.uint64(1)).view(np.int64)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; ASCII white space parts them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split(texts):
    """Tokens of an Arrow array of texts, as `tokens` has them but for the ends: keys of the distinct words, the place of
    each token among them, and the number of each text's."""
    words, at, lengths = shingling.split(texts)
    return _word_keys(words), at, lengths


def _added(keys, n):
    """The distinct keys, sorted, and the sum of each one's `n`."""
    import numpy as np

    order = np.argsort(keys)
    at = _new(keys[order])
    return keys[order[at]], np.add.reduceat(n[order], at)


def word_counts(training: DataFrame) -> DataFrame:
    """`key` and `n` of every token of the training texts (a column `text`)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            keys, at, lengths = split(batch.column(0))
            held.append((np.append(keys, end), np.append(np.bincount(at, minlength=len(keys)), len(lengths))))
            size += len(keys)
            if size > HELD_WORDS:
                held = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD_WORDS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], names=["key", "n"])
                    held, size = [], 0
        if held:
            found = _added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x[found[1] > 0], pa.int64()) for x in found], names=["key", "n"])

    end = _word_keys([END])
    return map_batches(training.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def good_turing(counts_of_counts: dict[int, int]) -> list[float]:
    """Discounts d(1) to d(LARGE), each above 0 and at most 1; from n(r), the number of entries seen r times.

    Katz's formula where it gives a discount, else absolute discounting, (r - D) / r.
    """
    n = [counts_of_counts.get(r, 0) for r in range(LARGE + 2)]
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    cut = (LARGE + 1) * n[LARGE + 1] / n[1] if n[1] else 1.0
    found = []
    for r in range(1, LARGE + 1):
        d = (((r + 1) * n[r + 1] / (r * n[r])) - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        found.append(d if 0 < d < 1 else max(r - absolute, 1e-3) / r)
    return found


def _discounted(n: Column, discounts: list[float]) -> Column:
    share = F.lit(1.0)
    for r, d in enumerate(discounts, 1):
        share = F.when(n == r, F.lit(d)).otherwise(share)
    return share * n


def _counts_of_counts(table: DataFrame) -> tuple[dict[int, int], int, int]:
    """n(r) for small r, the sum and the number of all entries."""
    small = [F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, LARGE + 2)]
    row = table.agg(*small, F.coalesce(F.sum("n"), F.lit(0)).alias("sum"), F.count(F.lit(1)).alias("all")).first()
    return {r: row[f"n{r}"] for r in range(1, LARGE + 2)}, row["sum"], row["all"]


@dataclass
class Common:
    """Arrays of a fixed bound; all a task needs for coded words and hot pairs."""

    keys: object  # of coded words, sorted; the place in it is a word's code
    log_p: object  # log10 P(word)
    count: object
    log_alpha: object  # per context: the words, then the start of text
    log_share: object  # likewise: log10 of what one undiscounted occurrence of a seen pair has
    pairs: object  # hot pairs (first code times width plus second), sorted
    log_n: object  # log10 of their discounted counts
    n_tokens: int  # training tokens
    n_words: int  # distinct
    unknown: float  # log10 probability of an unknown word

    @property
    def width(self) -> int:
        return len(self.keys) + 1


def coded(texts, keys):
    """Codes of all tokens of an Arrow array of texts, and the number of tokens of each: a word's code is its place in
    the sorted `keys`, else its own key (negative)."""
    import numpy as np

    words, at, lengths = split(texts)
    codes, lengths = _coded(np.append(words, _word_keys([END])), keys), lengths + 1
    found, is_end = np.empty(lengths.sum(), np.int64), np.zeros(lengths.sum(), bool)
    is_end[np.cumsum(lengths) - 1] = True
    found[is_end], found[~is_end] = codes[-1], codes[at]
    return found, lengths


def _coded(key, keys):
    """The place of each key in the sorted `keys`, the key itself where it isn't among them."""
    import numpy as np

    if not len(keys):
        return key
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return np.where(keys[at] == key, at, key)


def _before(codes, lengths, width: int):
    """The word before each along its text; the start of text comes first."""
    import numpy as np

    found = np.empty_like(codes)
    found[1:] = codes[:-1]
    found[np.cumsum(lengths) - lengths] = width - 1
    return found


def _pair_keys(a, b, width: int):
    """Keys of pairs of codes: their place in a table of coded words, else a hash, even and negative."""
    import numpy as np

    hashed = mixed(mixed(a.view(np.uint64)) * np.uint64(GOLDEN) + b.view(np.uint64)).view(np.int64)
    return np.where((a >= 0) & (b >= 0), a * width + b, hashed & -2 | -(1 << 63))


def _part(x, parts: int):
    """The part of each number."""
    import numpy as np

    return (mixed(x.view(np.uint64)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def _new(*sorted_columns):
    """Places where a run of equal rows begins."""
    import numpy as np

    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


def _kinds(schema: str) -> dict:
    """Arrow types by name."""
    import pyarrow as pa

    plain = {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    of = lambda t: pa.list_(plain[t[6:-1]]) if t.startswith("array<") else plain[t]
    return {name: of(t) for name, t in map(str.split, schema.split(", "))}


def _blocks(schema: str, single: dict, offsets, lists: dict):
    """Rows of blocks: `single` has a value per row, `lists` the entries of all rows; what is left out is null."""
    import pyarrow as pa

    columns, rows = [], len(offsets) - 1
    for name, kind in _kinds(schema).items():
        if name in single:
            columns.append(pa.array(single[name], kind))
        elif name in lists:
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lists[name], kind.value_type)))
        else:
            columns.append(pa.nulls(rows, kind))
    return pa.RecordBatch.from_arrays(columns, names=list(_kinds(schema)))


def _dealt(schema: str, part, single: dict, lists: dict):
    """A block for each part; entries keep their order."""
    import numpy as np

    order = np.argsort(part, kind="stable")
    part = part[order]
    at = _new(part)
    single = {"part": part[at]} | {name: np.full(len(at), value) for name, value in single.items()}
    return _blocks(schema, single, np.append(at, len(part)), {name: values[order] for name, values in lists.items()})


def _lengths(blocks, name: str):
    """Entries of each block."""
    import numpy as np
    import pyarrow.compute as pc

    return pc.fill_null(pc.list_value_length(blocks.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(blocks, name: str):
    return blocks.column(name).flatten().to_numpy(zero_copy_only=False)


PAIR_BLOCKS = "part int, a array<long>, b array<long>, n array<long>"


def pair_counts(training: DataFrame, keys, wide) -> DataFrame:
    """Codes `a` and `b`, and `n` of every pair of adjacent words in the training texts.

    Pairs are dealt by their first word, those whose first word is `wide` (by code) by both.
    """
    shared, width, parts = training.sparkSession.sparkContext.broadcast((keys, wide)), len(keys) + 1, shuffle_partitions(training)

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        keys, wide = shared.value

        def flushed():
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            key = _pair_keys(a, b, width)
            order = np.argsort(key)
            at = _new(key[order])
            a, b, n = a[order[at]], b[order[at]], np.diff(at, append=len(order))
            spread = (a >= 0) & wide[np.maximum(a, 0)]
            part = _part(np.where(spread, b ^ (a << 24), a), parts)
            return _dealt(PAIR_BLOCKS, part, {}, {"a": a, "b": b, "n": n})

        held, n = [], 0
        for batch in batches:
            codes, lengths = coded(batch.column(0), keys)
            held.append((_before(codes, lengths, width), codes))
            n += len(codes)
            if n >= CHUNK_TOKENS:
                yield flushed()
                held, n = [], 0
        if n:
            yield flushed()

    def added(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held = [[_flat(batch, c) for c in "abn"] for batch in batches]
        if held:
            a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            at = _new(a, b)
            found = a[at], b[at], np.add.reduceat(n[order], at)
            for i in range(0, len(at), ENTRIES_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ENTRIES_AT_ONCE], pa.int64()) for x in found], names=["a", "b", "n"])

    dealt = map_batches(training.select("text"), run, PAIR_BLOCKS).repartitionById(parts, F.col("part"))
    return map_batches(dealt, added, "a long, b long, n long")


def _pair_key(width: int) -> Column:
    """A key of the pair of codes `a`, `b`: their place in a table of coded words, else a hash, even and negative."""
    hashed = F.xxhash64("a", "b").bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(-(1 << 63)))
    return F.when((F.col("a") >= 0) & (F.col("b") >= 0), F.col("a") * width + F.col("b")).otherwise(hashed)


BLOCKS = (
    "kind byte, part int, chunk long, hi array<int>, lo array<int>, idx array<short>, n array<long>, "
    "x array<double>, y array<double>, a array<long>, b array<long>, held array<boolean>"
)


def _sent(kind: int, chunk: int, key, parts: int, lists: dict):
    """Blocks by part of the key. Keys are sorted and go in halves, of which the upper ones hardly take room."""
    import numpy as np

    order = np.argsort(key)
    key = key[order]
    lists = {name: values[order] for name, values in lists.items()} | {"hi": (key >> 32).astype(np.int32), "lo": key.astype(np.int32)}
    return _dealt(BLOCKS, _part(key, parts), {"kind": kind, "chunk": chunk}, lists)


def _keys(blocks):
    import numpy as np

    return _flat(blocks, "hi").astype(np.int64) << 32 | _flat(blocks, "lo").view(np.uint32).astype(np.int64)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written, as `written` does, and the shuffle files behind it removed: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return written(df, purpose, compression="zstd")
    finally:
        conf.set(CLEANUP, before)


class Katz:
    """A trained model: the two tables and the arrays for coded words and hot pairs."""

    def __init__(self, training: DataFrame, common: int = COMMON, coded: int = CODED):
        """`training` has a column `text`."""
        import numpy as np

        words = step(word_counts(training), "words")
        n_r, total, distinct = _counts_of_counts(words)
        discounts = good_turing(n_r)
        lost = sum(n * r * (1 - discounts[r - 1]) for r, n in n_r.items() if r <= LARGE)
        # Without a word seen but once or twice nothing is lost; one token is then set aside.
        lost, whole = (lost, total) if lost else (1.0, total + 1)
        unknown = lost / whole
        log_p = F.log10(_discounted(F.col("n"), discounts) / whole)
        #: key, n, and log10 of the probability over that of an unknown word.
        self.unigrams = words.select("key", "n", log_p.alias("log_p"))
        often = self.unigrams.orderBy(F.desc("n"), "key").limit(coded).toArrow().sort_by("key")
        keys, count, often_p = (often.column(c).to_numpy() for c in ("key", "n", "log_p"))
        width, starts = len(keys) + 1, training.count()
        self.pairs = step(pair_counts(training, keys, np.append(count * WIDE >= total, True)), "pairs")
        self.discounts = good_turing(_counts_of_counts(self.pairs)[0])
        # The start of text is a context, but no word.
        start = training.sparkSession.createDataFrame([(width - 1, starts)], "code long, n long").withColumn("log_p", F.lit(None).cast("double"))
        #: code, n, log_p, and what the word does as a context: log_alpha, log_share.
        self.words = step(self._contexts(self._known(keys).unionByName(start), 10**often_p), "contexts")
        log_alpha, log_share = np.zeros(width), np.zeros(width)
        found = self.words.where("code >= 0").select("code", "log_alpha", "log_share").toArrow()
        at = found.column("code").to_numpy()
        log_alpha[at], log_share[at] = found.column("log_alpha").to_numpy(), found.column("log_share").to_numpy()
        self.least = self._least_hot(total, common)
        hot = self.pairs.where(self._hot()).select(_pair_key(width).alias("pair"), F.log10(_discounted(F.col("n"), self.discounts)).alias("log_n")).toArrow().sort_by("pair")
        self.common = Common(
            keys, often_p, count, log_alpha, log_share, hot.column("pair").to_numpy(), hot.column("log_n").to_numpy(),
            total, distinct, math.log10(unknown),
        )

    def _least_hot(self, total: int, common: int) -> int:
        """The least count of a hot pair: one in `common` tokens, or as much more as `HOT_PAIRS` asks for."""
        least, pairs = max(-(-total // common), 1), 0
        counts = self.pairs.where(F.col("n") >= least).where("a >= 0 and b >= 0").groupBy("n").agg(F.count(F.lit(1)).alias("pairs"))
        for r in counts.orderBy(F.desc("n")).toLocalIterator():
            pairs += r["pairs"]
            if pairs > HOT_PAIRS:
                return r["n"] + 1
        return least

    def _hot(self) -> Column:
        return (F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("n") >= self.least)

    def _known(self, keys) -> DataFrame:
        """code, n and log_p of every word."""
        shared = self.unigrams.sparkSession.sparkContext.broadcast(keys)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                code = _coded(batch.column(0).to_numpy(), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), *batch.columns[1:]], names=["code", "n", "log_p"])

        return map_batches(self.unigrams, run, "code long, n long, log_p double", ENTRIES_AT_ONCE)

    def _contexts(self, known: DataFrame, coded_p) -> DataFrame:
        """`known` (code, n, log_p) with log_alpha and log_share; both 0 for a word that nothing follows."""
        shared = known.sparkSession.sparkContext.broadcast(coded_p)

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(shared.value[batch.column(1).to_numpy()])], names=["a", "n", "p"])

        # What follows is a coded word for a large part of the pairs: no join for these.
        usual = map_batches(self.pairs.where("b >= 0"), run, "a long, n long, p double", ENTRIES_AT_ONCE)
        second = known.where("code < 0").select(F.col("code").alias("b"), F.pow(F.lit(10.0), "log_p").alias("p"))
        rare = self.pairs.where("b < 0").join(second, "b").select("a", "n", "p")
        mass = _discounted(F.col("n"), self.discounts)
        sums = usual.unionByName(rare).groupBy("a").agg(F.sum(mass).alias("mass"), F.sum("p").alias("low")).withColumnRenamed("a", "code")
        # Without training texts the start has been seen no times.
        times = F.nullif(F.col("n"), F.lit(0))
        seen = F.col("mass") / times
        # Something is always left for what hasn't been seen: at least one occurrence's worth.
        scale = F.when(seen.isNotNull(), F.least(F.lit(1.0), times / (times + 1) / seen))
        alpha = F.log10((1 - scale * seen) / (1 - F.col("low")))
        return known.join(sums, "code", "left").select(
            "code", "n", "log_p", F.coalesce(alpha, F.lit(0.0)).alias("log_alpha"), F.coalesce(F.log10(scale / times), F.lit(0.0)).alias("log_share")
        )

    @property
    def bigrams(self) -> DataFrame:
        """pair, a, b, n, and log10 of its probability over the backed-off one."""
        first = self.words.select(F.col("code").alias("a"), "log_alpha", "log_share")
        second = self.words.where("log_p is not null").select(F.col("code").alias("b"), "log_p")
        delta = F.log10(_discounted(F.col("n"), self.discounts)) + F.col("log_share") - F.col("log_alpha") - F.col("log_p")
        return self.pairs.join(first, "a").join(second, "b").select(_pair_key(self.common.width).alias("pair"), "a", "b", "n", delta.alias("delta"))

    def _entries(self, parts: int) -> DataFrame:
        """Blocks of what texts look up: of rarer words n and log_share (`x`), of pairs that aren't hot n."""
        width = self.common.width

        def run(batches: Iterator) -> Iterator:
            import numpy as np

            def flushed():
                a, b, n, x = (np.concatenate(c) for c in zip(*held, strict=True))
                is_word = b == 0
                for these, key in ((is_word, a[is_word]), (~is_word, _pair_keys(a[~is_word], b[~is_word] - (b[~is_word] > 0), width))):
                    if len(key):
                        lists = {"n": n[these]} | ({"x": x[these]} if these is is_word else {})
                        yield _sent(ENTRY, 0, key, parts, lists)

            held, rows = [], 0
            for batch in batches:
                held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
                rows += len(batch)
                if rows >= ENTRIES_AT_ONCE:
                    yield from flushed()
                    held, rows = [], 0
            if rows:
                yield from flushed()

        # A word comes with b 0, the codes of second words from 1 on.
        words = self.words.where("code < 0").select(F.col("code").alias("a"), F.lit(0).cast("long").alias("b"), "n", F.col("log_share").alias("x"))
        pairs = self.pairs.where(~self._hot()).select("a", F.when(F.col("b") < 0, F.col("b")).otherwise(F.col("b") + 1).alias("b"), "n", F.lit(0.0).alias("x"))
        return map_batches(words.unionByName(pairs), run, BLOCKS, ENTRIES_AT_ONCE)

    def _backed_off(self, texts: DataFrame) -> DataFrame:
        """`row` and what the pairs not seen add to its score: alpha(a) P(b) each, in place of a's share."""
        ends = F.array(*(F.struct(F.col(f"m.{c}").alias("code"), F.lit(c == "b").alias("last")) for c in "ab"))
        missed = texts.select("row", F.explode("missed").alias("m")).select("row", F.explode(ends).alias("e")).select("row", "e.*")
        hit = missed.join(with_own_shuffle(self.words), "code", "left")
        first = F.coalesce(F.col("log_alpha") - F.col("log_share"), F.lit(0.0))
        adds = F.when(F.col("last"), F.coalesce("log_p", F.lit(self.common.unknown))).otherwise(first)
        return hit.groupBy("row").agg(F.sum(adds).alias("backed_off"))

    def _asked(self, docs: DataFrame, parts: int) -> DataFrame:
        """Blocks of every chunk of texts: what the texts have of their own, and the words and pairs they look up."""
        shared = docs.sparkSession.sparkContext.broadcast(self.common)

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            m = shared.value
            width, chunk = m.width, TaskContext.get().partitionId() << 40
            base_of_none = -math.log10(m.n_tokens + m.n_words + 1)
            base_of = np.log10(m.count + 1.0)

            def flushed():
                codes, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
                ids = pa.concat_arrays([b.column(0) for b in told])
                open_ = pa.concat_arrays([b.column(2) for b in told]).to_numpy(zero_copy_only=False).astype(bool)
                n, idx, before = len(lengths), np.repeat(np.arange(len(lengths), dtype=np.int16), lengths), _before(codes, lengths, width)
                added = lambda at, values: np.bincount(idx[at], values, n)
                common, after = np.flatnonzero(codes >= 0), np.flatnonzero(before >= 0)
                base = added(common, base_of[codes[common]]) + base_of_none * lengths
                score = added(after, m.log_share[before[after]])
                key, rest = _pair_keys(before, codes, width), np.ones(len(codes), bool)
                if len(m.pairs):
                    both = np.flatnonzero(key >= 0)
                    at = np.minimum(np.searchsorted(m.pairs, key[both]), len(m.pairs) - 1)
                    is_hot = m.pairs[at] == key[both]
                    hot = both[is_hot]
                    score += added(hot, m.log_n[at[is_hot]])
                    rest[hot] = False
                known = np.bincount(idx[common], minlength=n)
                own = {"a": ids, "n": lengths, "b": known, "x": base, "y": score, "held": open_}
                yield _blocks(BLOCKS, {"kind": [OWN], "part": _part(np.array([chunk]), parts), "chunk": [chunk]}, [0, n], own)
                for kind, these in ((WORD, codes < 0), (TRAINED, rest & ~open_[idx]), (HELD_OUT, rest & open_[idx])):
                    at = np.flatnonzero(these)
                    if not len(at):
                        continue
                    lists = {"idx": idx[at]}
                    if kind == HELD_OUT:  # A pair's key shows its codes only where both are small.
                        hashed = key[at] < 0
                        lists |= {"a": np.where(hashed, before[at], 0), "b": np.where(hashed, codes[at], 0)}
                    yield _sent(kind, chunk, codes[at] if kind == WORD else key[at], parts, lists)

            held, told, size, texts = [], [], 0, 0
            for batch in batches:
                held.append(coded(batch.column(1), m.keys))
                told.append(batch)
                size, texts = size + len(held[-1][0]), texts + len(batch)
                if size >= CHUNK_TOKENS or texts >= CHUNK_TEXTS:
                    yield from flushed()
                    chunk += texts
                    held, told, size, texts = [], [], 0, 0
            if texts:
                yield from flushed()

        return map_batches(docs.select(F.col("id").cast("long"), "text", "held_out"), run, BLOCKS)

    def scores(self, docs: DataFrame) -> DataFrame:
        """`id`, `held_out`, `n_tokens`, `n_known`, `base_score` and `score` for rows of `id`, `text`, `held_out`."""
        parts, width, discounts = shuffle_partitions(docs), self.common.width, [1.0, *self.discounts]

        def look_up(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            entries, asks = [], []
            for batch in batches:
                kinds = batch.column("kind").to_numpy()
                for kind in np.unique(kinds):
                    some = batch.filter(pa.array(kinds == kind))
                    if kind == OWN:
                        yield some
                    elif kind == ENTRY:
                        # Blocks of words have an x, those of pairs none.
                        n = _flat(some, "n")
                        has_x = np.repeat(some.column("x").is_valid().to_numpy(zero_copy_only=False), _lengths(some, "n"))
                        x = np.zeros(len(n))
                        x[has_x] = _flat(some, "x")
                        entries.append((_keys(some), n, x))
                    else:
                        asks.append((kind, some))
            keys, n, x = (np.concatenate([e[i] for e in entries] or [np.zeros(0, np.int64)]) for i in range(3))
            order = np.argsort(keys)
            keys, n, x = keys[order], n[order], x[order]
            for kind, some in asks:
                key = _keys(some)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1) if len(keys) else np.zeros(len(key), np.int64)
                hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
                found, idx, chunk = np.zeros(len(key), np.int64), _flat(some, "idx"), some.column("chunk").to_numpy()
                found[hit] = n[at[hit]]
                each = _lengths(some, "idx")
                offsets = np.append(0, np.cumsum(each))
                lists = {"idx": idx, "n": found}
                if kind == WORD:
                    lists["x"] = np.zeros(len(key))
                    lists["x"][hit] = x[at[hit]]
                yield _blocks(BLOCKS, {"kind": np.full(len(each), kind), "chunk": chunk}, offsets, lists)
                if kind == HELD_OUT and not hit.all():
                    a, b = (np.where(key < 0, _flat(some, c), shown) for c, shown in (("a", key // width), ("b", key % width)))
                    of_block = np.repeat(np.arange(len(each)), each)[~hit]
                    offsets = np.append(0, np.cumsum(np.bincount(of_block, minlength=len(each))))
                    yield _blocks(BLOCKS, {"kind": np.full(len(each), MISSED), "chunk": chunk}, offsets, {"idx": idx[~hit], "a": a[~hit], "b": b[~hit]})

        def summed(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            most, share, chunks = 1 << 15, np.array(discounts), {}
            for batch in batches:
                for i in range(len(batch)):
                    block = batch.slice(i, 1)
                    kind, chunk = block.column("kind")[0].as_py(), block.column("chunk")[0].as_py()
                    here = chunks.setdefault(chunk, {"known": np.zeros(most, np.int64), "base": np.zeros(most), "score": np.zeros(most), "missed": []})
                    if kind == OWN:
                        here["own"] = block
                        continue
                    idx = _flat(block, "idx")
                    if kind == MISSED:
                        here["missed"].append((idx, _flat(block, "a"), _flat(block, "b")))
                        continue
                    n = _flat(block, "n")
                    idx, n = idx[n > 0], n[n > 0]
                    if kind == WORD:
                        here["known"] += np.bincount(idx, minlength=most)
                        here["base"] += np.bincount(idx, np.log10(n + 1.0), most)
                        here["score"] += np.bincount(idx, _flat(block, "x")[_flat(block, "n") > 0], most)
                    else:
                        here["score"] += np.bincount(idx, np.log10(n * np.where(n <= LARGE, share[np.minimum(n, LARGE)], 1.0)), most)
            for chunk, here in chunks.items():
                own, n = here["own"], len(_flat(here["own"], "n"))
                idx, a, b = (np.concatenate(x) for x in zip(*here["missed"], strict=True)) if here["missed"] else [np.zeros(0, np.int64)] * 3
                order = np.argsort(idx, kind="stable")
                pairs = pa.StructArray.from_arrays([pa.array(a[order], pa.int64()), pa.array(b[order], pa.int64())], names=["a", "b"])
                missed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(idx, minlength=n))), pa.int32()), pairs)
                columns = [pa.array(chunk + np.arange(n), pa.int64()), own.column("a").flatten(), own.column("held").flatten(), own.column("n").flatten()]
                columns.append(pa.array(_flat(own, "b") + here["known"][:n], pa.int64()))
                columns += [pa.array(_flat(own, x) + here[c][:n], pa.float64()) for x, c in (("x", "base"), ("y", "score"))]
                yield pa.RecordBatch.from_arrays([*columns, missed], names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "missed"])

        met = self._asked(docs, parts).unionByName(self._entries(parts)).repartitionById(parts, F.col("part"))
        answers = map_batches(met, look_up, BLOCKS).repartition(parts, "chunk")
        scored = "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, missed array<struct<a: long, b: long>>"
        texts = step(map_batches(answers, summed, scored), "texts")
        score = F.col("score") + F.coalesce("backed_off", F.lit(0.0))
        return texts.join(self._backed_off(texts), "row", "left").withColumn("score", score).drop("row", "missed", "backed_off")


def held_out(row: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(row.cast("string").cast("binary")) % folds == fold, F.lit(False))


def corpus_scores(docs: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the documents that aren't held out and score all."""
    parted = docs.select(F.col(row).alias("id"), F.col(text).alias("text"), held_out(F.col(row)).alias("held_out"))
    model = Katz(parted.where(~F.col("held_out")))
    scored = model.scores(parted).withColumn("train_tokens", F.lit(model.common.n_tokens).cast("long"))
    return scored.withColumnRenamed("id", row)
