"""Document fingerprints by consistent weighted sampling.

A document is a multiset of shingles of five words; the weight of a shingle is how often
it occurs. The word sequence is led by four empty words, so that short texts have a
shingle per word too. For each of `SAMPLES` seeds every shingle gets, from its hash
alone, r and c drawn from Gamma(2, 1) and b from the uniform distribution:

    t = floor(ln(weight) / r + b),   ln a = ln c - r * (t - b + 1)

The shingle with the least a and its t are the sample. Two documents agree in a sample
with a probability equal to their generalised Jaccard similarity (sum of the lesser
weights over sum of the greater), so the share of equal samples estimates it.

The neighbour of a document, by descending id, may be far away in the input. Documents
are dealt by ranges of the id and sorted there; each range gets a copy of the first
document of the next one, so that a task sees every neighbour while it holds two texts.

Defined results: a null or empty text, or one of white space only, has no shingle and a
fingerprint of zeros, alike to another such. Null ids come last, equal ids by the hash of
their text; a document alone is its own neighbour. Repeated rows are all returned. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, shuffle_partitions
from .shingling import GOLDEN, hashed, mixed, runs, word_hashes, word_hashes_of

SHINGLE = 5
SAMPLES = 64
#: Shingles worked on together, so that the arrays stay in a core's cache.
TOGETHER = 512
#: Odd multipliers of the 32-bit mixing function.
MIX_3, MIX_4, MIX_5 = 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F
EMPTY = "0" * (4 * SAMPLES)


def shingles(words):
    """Sorted hashes of the distinct shingles of a text, and how often each occurs; from the hashes of its words."""
    import numpy as np

    return np.unique(runs(np.concatenate([np.zeros(SHINGLE - 1, np.uint64), words]), SHINGLE), return_counts=True)


def draws(hashes):
    """For shingles: r, b and ln c of every sample, as arrays of (shingles, samples)."""
    import numpy as np

    low, high = hashes.astype(np.uint32).reshape(-1, 1), (hashes >> np.uint64(32)).astype(np.uint32).reshape(-1, 1)
    seeds = mixed(np.arange(1, 5 * SAMPLES + 1, dtype=np.uint64)).astype(np.uint32).reshape(5, 1, SAMPLES)

    x, shifted = np.empty((2, len(hashes), SAMPLES), np.uint32)

    def bits(i):
        """24 bits of a 32-bit mix of hash and seed, and a half: 2 ** 24 times a number in (0, 1)."""
        np.bitwise_xor(low, seeds[i], out=x)
        np.multiply(x, np.uint32(MIX_3), out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint32(15), out=shifted), out=x)
        np.add(x, high, out=x)
        np.multiply(x, np.uint32(MIX_4), out=x)
        np.bitwise_xor(x, np.right_shift(x, np.uint32(16), out=shifted), out=x)
        np.multiply(x, np.uint32(MIX_5), out=x)
        np.right_shift(x, np.uint32(8), out=x)
        u = x.view(np.int32).astype(np.float32)
        u += np.float32(0.5)
        return u

    def minus_log(i):
        """- ln of the product of two numbers; the powers of two change no digit."""
        u = bits(i)
        u *= bits(i + 1)
        u *= np.float32(2.0**-48)
        return np.negative(np.log(u, out=u), out=u)

    r, ln_c, b = minus_log(0), minus_log(2), bits(4)
    b *= np.float32(2.0**-24)
    return r, b, np.log(ln_c, out=ln_c)


def scores(hashes, weights):
    """ln a of every shingle and sample, and t where a weight is above 1 (else None: all 0)."""
    import numpy as np

    a, t = np.empty((len(hashes), SAMPLES), np.float32), None
    for i in range(0, len(hashes), TOGETHER):
        here = slice(i, i + TOGETHER)
        r, b, ln_c = draws(hashes[here])
        step = 1 - b
        if (weights[here] > 1).any():
            t = np.zeros_like(a) if t is None else t
            t[here] = np.floor(np.log(weights[here].astype(np.float32)).reshape(-1, 1) / r + b)
            step += t[here]
        step *= r
        np.subtract(ln_c, step, out=a[here])
    return a, t


class Document:
    """A text with its words, its shingles, their scores and its samples."""

    def __init__(self, text: str | None, words=None, like: tuple[Document, ...] = ()):
        """`words`: hashes of the words, if known. `like`: documents that have most of the shingles; their scores are used again."""
        import numpy as np

        self.text = text or ""
        self.words = word_hashes(self.text) if words is None else words
        self.hashes, self.weights = shingles(self.words)
        self.a = self.samples = None
        if not len(self.hashes):
            return
        t, new = None, np.ones(len(self.hashes), bool)
        for other in like:
            if not len(other.hashes):
                continue
            at = np.minimum(np.searchsorted(other.hashes, self.hashes), len(other.hashes) - 1)
            known = new & (other.hashes[at] == self.hashes) & (self.weights == 1) & (other.weights[at] == 1)
            if self.a is None:
                self.a = other.a[at]
            else:
                self.a[known] = other.a[at[known]]
            new &= ~known
        if self.a is None:
            self.a, t = scores(self.hashes, self.weights)
        elif new.any():
            self.a[new], steps = scores(self.hashes[new], self.weights[new])
            if steps is not None:
                t = np.zeros_like(self.a)
                t[new] = steps
        least = self.a.argmin(axis=0)
        steps = np.uint64(0) if t is None else t[least, np.arange(SAMPLES)].astype(np.uint64) * np.uint64(GOLDEN)
        #: 16-bit codes of the chosen shingle and its t.
        self.samples = (mixed(self.hashes[least] + steps) >> np.uint64(48)).astype(np.uint16)

    def fingerprint(self) -> str:
        return EMPTY if self.samples is None else self.samples.astype(">u2").tobytes().hex()

    def likeness(self, other: Document) -> float:
        if self.samples is None or other.samples is None:
            return float(self.samples is other.samples)
        return float((self.samples == other.samples).mean())

    def edited(self, following: Document) -> Document:
        """The last third of the text replaced by the start of the next one's."""
        import numpy as np

        third = len(self.text) // 3
        kept, start = self.text[: len(self.text) - third], following.text[:third]
        parts = [t.encode("utf-8", "surrogatepass") for t in (kept, start)]
        left, right = (t.split() for t in parts)
        # Words are as they were but where the texts meet and at the end: these are hashed anew.
        meeting, last = [*left[-1:], *right[:1]], right[1:][-1:]
        if left and right and not parts[0][-1:].isspace() and not parts[1][:1].isspace():
            meeting = [left[-1] + right[0]]
        new = hashed([w.lower() for w in meeting + last])
        words = np.concatenate([self.words[: max(len(left) - 1, 0)], new[: len(meeting)], following.words[1 : max(len(right) - 1, 1)], new[len(meeting) :]])
        return Document(kept + start, words, (self, following))


def likeness(one: str, other: str) -> float:
    """Share of equal samples of two fingerprints."""
    return sum(one[i : i + 4] == other[i : i + 4] for i in range(0, len(one), 4)) / SAMPLES


def fingerprints(docs: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` and `fingerprint` of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            words = word_hashes_of(batch.column(1))
            prints = [Document(t, w).fingerprint() for t, w in zip(batch.column(1).to_pylist(), words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["row", "fingerprint"])

    kind = dict(docs.dtypes)[row]
    got = map_batches(docs.select(F.col(row).alias("row"), F.col(text).alias("text")), run, f"row {kind}, fingerprint string")
    return got.withColumnRenamed("row", row)


def with_neighbour(docs: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents dealt so that within a partition each row is followed by its neighbour.

    Columns `id`, `text`, `guest`; a guest row is there for the row before it only. Ranges
    are cut at quantiles of the ids; null ids, which no cut parts, by the hash of their text.
    """
    parts = shuffle_partitions(docs)
    plain = docs.select(F.col(row).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    at = [i / parts for i in range(1, parts)] or [0.5]
    cut = plain.agg(F.percentile_approx("id", at, 100 * parts).alias("cut")).first()["cut"] or []
    cuts = F.array(*(F.lit(c) for c in sorted(set(cut), reverse=True))).cast("array<bigint>")
    by_id = F.size(F.filter(cuts, lambda c: c > F.col("id")))
    by_hash = parts + F.floor((F.lit(0.5) - F.col("h") / F.lit(2.0**64)) * parts).cast("int")
    dealt = plain.withColumn("range", F.when(F.col("id").isNull(), by_hash).otherwise(by_id))
    # The first document of each range: as many rows as ranges.
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "h")
    heads = sorted(dealt.groupBy("range").agg(F.max(order).alias("top")).collect(), key=lambda r: r["range"])
    if not heads:
        return dealt.select("id", "text", F.lit(False).alias("guest"))
    host = [(here["range"], there["top"]["id"], there["top"]["h"]) for here, there in zip(heads, heads[1:] + heads[:1], strict=True)]
    wanted = docs.sparkSession.createDataFrame(host, "range int, id long, h long")
    guests = (
        plain.join(F.broadcast(wanted), plain["id"].eqNullSafe(wanted["id"]) & (plain["h"] == wanted["h"]))
        .select(wanted["range"], plain["id"], "text", plain["h"])
        .dropDuplicates(["range"])
    )
    both = dealt.select("range", "id", "text", "h", F.lit(False).alias("guest")).unionByName(guests.withColumn("guest", F.lit(True)))
    both = both.repartitionById(2 * parts + 1, F.col("range"))
    return both.sortWithinPartitions("guest", F.desc_nulls_last("id"), F.desc("h")).select("id", "text", "guest")


EDITS = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_likeness(docs: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last_id, last = None, None
        for batch in batches:
            out = []
            words = word_hashes_of(batch.column("text"))
            for row_id, body, guest, known in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "guest")), words, strict=True):
                here = Document(body, known)
                if last is not None:
                    edited = last.edited(here)
                    digest = hashlib.sha256(edited.text.encode()).hexdigest()
                    prints = last.fingerprint(), edited.fingerprint()
                    out.append((last_id, len(last.text), digest, *prints, last.likeness(edited), last.likeness(here)))
                last_id, last = row_id, None if guest else here
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in EDITS.split(", ")])

    return map_batches(with_neighbour(docs, row, text), run, EDITS).withColumnRenamed("id", row)
