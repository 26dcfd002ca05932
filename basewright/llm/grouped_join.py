"""Similarity join of documents by the Jaccard similarity of their word n-grams: grouped prefix join.

A document is the set of its distinct word shingles (as 64-bit hashes). Two link when
their similarity is at least the threshold. The steps:

1. Documents with equal sets collapse into one node.
2. Shingles get one order for all documents, frequent ones last. Frequency is counted for
   `SKETCH` buckets of hashes over all documents, an array of fixed size; any order gives
   the same links, this one keeps common passages out of the prefixes.
3. A node's prefix is its first n - ceil(t n) + 1 shingles: linked nodes share a shingle of
   their prefixes. Nodes with the same prefix and size form a group.
4. Groups that share a prefix shingle become candidates if their sizes and the positions of
   the shingle allow the similarity; only then are they expanded and members verified,
   by a bit map of each set that rules out most, then by the whole sets of the rest.

A group of n near copies has n^2 / 2 links, which are not written out. First each group is
verified against one other per shingle and size class, the first there (a star). Nodes
joined so far form components, and only nodes of different components are compared
afterwards: every link lies inside a component of the result. While comparing all of them would
take many more pairs than there are nodes, and stars still lessen them by half, further stars are tried first, each with
other centres; a node leaves as soon as one link ties it to the component that the others are in. In the end
all pairs that are left are compared.

Defined results: a null or empty text, or one without words, has no shingles and links with
nothing. Ids are any whole numbers of 64 bits. Rows with the same id are one document; rows with a null id link by their text and have
a component only if they link to a document with an id. Empty tables give empty results.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import with_own_shuffle
from ..sinks.shared import written
from .components import components
from .frames import apart, map_batches, together
from .shingling import runs, word_hashes

SKETCH = 1 << 16
#: Similarities are whole hundredths, so that no rounding decides.
OF = 100
#: Above all real ids: nodes of documents without one. They take a wider type, which nodes have only if there are some.
NO_ID = 1 << 63
NAMED, ANY = "long", "decimal(20,0)"
#: All pairs are few if they are not more than this, or than so many for each posting.
FEW_PAIRS, PAIRS_PER_POSTING = 100_000_000, 8


@dataclass(frozen=True)
class Near:
    """What links: words in a shingle, and the least Jaccard similarity in hundredths."""

    words: int = 5
    hundredths: int = 80


def shingle_set(text: str | None, size: int):
    """Sorted hashes of the distinct shingles; with fewer words than a shingle has, of all words as one."""
    import numpy as np

    words = word_hashes(text)
    if 0 < len(words) < size:
        return runs(words, len(words))
    return np.unique(runs(words, size))


def bucket_counts(docs: DataFrame, near: Near) -> DataFrame:
    """`bucket`, `n`: shingles of all documents per bucket of hashes. At most SKETCH rows a task and in all."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += np.bincount((shingle_set(text, near.words) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], names=["bucket", "n"])

    return map_batches(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def heat(docs: DataFrame, near: Near):
    """Per bucket a class of frequency, 0 for ordinary ones: SKETCH bytes.

    Ordinary buckets vary around the mean by its root; a bucket that holds a frequent
    shingle stands out by that shingle's frequency.
    """
    import numpy as np

    n = np.zeros(SKETCH)
    for r in bucket_counts(docs, near).toLocalIterator():
        n[r["bucket"]] = r["n"]
    usual = max(np.median(n), 1.0)
    return np.log2(1 + np.maximum(n - usual, 0) / (4 * usual**0.5)).astype(np.uint8)


def parity_bits(found):
    """A bit per place that an odd number of shingles fall on, as 64-bit words; about one place a shingle.

    Each shingle that only one of two sets has flips one bit, so the sets differ in at least
    as many shingles as the bits differ in places. Halves combined by exclusive or are the bits
    over half as many places.
    """
    import numpy as np

    places = max(64, (1 << len(found).bit_length()) >> 1)
    odd = np.bincount(((found >> np.uint64(24)) % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def least_overlap(a: Column, b: Column, near: Near) -> Column:
    """The least intersection of sets of sizes a and b that links them."""
    # In whole numbers: the ceiling of t (a + b) / (1 + t).
    top, bottom = (a + b) * near.hundredths, OF + near.hundredths
    return F.floor((top + bottom - 1) / bottom)


def prefixes(docs: DataFrame, near: Near) -> DataFrame:
    """`id`, `n`, `k1`, `k2` (a 128-bit digest of the set), `prefix` and `bits` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(heat(docs, near))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        hot = shared.value
        for batch in batches:
            size, k1, k2, prefix, bits = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, near.words)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                order = np.argsort(hot[(found % np.uint64(SKETCH)).astype(np.int64)], kind="stable")
                length = len(found) - -(-near.hundredths * len(found) // OF) + 1 if len(found) else 0
                size.append(len(found))
                k1.append(int(digest[0]))
                k2.append(int(digest[1]))
                prefix.append(found[order[:length]].view(np.int64))
                bits.append(parity_bits(found))
            arrays = [batch.column(0), pa.array(size, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())]
            arrays += [pa.array(x, pa.list_(pa.int64())) for x in (prefix, bits)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "k1", "k2", "prefix", "bits"])

    return map_batches(docs.select("id", "text"), run, "id long, n int, k1 long, k2 long, prefix array<long>, bits array<long>")


def _no_id() -> Column:
    return F.lit(Decimal(NO_ID)).cast(ANY)


def _node(row: Column, k1: Column, kind: str) -> Column:
    """The id, or for documents without one a number above all ids."""
    return row if kind == NAMED else F.coalesce(row.cast(ANY), (_no_id() + F.shiftrightunsigned(k1, 2).cast(ANY)).cast(ANY))


def _named(node: Column, kind: str) -> Column:
    return F.lit(True) if kind == NAMED else node < _no_id()


def sets_of(docs: DataFrame, nodes: DataFrame, near: Near, kind: str) -> DataFrame:
    """`node` and `set` of the given nodes (a column `node`), one row each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingle_set(t, near.words) for t in batch.column(1).to_pylist()]
            k1 = [int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0]) for s in sets]
            values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, pa.int64()), values], names=["id", "k1", "set"])

    wanted = nodes.select(F.when(_named(F.col("node"), kind), F.col("node")).cast("long").alias("id"), "node")
    held = docs.join(wanted.select("id").distinct(), docs["id"].eqNullSafe(wanted["id"]), "left_semi")
    found = map_batches(held.select("id", "text"), run, "id long, k1 long, set array<long>")
    found = found.select(_node(F.col("id"), F.col("k1"), kind).alias("node"), "set")
    return found.join(nodes.select("node"), "node", "left_semi").distinct()


def linked(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (`a`, `b`) whose sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - common
    return both.where(OF * common >= near.hundredths * either).select("a", "b").distinct()


def _size_class(n: Column, near: Near) -> Column:
    """Sizes whose ratio is within the threshold are at most one class apart."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(OF / near.hundredths))).cast("int")


def _postings(groups: DataFrame, *more: str) -> DataFrame:
    """A row per group and shingle of its prefix."""
    return groups.select("lead", "n", *more, F.posexplode("prefix").alias("pos", "token"))


def _possible(n: Column, pos: Column, m: Column, at: Column, near: Near) -> Column:
    """Whether sizes, and the positions of a first common shingle, allow a link."""
    sizes = OF * F.least(n, m) >= near.hundredths * F.greatest(n, m)
    return sizes & (F.least(n - pos, m - at) >= least_overlap(n, m, near))


def star_pairs(nodes: DataFrame, groups: DataFrame, near: Near) -> DataFrame:
    """Each group against the first group of each shingle and size class, each member against its group's first."""
    postings = _postings(groups).withColumn("class", _size_class(F.col("n"), near))
    first = F.min(F.struct("lead", F.col("n").alias("m"), F.col("pos").alias("at"))).alias("first")
    pivots = postings.groupBy("token", "class").agg(first, F.count(F.lit(1)).alias("size")).where("size > 1").select("token", "class", "first.*")
    pivots = pivots.withColumnRenamed("lead", "b")
    found = postings.join(with_own_shuffle(pivots), ["token", "class"]).where("lead > b")
    found = found.where(_possible(F.col("n"), F.col("pos"), F.col("m"), F.col("at"), near)).select(F.col("lead").alias("a"), "b")
    shared = groups.where("members > 1").select("g", "lead")
    inside = nodes.join(with_own_shuffle(shared), "g").where("node > lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return found.unionByName(inside).distinct()


def open_entries(nodes: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of nodes with a `component`, and their postings of shingles that several components have.

    Members of one group and component are one entry.
    """
    entries = written(nodes.groupBy("g", "n", "component").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members")), "entries")
    postings = _postings(entries.join(with_own_shuffle(groups.select("g", "n", "prefix")), ["g", "n"]), "component", "members")
    mixed = postings.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("token")
    live = postings.join(with_own_shuffle(mixed), "token", "left_semi").select("token", "pos", "n", "lead", "component", "members")
    return entries.drop("members"), written(live, "postings")


def pairs_to_come(live: DataFrame) -> tuple[int, int]:
    """How many pairs of nodes in different components meet at a shingle, and how many postings of nodes there are."""
    per = live.groupBy("token", "component").agg(F.sum("members").cast("double").alias("c"))
    of_token = per.groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    got = of_token.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs"), F.sum("s").alias("postings")).first()
    return int(got["pairs"] or 0), int(got["postings"] or 0)


def another_star(live: DataFrame, near: Near, turn: int) -> DataFrame:
    """Pairs of entries of different components, by a member each: every entry with one other per shingle and size class, drawn anew each turn."""
    at = live.withColumn("class", _size_class(F.col("n"), near))
    drawn = F.struct(F.xxhash64("lead", F.lit(turn)).alias("draw"), *(F.col(c).alias(f"{c}_b") for c in ("lead", "n", "pos", "component")))
    centres = at.groupBy("token", "class").agg(F.min(drawn).alias("centre")).select("token", "class", "centre.*").drop("draw")
    found = at.join(with_own_shuffle(centres), ["token", "class"]).where(F.col("component") != F.col("component_b"))
    return found.where(_possible(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), near)).select(F.col("lead").alias("a"), F.col("lead_b").alias("b")).distinct()


def all_pairs(live: DataFrame, near: Near) -> DataFrame:
    """All pairs of entries of different components that prefix, sizes and positions leave possible."""
    one, other = (live.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("pos", "n", "lead", "component"))) for x in "ab")
    met = (F.col("lead_a") > F.col("lead_b")) & (F.col("component_a") != F.col("component_b"))
    possible = _possible(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"), near)
    return one.join(other, "token").where(met & possible).select(F.col("lead_a").alias("lead"), F.col("lead_b")).distinct()


def of_members(pairs: DataFrame, nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs of entries as pairs of their members."""
    members = nodes.select("g", "n", "component", "node").join(entries, ["g", "n", "component"]).select("lead", "node")
    left, right = members.select("lead", F.col("node").alias("a")), members.select(F.col("lead").alias("lead_b"), F.col("node").alias("b"))
    return pairs.join(left, "lead").join(right, "lead_b").select("a", "b").distinct()


def _fold(bits: Column, places: Column) -> Column:
    """`bits` over `places` words: as they are, or with one half laid on the other."""
    half = F.zip_with(F.slice(bits, F.lit(1), places), F.slice(bits, places + 1, places), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > places, half).otherwise(bits)


def not_too_different(pairs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """The pairs whose bits differ in no more places than linked sets may differ in shingles."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    places = F.least(F.size("bits_a"), F.size("bits_b"))
    # Sizes of a possible pair differ by less than a factor of two, the words by one halving at most.
    differ = F.zip_with(_fold(F.col("bits_a"), places), _fold(F.col("bits_b"), places), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    n = F.col("n_a") + F.col("n_b")
    allowed = n - 2 * least_overlap(F.col("n_a"), F.col("n_b"), near)
    return both.where(F.aggregate(differ, F.lit(0), lambda total, x: total + x) <= allowed).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, near: Near, kind: str) -> DataFrame:
    """The pairs that are links: first by their bits, then what passes by the whole sets."""
    pairs = written(not_too_different(pairs, nodes, near), "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return written(linked(pairs, written(sets_of(docs, written(ends, "ends"), near, kind), "sets"), near), "links")


def _components_of(docs: DataFrame, near: Near, row: str, text: str) -> tuple[DataFrame, DataFrame, str]:
    """`prefixes` of every document, the `component` (a node) of every set (`k1`, `k2`), and the type of nodes."""
    plain = docs.select(F.col(row).cast("long").alias("id"), F.col(text).alias("text"))
    every = written(prefixes(plain, near), "prefixes")
    kind = NAMED if every.where("id IS NULL AND n > 0").isEmpty() else ANY
    nodes = every.where("n > 0").groupBy("k1", "k2", "n", "prefix", "bits").agg(F.min("id").alias("id"))
    nodes = nodes.select("k1", "k2", "n", "prefix", "bits", _node(F.col("id"), F.col("k1"), kind).alias("node"), F.xxhash64("n", "prefix").alias("g"))
    nodes = written(nodes, "nodes")
    groups = written(nodes.groupBy("g", "n", "prefix").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members")), "groups")
    links = _verified(star_pairs(nodes, groups, near), nodes, plain, near, kind)
    turn, before = 0, float("inf")
    while True:
        labelled = nodes.select("node", "g", "n").join(with_own_shuffle(components(links)), "node", "left")
        labelled = written(labelled.withColumn("component", F.coalesce("component", "node")), "labelled")
        entries, live = open_entries(labelled, groups)
        pairs, postings = pairs_to_come(live)
        if pairs <= max(FEW_PAIRS, PAIRS_PER_POSTING * postings) or 2 * pairs > before:
            break
        links = links.unionByName(_verified(another_star(live, near, turn), nodes, plain, near, kind))
        turn, before = turn + 1, pairs
    more = _verified(of_members(all_pairs(live, near), labelled, entries), nodes, plain, near, kind)
    labels = components(links.unionByName(more))
    return every, nodes.join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component")), kind


def joined(docs: DataFrame, near: Near, row: str = "doc_id", text: str = "text") -> DataFrame:
    """`row`, `n_shingles` and `component_id` (the least id reachable by links) of every document."""
    return _with_component(*_components_of(docs, near, row, text), row)


def _with_component(every: DataFrame, final: DataFrame, kind: str, row: str) -> DataFrame:
    back = every.select("id", "n", "k1", "k2").join(with_own_shuffle(final), ["k1", "k2"], "left")
    real = F.when(_named(F.col("component"), kind), F.col("component")).cast("long")
    return back.select(F.col("id").alias(row), F.col("n").cast("long").alias("n_shingles"), F.coalesce(real, F.col("id")).alias("component_id"))


def _one_without_id(docs: DataFrame, final: DataFrame, near: Near, text: str) -> DataFrame:
    """Of `docs`, none of which has an id: one of each component without ids, and all without shingles."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingle_set(t, near.words) for t in batch.column(text).to_pylist()]
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            keys = [pa.array([len(s) for s in sets], pa.int32()), *(pa.array(digests[:, k]) for k in (0, 1))]
            columns = [*batch.columns, *keys]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_n", "_k1", "_k2"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    keyed = written(map_batches(docs, run, schema + ", _n int, _k1 long, _k2 long"), "without-id")
    component = final.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("component").alias("_component"))
    own = keyed.where("_n > 0").join(with_own_shuffle(component), ["_k1", "_k2"]).where(F.col("_component") >= _no_id())
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = own.groupBy("_component").agg(F.min_by(whole, F.struct("_k1", "_k2", F.col(f"`{text}`"))).alias("_first"))
    return first.select("_first.*").unionByName(keyed.where("_n = 0").select(*(F.col(f"`{c}`") for c in docs.columns)))


def one_of_each(docs: DataFrame, near: Near, row: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that link, through others or not, to one of a lesser id.

    Rows that share an id stay or go together. Rows without an id go if they link to a document
    with one; else one of each component stays, that of the least set digest and then the least
    text (any of equal rows). Rows without an id and without words stay.
    """
    docs, names = apart(docs)
    row, text = names[row], names[text]
    every, final, kind = _components_of(docs, near, row, text)
    dropped = _with_component(every, final, kind, row).where(F.col("component_id") != F.col(row)).select(F.col(row).alias("_dropped")).distinct()
    kept = docs.join(written(dropped, "dropped"), F.col(row) == F.col("_dropped"), "left_anti")
    if kind == ANY:
        kept = kept.where(F.col(row).isNotNull()).unionByName(_one_without_id(docs.where(F.col(row).isNull()), written(final, "final"), near, text))
    return together(kept, names)
