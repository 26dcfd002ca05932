"""Packing documents into sequences by a configuration linear program over lengths.

Documents longer than a sequence are cut into whole sequences and a shorter first piece.
What has to be packed is then a histogram of at most `capacity` lengths, whatever the
number of documents. A configuration is a multiset of lengths that fits a sequence; the
program asks for the fewest configurations that cover the histogram. It is solved by
multiplicative weights: a length's price falls with how far it is covered, and an
unbounded-knapsack dynamic program finds the configuration of the highest price. The
fractional counts are rounded down, and the lengths left over are packed best-fit,
longest first, still on the histogram (groups of alike sequences, not single ones).

The program is solved for every histogram, in ever smaller steps until its plan is within
`TOLERANCE` of the bound by tokens or by the program's dual prices, or steps are at `LEAST_SHARE`;
the solution with the fewest sequences is used. Best fit places nothing but what rounding left.

The plan says for the k-th piece of a length which sequence and place it gets. Pieces
are numbered within their length without bringing a length together: each task numbers
its own, and sums per task and length say where its numbers begin.

Defined results: a null or empty text is packed as its closing id alone. Repeated rows are
packed each on its own; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.shared import written
from .frames import map_batches
from .pieces import id_encoder

#: The share of a configuration's limit that a round of the multiplicative-weights solver adds, and
#: the weights' step. At a share of 1 there are half as many rounds as distinct lengths, so less than the capacity.
SHARE, LEAST_SHARE = 1.0, 0.5
#: Sequences over the lower bound at which a plan is good enough.
TOLERANCE = 0.001
STEP = 0.7
#: Above 1, long pieces, which are the hard ones to place, are priced up from the start.
LEAN = 1.1

Pattern = tuple[list[int], int]


def best_configuration(price, capacity: int) -> list[int]:
    """The lengths (longest first) that fit `capacity` at the highest total price; `price[l]` is -inf where l is absent.

    Where a configuration has two lengths or more, the shortest is at most half of its room: only
    these are tried against what is best for the rest.
    """
    import numpy as np

    value, last, alone = np.zeros(capacity + 1), [0] * (capacity + 1), price.tolist()
    before = 0.0
    for c in range(1, capacity + 1):
        best, length = before, 0
        if alone[c] > best:
            best, length = alone[c], c
        half = c // 2
        if half:
            options = price[1 : half + 1] + value[c - half : c][::-1]
            at = options.argmax()
            if options[at] > best:
                best, length = float(options[at]), int(at) + 1
        value[c] = before = best
        last[c] = length
    chosen, c = [], capacity
    while c > 0:
        if last[c]:
            chosen.append(last[c])
            c -= last[c]
        else:
            c -= 1
    return sorted(chosen, reverse=True)


def configurations(counts: dict[int, int], capacity: int, step: float = SHARE) -> tuple[list[Pattern], float]:
    """Fractional optimum by multiplicative weights, rounded down: configurations and how often each is used.

    Also the best lower bound that the prices gave: no configuration is worth more than the chosen one.
    """
    import numpy as np

    if not counts:
        return [], 0.0
    bound = 0.0
    lengths = np.array(sorted(counts), np.int64)
    wanted = np.array([counts[x] for x in lengths.tolist()], float)
    at = {x: i for i, x in enumerate(lengths.tolist())}
    covered, used = np.zeros(len(lengths)), defaultdict(float)
    price = np.full(capacity + 1, -np.inf)
    for _ in range(math.ceil(len(lengths) / 2 / step)):
        price[lengths] = (lengths / capacity) ** LEAN * np.exp(-STEP * covered / wanted)
        chosen = best_configuration(price, capacity)
        each = np.bincount([at[x] for x in chosen], minlength=len(lengths))
        inside = each > 0
        bound = max(bound, float(wanted @ price[lengths] / (each @ price[lengths])))
        add = step * float((wanted[inside] / each[inside]).min())
        used[tuple(chosen)] += add
        covered += add * each
        if (covered >= wanted).all():
            break
    left, plan = dict(counts), []
    for chosen, share in sorted(used.items(), key=lambda x: -x[1]):
        each = {x: chosen.count(x) for x in set(chosen)}
        times = min(int(share), *(left[x] // n for x, n in each.items()))
        if times:
            plan.append((list(chosen), times))
            for x, n in each.items():
                left[x] -= times * n
    return plan, bound


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, on groups of alike sequences."""
    open_: dict[int, list[Pattern]] = defaultdict(list)  # by space left
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            space = min((s for s, groups in open_.items() if s >= length and groups), default=None)
            if space is None:
                fit = capacity // length
                whole, rest = divmod(todo, fit)
                for n, times in ((fit, whole), (rest, 1)):
                    if n and times:
                        open_[capacity - n * length].append(([length] * n, times))
                break
            items, times = open_[space].pop()
            fit = space // length
            whole = min(times, todo // fit)
            if whole:
                open_[space - fit * length].append((items + [length] * fit, whole))
                todo, times = todo - whole * fit, times - whole
            if times and todo and todo < fit:
                open_[space - todo * length].append((items + [length] * todo, 1))
                todo, times = 0, times - 1
            if times:
                open_[space].append((items, times))
    return [p for groups in open_.values() for p in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """All sequences: their lengths, longest first, and how many of each kind."""
    whole = counts.get(capacity, 0)
    parts = {x: n for x, n in counts.items() if x != capacity and n}
    fewest = -(-sum(x * n for x, n in parts.items()) // capacity)
    best, step = None, SHARE
    while step >= LEAST_SHARE:
        chosen, bound = configurations(parts, capacity, step)
        left = dict(parts)
        for items, times in chosen:
            for x in items:
                left[x] -= times
        solved = chosen + best_fit({x: n for x, n in left.items() if n}, capacity)
        fewest = max(fewest, math.ceil(bound - 1e-6))
        if best is None or _sequences(solved) < _sequences(best):
            best = solved
        if _sequences(best) <= fewest * (1 + TOLERANCE):
            break
        step /= 2
    return ([([capacity], whole)] if whole else []) + best


def _sequences(patterns: list[Pattern]) -> int:
    return sum(times for _, times in patterns)


def slots(patterns: list[Pattern]) -> dict[int, tuple]:
    """Per length, arrays of runs: first number, first sequence, pieces per sequence, offset of the first.

    Runs are at most the patterns times the distinct lengths of one, so that this is small
    at any size of the input.
    """
    import numpy as np

    runs, taken, sequence = defaultdict(list), defaultdict(int), 0
    for items, times in patterns:
        offset = 0
        for length in dict.fromkeys(items):
            n = items.count(length)
            runs[length].append((taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) for length, found in runs.items()}


PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, row: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; `nth` numbers a task's pieces of a length. `with_ids` adds the ids."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder, part = id_encoder(vocabulary), TaskContext.get().partitionId()
        end, width, seen = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize, [0] * (capacity + 1)
        for batch in batches:
            out: list[tuple] = []
            for row_id, raw in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, encoder.dtype).astype("<u4")
                stops = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                start = 0
                for piece, stop in enumerate(stops):
                    some = ids[start:stop]
                    out.append((row_id, piece, start, len(some), zlib.crc32(some.tobytes()), part, seen[len(some)], some.tolist() if with_ids else None))
                    seen[len(some)] += 1
                    start = stop
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names) if with_ids else pa.RecordBatch.from_arrays(arrays[:-1], names=names[:-1])

    schema = PIECES + (", ids array<long>" if with_ids else "")
    plain = docs.select(F.col(row).cast("long").alias("id"), F.col(text).alias("text"))
    return written(map_batches(plain, run, schema), "pieces")


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """`pieces` (of `pieces_of`) with `sequence_id` and `offset`."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # At most `capacity` rows, however many pieces there are.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    numbered = pieces.join(first, ["part", "length"]).withColumn("number", F.col("first") + F.col("nth")).drop("first", "part", "nth")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length).tolist():
                here = length == one
                start, base, each, at = places.value[one]
                k = np.searchsorted(start, number[here], "right") - 1
                nth = number[here] - start[k]
                sequence[here], offset[here] = base[k] + nth // each[k], at[k] + nth % each[k] * one
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return map_batches(numbered, run, schema + ", sequence_id long, offset long").drop("number")


def sequences(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, row: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences themselves: `sequence_id` and its `ids`, at most `capacity` of them."""
    placed = packed(pieces_of(docs, vocabulary, end_id, capacity, row, text, with_ids=True), capacity)
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
