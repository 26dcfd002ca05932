"""Conversations repaired into an optional system turn and user/assistant pairs, at least cost.

Each row is kept (0), given the role user or assistant (2) or deleted (3, which blank and
repeated rows must be); turns without text can be put in anywhere (2); a row that stays though its text
breaks off adds 1. The roles' initials must read `(s?(ua)+)?`. Of the cheapest repairs the one whose
edits' initials (D, I, K, R) come first in ASCII order is taken.

That is a Viterbi search over four states: nothing yet, after system, after user, after assistant. The
survivors of a row (the best way into each state) are leaves of a tree of backpointers with reference counts. A
leaf that no survivor continues is dropped, with all above it that nothing else needs; what all survivors share
is decided, and leaves the tree as edits. So a task holds only what is undecided, one small node for each row. Ways of
equal cost are compared as whole strings of edits, however long they are: at a row all survivors have made as many
non-insertions, so none is the beginning of another and their order never changes; it is carried along as a rank, and
the next edits decide only between continuations of one survivor. A survivor is given up early only if another one,
with the edits it would need to go on like it, is cheaper still.

Conversations of any length are spread: rows are dealt to ranges of (conversation, turn), a range's part of a
conversation is a piece, and pieces are searched on their own. A piece that may have others before it is first
searched from every state (`_transfers`); the pieces' costs and ranks are then combined, one row for each piece, which fixes the states
at both ends of every piece; then each piece makes its edits. Texts stay with Spark: the
search sees a row's number and class.

Defined results: a null role or text counts as one space; rows without an id are one conversation, rows without a
turn come first; rows of one turn are taken by role, then by the hash of their text. A conversation without rows has none here.
An empty table gives an empty result. Other columns of the input are not carried along.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import with_own_shuffle
from ..sinks.shared import written
from .frames import map_batches, shuffle_partitions

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLE = {"u": "user", "a": "assistant"}
#: Initials that may follow each other.
LEGAL = frozenset(("su", "ua", "au"))

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: State -> the role that an insertion or a new role has there, and the state after it.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
#: Insertions that end a conversation.
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: SLACK[p][q]: at this cost at most, p can go on like q does (by insertions, or deleting the system turn).
SLACK = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))


@cache
def moves(initial: str, fault: int) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state after a row: (state before, cost, edits), the best of each state before."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in STATES:
        state, put_in, cost = start, "", 0
        for _ in range(3):  # more insertions come back to a state they passed
            options = [(state, COST[DELETE], DELETE)]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED_COST * (fault == TRUNCATED)
                role, after = NEXT[state]
                options.append((after, COST[REROLE] + more, REROLE))
                if initial == role:
                    options.append((after, COST[KEEP] + more, KEEP))
                elif initial == "s" and state == START:
                    options.append((SYSTEM, COST[KEEP] + more, KEEP))
            for after, price, edit in options:
                key = (start, after)
                best[key] = min(best.get(key, (99, "")), (cost + price, put_in + edit))
            put_in, cost, state = put_in + INSERT, cost + COST[INSERT], NEXT[state][1]
    return tuple(tuple((q, *best[q, r]) for q in STATES if (q, r) in best) for r in STATES)


class Node:
    """One row's edits on a way: `refs` counts the nodes and survivors that need it."""

    __slots__ = ("above", "below", "edits", "place", "refs", "state")

    def __init__(self, above: Node | None, place: object, state: int, edits: str):
        self.above, self.place, self.state, self.edits = above, place, state, edits
        self.below: set[Node] = set()
        self.refs = 0


class Survivors:
    """The best way into each state, from one state on. `on_edit` gets decided edits: (place, state before, edits)."""

    def __init__(self, start: int = START, on_edit=None):
        self.on_edit = on_edit
        self.root = Node(None, None, start, "")
        self.root.refs = 1
        #: state -> (cost, rank, leaf); the rank is the way's place in ASCII order.
        self.live: dict[int, tuple[int, int, Node]] = {start: (0, 0, self.root)}
        self.held = self.most_held = 0

    def step(self, place: object, initial: str, fault: int) -> None:
        live, chosen = self.live, []
        for after, ways in enumerate(moves(initial if initial in ("s", "u", "a") else "", fault)):
            best = min(((live[q][0] + cost, live[q][1], edits, q) for q, cost, edits in ways if q in live), default=None)
            if best:
                chosen.append((after, best))
        chosen = [(r, b) for r, b in chosen if not any(o[0] + SLACK[p][r] < b[0] for p, o in chosen)]
        order = sorted(range(len(chosen)), key=lambda i: chosen[i][1][1:3])
        ranks = {i: rank for rank, i in enumerate(order)}
        self.live = {r: (b[0], ranks[i], self._leaf(live[b[3]][2], place, b[3], b[2])) for i, (r, b) in enumerate(chosen)}
        for _, _, leaf in live.values():
            self._release(leaf)
        self._emit()

    def _leaf(self, above: Node, place: object, state: int, edits: str) -> Node:
        if self.on_edit is None:
            return above
        node = Node(above, place, state, edits)
        node.refs = 1
        above.refs += 1
        above.below.add(node)
        self.held += 1
        self.most_held = max(self.most_held, self.held)
        return node

    def _release(self, node: Node) -> None:
        if self.on_edit is None:
            return
        node.refs -= 1
        while node.refs == 0 and node.above is not None:
            above = node.above
            above.below.discard(node)
            above.refs -= 1
            self.held -= 1
            node = above

    def _emit(self) -> None:
        """Hand over what all survivors share: a root that one node alone needs is no longer needed."""
        while self.on_edit is not None and self.root.refs == 1 and self.root.below:
            self.root = self.root.below.pop()
            self.root.above = None
            self.held -= 1
            self.on_edit(self.root.place, self.root.state, self.root.edits)

    def finish(self, end: int) -> None:
        """Give up all ways but the one into state `end`."""
        for state, (_, _, leaf) in list(self.live.items()):
            if state != end:
                self._release(leaf)
        self.live = {end: self.live[end]}
        self._emit()


def costs_and_ranks(survivors: Survivors) -> list[int]:
    """For each end state its cost and rank; -1 where the way there is given up."""
    return [x for state in STATES for x in (survivors.live[state][:2] if state in survivors.live else (-1, -1))]


class Pieces:
    """Pieces of one conversation, combined in their order.

    Fed with each piece's transfers, a start state's costs and ranks after the other; `ends` gives for each piece the states it
    goes from and to, on the cheapest way, the first in ASCII order among equal ones.
    """

    def __init__(self):
        self.live, self.came = {START: (0, 0)}, []

    def add(self, transfers: list[int]) -> None:
        best: dict[int, tuple] = {}
        for start, (cost, rank) in self.live.items():
            for after in STATES:
                more, order = transfers[8 * start + 2 * after : 8 * start + 2 * after + 2]
                if more >= 0:
                    way = (cost + more, rank, order, start)
                    best[after] = min(best.get(after, way), way)
        order = sorted(best, key=lambda r: best[r][1:3])
        self.live = {r: (best[r][0], order.index(r)) for r in best}
        self.came.append({r: way[3] for r, way in best.items()})

    def ends(self) -> tuple[int, list[tuple[int, int]]]:
        """The cost of the whole conversation, and (from, to) for each piece."""
        cost, _, state = min((c + COST[INSERT] * TO_END[s], rank, s) for s, (c, rank) in self.live.items())
        found = []
        for came in reversed(self.came):
            found.append((came[state], state))
            state = came[state]
        return cost, found[::-1]


# --- rows in order ------------------------------------------------------------------


def in_order(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows, written in ranges of (conversation, turn): `row` grows along each conversation, `part` numbers the range."""
    plain = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    keys = ["conv_id", "turn", "role", "_hash", "_salt"]
    salted = plain.withColumn("_hash", F.md5(F.encode("text", "utf-8"))).withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(shuffle_partitions(rows), *keys).sortWithinPartitions(*keys).drop("_salt")
    numbered = ranged.withColumnRenamed("_hash", "hash").withColumn("row", F.monotonically_increasing_id())
    return written(numbered.withColumn("part", F.shiftright("row", 33)), "turns")


def key() -> Column:
    """The conversation as a string; no id is one space."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def with_faults(ordered: DataFrame) -> DataFrame:
    """part, row, key, turn, initial and fault of every row; written, without texts."""
    same = ["key", "role", "hash"]
    alone = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(NONE)
    slim = ordered.select("part", "row", "turn", "role", "hash", key().alias("key"), alone.alias("alone"))
    # Only what occurs again in its conversation has to be looked up.
    again = slim.groupBy(*same).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = slim.join(with_own_shuffle(again), same, "left")
    fault = F.when((F.col("alone") != BLANK) & (F.col("first") != F.col("row")), DUPLICATE).otherwise(F.col("alone"))
    return written(both.select("part", "row", "key", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "faults")


# --- the search in tasks ------------------------------------------------------------


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _batches(found: Iterable[tuple], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    got: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*got, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in found:
        got.append(row)
        if len(got) == at_once:
            yield batch()
            got = []
    if got:
        yield batch()


def _streamed(df: DataFrame, by: str, order: list[str], columns: list[str], function, schema: dict[str, pa.DataType]) -> DataFrame:
    """`function` over tuples of `columns`, rows of one `by` together and in `order`."""
    layout = pa.schema(list(schema.items()))
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    ready = df.repartition(shuffle_partitions(df), by).sortWithinPartitions(by, *order).select(*columns)
    return map_batches(ready, lambda b: _batches(function(_rows(b)), layout), ", ".join(f"{n} {names[t]}" for n, t in schema.items()))


def _transfers(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Per piece: costs and ranks by start and end state, initials at both ends, illegal neighbours inside."""
    for _, in_part in groupby(rows, key=lambda r: r[0]):
        for number, (key, piece) in enumerate(groupby(in_part, key=lambda r: r[2])):
            # Only a range's first piece can have a piece before it.
            searches = [Survivors(s) for s in (STATES if number == 0 else (START,))]
            first = last = None
            illegal = 0
            for part, row, _, initial, fault in piece:
                if first is None:
                    first, at = initial, row
                else:
                    illegal += last + initial not in LEGAL
                last = initial
                for search in searches:
                    search.step(row, initial, fault)
            found = [x for search in searches for x in costs_and_ranks(search)]
            yield key, part, at, [*found, *([-1] * (32 - len(found)))], first, last, illegal


def _combined(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Per piece: the states at its ends; its share of the conversation's cost (all on the first) and of its illegal neighbours."""
    for key, of_one in groupby(pieces, key=lambda p: p[0]):
        whole, parts, before = Pieces(), [], None
        for _, part, transfers, first, last, illegal in of_one:
            whole.add(transfers)
            parts.append((part, illegal + (before is not None and before + first not in LEGAL)))
            before = last
        cost, ends = whole.ends()
        for i, ((part, illegal), (start, end)) in enumerate(zip(parts, ends, strict=True)):
            yield key, part, start, end, int(i == len(parts) - 1), cost if i == 0 else 0, illegal


def _decided(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(row, state before, edits, state at the end of the conversation or none) of every row."""
    for _, piece in groupby(rows, key=lambda r: (r[0], r[2])):
        search, out = None, deque()
        for _, row, _, initial, fault, start, end, is_last in piece:
            search = search or Survivors(start, lambda *edit: out.append(edit))
            search.step(row, initial, fault)
            while len(out) > 1:  # the last edit of all waits for what has to follow it
                yield (*out.popleft(), 0)
        search.finish(end)
        while out:
            edit = out.popleft()
            yield (*edit, 0 if out or not is_last else TO_END[end])


def searched(faults: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, part, start, end, last, cost, illegal) of every piece, and (row, state, edits, then_insert) of every row."""
    slim, number, text = ["part", "row", "key", "initial", "fault"], pa.int64(), pa.string()
    pieces = _streamed(
        faults, "part", ["row"], slim, _transfers,
        {"key": text, "part": number, "row": number, "transfers": pa.list_(pa.int32()), "first": text, "last": text, "illegal": number},
    )
    states = written(
        _streamed(
            pieces, "key", ["row"], ["key", "part", "transfers", "first", "last", "illegal"], _combined,
            {"key": text, "part": number, "start": pa.int32(), "end": pa.int32(), "is_last": pa.int32(), "cost": number, "illegal": number},
        ), "pieces",
    )
    known = faults.select(*slim).join(states.select("key", "part", "start", "end", "is_last"), ["key", "part"])
    edits = _streamed(
        known, "part", ["row"], [*slim, "start", "end", "is_last"], _decided,
        {"row": number, "state": pa.int32(), "edits": text, "then_insert": pa.int32()},
    )
    return states, edits


def applied(ordered: DataFrame, edits: DataFrame) -> DataFrame:
    """One row for each edit: conv_id, row, step, edit, role and text (null for a deletion)."""
    both = ordered.select("conv_id", "row", "role", "text").join(edits, "row")
    # A row's edits are insertions, then its own; a conversation's last row may be followed by insertions.
    steps = F.concat("edits", F.expr(f"repeat('{INSERT}', then_insert)"))
    each = both.select("conv_id", "row", "role", "text", "state", "edits", F.posexplode(F.split(steps, "")).alias("step", "edit"))
    own = F.length("edits") - 1
    # The roles put in alternate from the state before the row; after the row, from the state that its own edit led to.
    put_user = (F.col("state") != USER) == (F.pmod(F.col("step"), F.lit(2)) == 0)
    own_role = F.when(F.col("edit") == KEEP, F.col("role")).when(put_user, ROLE["u"]).otherwise(ROLE["a"])
    kept_system = (F.col("state") == START) & (own == 0) & F.col("edits").endswith(KEEP) & (F.substring("role", 1, 1) == "s")
    deleted = F.col("edits").endswith(DELETE)
    # A deleted row leaves the state as it was, a kept system turn is followed by user; any other own edit is one turn.
    turns = F.col("step") - F.when(deleted, 1).otherwise(0)
    after_user = F.when(kept_system, F.pmod(F.col("step") - 1, F.lit(2)) == 0).otherwise(
        (F.col("state") != USER) == (F.pmod(turns, F.lit(2)) == 0)
    )
    role = F.when(F.col("step") <= own, own_role).when(after_user, ROLE["u"]).otherwise(ROLE["a"])
    is_own, gone = F.col("step") == own, F.col("edit") == DELETE
    return each.select(
        "conv_id", "row", "step", "edit", F.when(~gone, role).alias("role"),
        F.when(~gone, F.when(is_own, F.col("text")).otherwise("")).alias("text"),
    )


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A report on every conversation that has rows, and its edits (`applied`).

    The report: key (the conversation's id as a string), gaps, blank, duplicate, truncated, illegal and cost.
    """
    ordered = in_order(rows, conv, turn, role, text)
    faults = with_faults(ordered)
    states, edits = searched(faults)
    by_turn = faults.groupBy("key", "turn").agg(
        *(F.count_if(F.col("fault") == n).alias(name) for n, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated")))
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = by_turn.groupBy("key").agg(gaps.alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    totals = states.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    return counts.join(totals, "key"), written(applied(ordered, edits), "edits")


def _digested(edits: Iterator[tuple]) -> Iterator[tuple]:
    for key, of_one in groupby(edits, key=lambda e: e[0]):
        audit, digest, is_first = [], hashlib.sha256(), True
        for _, edit, role, text in of_one:
            audit.append(edit)
            if role is not None:
                digest.update(("" if is_first else "\n").encode() + role.encode() + b":" + text.encode())
                is_first = False
        yield key, "".join(audit), digest.hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """key (the conversation as a string), audit and repaired_sha256: a running hash, never a whole conversation in memory."""
    keyed = edits.withColumn("key", key())
    text = pa.string()
    return _streamed(keyed, "key", ["row", "step"], ["key", "edit", "role", "text"], _digested, {"key": text, "audit": text, "repaired_sha256": text})
