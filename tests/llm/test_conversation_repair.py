"""Repaired conversations against plain searches over whole strings of edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from basewright.llm import conversation_repair as C
from basewright.llm import queries as q

SHAPE = re.compile(r"(s?(ua)+)?")
STOPS = re.compile("[.!?]")


def faults(rows):
    """The first fault of each (role, text)."""
    found, seen = [], set()
    for role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        found.append(C.BLANK if not words else C.DUPLICATE if (role, text) in seen else C.NONE if words[-1] in ".!?" else C.TRUNCATED)
        seen.add((role, text))
    return found


def all_repairs(rows):
    """Cheapest (cost, audit, roles) by trying every string of edits, with up to three insertions at a place."""
    gaps = [""] + ["I" + "".join(x) for n in range(3) for x in product("I", repeat=n)]
    found, marks = faults(rows), []
    for (role, _), fault in zip(rows, found):
        marks.append("D" if fault in (C.BLANK, C.DUPLICATE) else "DKR")
    best = None
    for own in product(*marks):
        for put in product(gaps, repeat=len(rows) + 1):
            audit = "".join(p + o for p, o in zip(put, own)) + put[-1]
            cost = sum(C.COST[e] for e in audit) + sum(o != "D" and f == C.TRUNCATED for o, f in zip(own, found))
            if best and (cost, audit) >= best[:2]:
                continue
            roles, at = [], -1
            for e in audit:
                at += e != "I"
                if e == "K":
                    roles.append(rows[at][0][:1])
                elif e != "D":
                    roles.append("a" if roles and roles[-1] == "u" else "u")
            if SHAPE.fullmatch("".join(r or "?" for r in roles)):
                best = (cost, audit)
    return best


def longest_strings(rows):
    """The same for long conversations: the best whole string into each state after each edit."""
    follow = {"": "us", "s": "u", "u": "a", "a": "u"}
    live = {"": (0, "")}

    def insert(live):
        for _ in range(3):
            for state, (cost, audit) in list(live.items()):
                to = "a" if state == "u" else "u"
                live[to] = min(live.get(to, (10**9, "")), (cost + 2, audit + "I"))
        return live

    for (role, _), fault in zip(rows, faults(rows)):
        ways = defaultdict(list)
        for state, (cost, audit) in insert(dict(live)).items():
            ways[state].append((cost + 3, audit + "D"))
            if fault in (C.NONE, C.TRUNCATED):
                extra = fault == C.TRUNCATED
                to = "a" if state == "u" else "u"
                ways[to].append((cost + 2 + extra, audit + "R"))
                if role[:1] and role[:1] in follow[state]:
                    ways[role[:1]].append((cost + extra, audit + "K"))
        live = {state: min(w) for state, w in ways.items()}
    return min(v for state, v in insert(dict(live)).items() if state in ("", "a"))


def edited(rows, audit):
    """The repaired `role:text` lines that a string of edits gives."""
    lines, at = [], -1
    for e in audit:
        at += e != "I"
        to = "assistant" if lines and lines[-1].startswith("u") else "user"
        if e == "K":
            lines.append(f"{rows[at][0]}:{rows[at][1]}")
        elif e == "R":
            lines.append(f"{to}:{rows[at][1]}")
        elif e == "I":
            lines.append(f"{to}:")
    return lines


def searched_alone(rows, cut=()):
    """The operator's own search without Spark: pieces between `cut`, combined, then decided."""
    found = faults(rows)
    bounds = [0, *cut, len(rows)]
    items = [(part, i, "k", rows[i][0][:1], found[i]) for part, (a, b) in enumerate(zip(bounds, bounds[1:])) for i in range(a, b)]
    pieces = [(p[0], p[1], p[3], p[4], p[5], p[6]) for p in C._transfers(iter(items))]
    states = {p[1]: p for p in C._combined(iter(pieces))}
    out = list(C._decided((*item, states[item[0]][2], states[item[0]][3], states[item[0]][4]) for item in items))
    assert [o[0] for o in out] == list(range(len(rows)))
    return sum(s[5] for s in states.values()), "".join(o[2] + "I" * o[3] for o in out)


def drawn(pick, n, roles=("user", "assistant", "system", "tool", " ", "")):
    return [(pick.choice(roles), pick.choice(["Yes.", "no", " ", f"{i}!", f"{i}", f"{i}?"])) for i in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_short_conversations_against_all_strings(seed):
    pick = random.Random(seed)
    rows = drawn(pick, seed % 4 + 1)
    assert searched_alone(rows) == all_repairs(rows) == longest_strings(rows)


@pytest.mark.parametrize("seed", range(150))
def test_long_conversations_in_any_pieces(seed):
    pick = random.Random(1000 + seed)
    roles = [("user", "assistant"), ("user",), ("assistant",), ("system", "user"), ("user", "assistant", "system", "tool"), ("tool",)][seed % 6]
    rows = drawn(pick, pick.randrange(5, 120), roles)
    cut = sorted(pick.sample(range(1, len(rows)), pick.randrange(0, 5)))
    assert searched_alone(rows, cut) == searched_alone(rows) == longest_strings(rows)


def test_undecided_edits_are_few_where_survivors_meet():
    """A hundred thousand rows hold few nodes where one way is best; long ties stay whole and compare right."""
    for initial in ("us", "ua", "xu"):
        got = []
        search = C.Survivors(C.START, lambda *e: got.append(e))
        for i in range(100_000):
            search.step(i, "ua"[i % 2] if initial == "ua" else initial[i % 7 == 0], C.NONE if i % 3 else C.DUPLICATE)
        search.finish(min(search.live, key=lambda s: search.live[s][:2]))
        assert len(got) == 100_000
        assert initial != "ua" or search.most_held < 64
    rows = [("user", f"{i}.") for i in range(2001)]
    assert searched_alone(rows) == longest_strings(rows)


def test_a_survivor_tree_leaves_nothing_behind():
    pick = random.Random(2)
    search = C.Survivors(C.START, lambda *e: None)
    for i in range(3000):
        search.step(i, pick.choice("uasx"), pick.randrange(4))
        assert search.held <= search.most_held
    search.finish(next(iter(search.live)))
    assert search.held == 0


# --- whole tables ------------------------------------------------------------------


def expected(table):
    """conv_id -> the query's row, from the undamaged rows (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    one = lambda x: " " if x is None else x
    for conv, turn, role, text in table:
        kept = convs[conv]
        role, text, kind = one(role), one(text), zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else STOPS.sub("", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        rows = [r[1:] for r in kept]
        turns = {t for t, _, _ in kept if t is not None}
        f = faults(rows)
        initials = [r[0][:1] for r in rows]
        cost, audit = longest_strings(rows) if rows else (0, "")
        found[conv] = (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count(C.BLANK), f.count(C.DUPLICATE), f.count(C.TRUNCATED),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(edited(rows, audit)).encode()).hexdigest(),
        )
    return found


def matches(spark, folder):
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in q.op12_conversation_repair(spark, folder).collect()]
    wanted = expected(table)
    assert len(got) == len(wanted)
    for row in got:
        assert row == wanted[row[0]]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_given_tables(spark, sf):
    matches(spark, f"/root/testdata/{sf}")


def test_odd_tables(spark, conf, tmp_path):
    """Nulls anywhere, repeated rows and turns, a conversation with most of all rows over many ranges, long texts, clashing columns."""
    conf("spark.sql.shuffle.partitions", "13")
    pick = random.Random(9)
    texts = ["Well.", "so", "", " \n", "Is it?", None, "é\xa0", "ends.\n\n", "x" * 400_000, "same thing."]
    roles = ["user", "assistant", "system", None, "", "tool"]
    rows = [(pick.choice([None, 1, 2, 3, -4, 2**62]), pick.choice([None, 0, 1, 2, 3, 9]), pick.choice(roles), pick.choice(texts)) for _ in range(150)]
    rows += [(77, i // 2, pick.choice(roles[:2]), f"{i}{pick.choice('.,')}") for i in range(900)] + [(77, None, "user", "same thing.")] * 200
    rows += [(c, 0, "user", "only.") for c in range(100, 200)] + rows[:40]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumn("row", F.lit("r")).withColumn("key", F.lit(1)).withColumn("part", F.lit(2)).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    matches(spark, str(tmp_path))
    ordered = C.in_order(q.damaged(df))
    parts = ordered.where("conv_id = 77").groupBy("part").count().collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 600


def test_edits_of_the_operator_itself(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (2, 0, "system", "Be kind.")], "c int, t int, r string, x string")
    report, edits = C.repaired(df, "c", "t", "r", "x")
    got = sorted((r["conv_id"], r["row"], r["step"], r["edit"], r["role"], r["text"]) for r in edits.collect())
    assert [(c, e, r, t) for c, _, _, e, r, t in got] == [
        (1, "I", "user", ""), (1, "K", "assistant", "Hello."), (1, "K", "user", "Hi."), (1, "I", "assistant", ""), (2, "D", None, None),
    ]
    assert {r["key"]: (r["illegal"], r["cost"]) for r in report.collect()} == {"1": (0, 4), "2": (0, 3)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert q.op12_conversation_repair(spark, str(tmp_path)).count() == 0
