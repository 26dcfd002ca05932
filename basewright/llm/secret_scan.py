"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control.

Patterns find assigned secrets, access keys and long hexadecimal runs. Beyond them, every
run of 20 or more key characters that has a digit and a letter is a candidate. Its
encoding is inferred from its characters, and three tests ask whether it could have been
drawn at random from that alphabet:

- chi-squared uniformity of the symbols,
- the runs test (symbols in the upper or lower half of the alphabet),
- lag-1 serial correlation of the symbols' numbers.

Their p-values are joined by Fisher's method. A true key passes with a p-value spread
evenly over 0 to 1, while names and words crowd near 0. From that, the share of other
strings above any cut follows for each class of encoding and length, because short
strings give the tests little power: twice the count above 1/2 estimates the random
ones. The lowest cut at which at most `MAX_FALSE_SHARE` of the strings above it are not
random is used for the class, 1/2 at the latest. What a class has too few strings to say
comes from wider pools: the neighbouring lengths of its encoding, those of all encodings,
and last a fixed expectation; each adds the weight of a few strings to the narrower one.
Counts above a cut are taken less their standard deviation, so that no few strings speak
against each other, and a lone key is judged by its own p-value. Counts are over the
distinct candidates of all documents.

Defined results: a null or empty text has no spans. Spans are in code points, end
exclusive. Repeated rows and texts get the same spans, each row its own; long texts are
scanned whole. Empty tables give empty results. Columns of the input named like one that
is added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import apart, bound, running, together

#: Fixed patterns. The two later ones hold the least length, as their runs are maximal.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "random")
#: A candidate: a whole run of these, with a letter and a digit. An equals sign belongs to it only as
#: padding at its end; one before it, or between it and what it is set to, doesn't.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Encodings, the smallest alphabet first; a candidate has the first that holds all its characters.
ALPHABETS = {
    "hex_lower": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36_lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
MAX_FALSE_SHARE = 0.05
CUTS = (0.001, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5)
#: A pool counts as this many random strings in the next narrower one.
POOLED = 40
#: Expected without any data: this over the cut, in other strings above it for each random one.
OTHERS = 0.002
#: Lengths up to these share a class.
LENGTH_CLASSES = (24, 32, 48, 64)


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string,found:string>>")


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches, leftmost and not overlapping: array of (start, end, kind, found)."""
    # What lies between matches comes from a split, so that positions are sums of lengths.
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(g: Column, m: Column) -> Column:
        ends = running(F.zip_with(F.slice(g, 1, F.size(m)), m, lambda before, x: before + F.length(x)), lambda a, b: a + b)
        return F.zip_with(
            ends, m, lambda end, x: F.struct((end - F.length(x)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x.alias("found"))
        )

    spans = bound(gaps, lambda g: bound(found, lambda m: placed(g, m)))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(_no_spans())


def pattern_spans(text: Column) -> Column:
    """Spans of the fixed patterns."""
    assign = F.filter(
        matches(text, ASSIGN, "assign"),
        lambda s: F.length(F.regexp_extract(s["found"], "^" + ASSIGN, 1)) >= MIN_ASSIGNED,
    )
    return F.concat(assign, matches(text, ACCESS, "access"), matches(text, HEX, "hex"))


def candidates(text: Column) -> Column:
    """Spans of the strings that the battery tries."""
    both = lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]")
    return F.filter(matches(text, CANDIDATE, "random"), both)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to 1e-7 (a rational approximation)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _two_sided(z: Column) -> Column:
    """0 where the test has no variance to work with: all symbols lie on one side."""
    return F.coalesce(bound(F.abs(z), lambda a: 2 * _upper_tail(a)), F.lit(0.0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _tests(x: Column, k: float) -> Column:
    """The p-values of symbols `x` (numbers 1 to k, as doubles)."""
    n, half, free = F.size(x).cast("double"), (k + 1) / 2, float(k - 1)
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: y == v)).cast("double"))
    chi = _sum(F.transform(counts, lambda c: c * c)) * k / n - n
    # The cube-root normal approximation; only too uneven counts speak against a key.
    z_uniform = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5
    switches = _sum(F.transform(pairs, lambda p: ((p["a"] > half) != (p["b"] > half)).cast("double")))

    def runs(up: Column) -> Column:
        both = 2 * up * (n - up)
        var = both * (both - n) / (n * n * (n - 1))
        return _two_sided(F.when(var > 0, (switches - both / n) / F.sqrt(var)))

    def serial(mean: Column) -> Column:
        cov = _sum(F.transform(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)))
        var = _sum(F.transform(x, lambda y: (y - mean) * (y - mean)))
        return _two_sided(F.when(var > 0, (cov / var + 1 / n) * F.sqrt(n)))

    up = F.size(F.filter(x, lambda y: y > half)).cast("double")
    return F.struct(
        bound(z_uniform, _upper_tail).alias("uniform"),
        bound(up, runs).alias("runs"),
        bound(_sum(x) / n, serial).alias("serial"),
    )


def battery(found: Column) -> Column:
    """A struct of `encoding`, `n`, the tests' p-values and Fisher's `p`; null outside every alphabet."""

    def as_drawn_from(body: Column, name: str, alphabet: str) -> Column:
        numbers = F.filter(F.transform(F.split(body, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double")), lambda y: y > 0)
        tests = bound(numbers, lambda x: _tests(x, float(len(alphabet))))
        return F.struct(F.lit(name).alias("encoding"), F.length(body).alias("n"), tests.alias("tests"))

    def tried(body: Column) -> Column:
        got = F.lit(None)
        for name, alphabet in reversed(ALPHABETS.items()):
            got = F.when(F.length(F.translate(body, alphabet, "")) == 0, as_drawn_from(body, name, alphabet)).otherwise(got)
        return got

    def joined(t: Column) -> Column:
        # Fisher: minus the sum of logs is half a chi-squared value with six degrees of freedom.
        logs = [F.ln(F.greatest(t["tests"][test], F.lit(1e-100))) for test in ("uniform", "runs", "serial")]
        p = bound(-(logs[0] + logs[1] + logs[2]), lambda h: F.exp(-h) * (1 + h + h * h / 2))
        return F.when(t.isNotNull(), F.struct(t["encoding"].alias("encoding"), t["n"].alias("n"), t["tests"].alias("tests"), p.alias("p")))

    return bound(bound(F.regexp_replace(found, "=+$", ""), tried), joined)


def _class(encoding: Column, n: Column) -> Column:
    longest = F.lit("more")
    for top in reversed(LENGTH_CLASSES):
        longest = F.when(n <= top, F.lit(str(top))).otherwise(longest)
    return F.concat_ws(" ", encoding, longest)


def lowest_cuts(counts: dict[str, list[int]]) -> dict[str, float]:
    """The cut of every class, from the classes' strings above 1/2 and above each of `CUTS`."""
    lengths = [*map(str, LENGTH_CLASSES), "more"]

    def pool(encodings: Iterable[str], near: list[str]) -> list[int]:
        some = [counts[f"{e} {n}"] for e in encodings for n in near if f"{e} {n}" in counts]
        return [sum(x) for x in zip(*some, strict=True)] or [0] * (1 + len(CUTS))

    found = {}
    for e in ALPHABETS:
        for i, n in enumerate(lengths):
            near = lengths[max(i - 1, 0) : i + 2]
            # Strings above each cut for each random one, from the widest pool to the class itself.
            rate = [1 - c + OTHERS / c for c in CUTS]
            for half, *above in (pool(ALPHABETS, near), pool([e], near), pool([e], [n])):
                rate = [(x - x**0.5 + POOLED * r) / (2 * half + POOLED) for x, r in zip(above, rate, strict=True)]
            fit = (c for c, r in zip(CUTS, rate, strict=True) if r * (1 - MAX_FALSE_SHARE) <= 1 - c)
            found[f"{e} {n}"] = next(fit, CUTS[-1])
    return found


def cuts(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Per class of encoding and length, the p-value above which a string counts as a key.

    One entry per class, however large the input.
    """
    strings = docs.select(F.explode(F.transform(candidates(F.col(text)), lambda s: s["found"])).alias("found")).distinct()
    tested = strings.select(battery(F.col("found")).alias("t")).where("t is not null")
    tested = tested.select(_class(F.col("t.encoding"), F.col("t.n")).alias("class"), "t.p")
    above = [F.count_if(F.col("p") > c).alias(f"above{i}") for i, c in enumerate(CUTS)]
    rows = tested.groupBy("class").agg(F.count_if(F.col("p") > 0.5).alias("half"), *above).collect()
    return lowest_cuts({r["class"]: list(r[1:]) for r in rows})


def is_key(span: Column, cut: dict[str, float]) -> Column:
    """Whether the battery takes a candidate for a key."""
    limits = F.create_map(*(F.lit(x) for pair in sorted(cut.items()) for x in pair))
    passes = lambda t: t["p"] > F.element_at(limits, _class(t["encoding"], t["n"]))
    return F.coalesce(bound(battery(span["found"]), passes), F.lit(False))


def not_overlapping(spans: Column, base: Column) -> Column:
    """The spans that no span of `base` overlaps: one pass over both in order of their starts."""
    spot = lambda s, own: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s.alias("span"))
    both = F.array_sort(F.concat(F.transform(base, lambda s: spot(s, False)), F.transform(spans, lambda s: spot(s, True))))

    def checked(at: Column) -> Column:
        # How far the base spans reach that begin before, and where the next one begins.
        reach = running(F.transform(at, lambda x: F.when(x["own"], 0).otherwise(x["end"])), F.greatest)
        follow = F.reverse(running(F.reverse(F.transform(at, lambda x: F.when(x["own"], NOWHERE).otherwise(x["start"]))), F.least))
        near = F.zip_with(reach, follow, lambda r, f: F.struct(r.alias("reach"), f.alias("follow")))
        told = F.zip_with(at, near, lambda x, n: F.struct(x.alias("x"), n.alias("n")))
        free = lambda t: t["x"]["own"] & (t["n"]["reach"] <= t["x"]["start"]) & (t["n"]["follow"] >= t["x"]["end"])
        return F.transform(F.filter(told, free), lambda t: t["x"]["span"])

    return bound(both, checked)


#: Beyond every place in a text, and characters of a text that are cut out at once when secrets are masked.
NOWHERE, BLOCK = 2**31 - 1, 1 << 14


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `spans`: array of (start, end, kind, found) by start, then kind as in `KINDS`."""
    cut = cuts(docs, text)
    plain, names = apart(docs.drop("spans") if text != "spans" else docs)
    whole = F.coalesce(F.col(names[text]), F.lit(""))
    # Step by step, as columns: one expression of all would be nested too deep to be analysed.
    found = plain.select("*", pattern_spans(whole).alias("base"), candidates(whole).alias("tried"))
    alone = F.when(F.size("tried") == 0, F.col("tried")).otherwise(not_overlapping(F.col("tried"), F.col("base")))
    found = found.withColumn("alone", alone).withColumn("random", F.filter("alone", lambda s: is_key(s, cut)))
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    ordered = F.transform(
        F.concat("base", "random"), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s.alias("span"))
    )
    spans = F.transform(F.array_sort(ordered), lambda o: o["span"])
    return found.select(*(F.col(n).alias(c) for c, n in names.items() if c != "spans"), spans.alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """`text` with each span replaced by `mask`; overlapping ones by one mask.

    The text is cut into blocks first, as finding a place in a text takes as long as the text before it.
    """

    def pieces(at: Column, length: Column) -> Column:
        """What stays before each mask, as (from, to, mask); last what stays after them."""
        kept = lambda start, end, mask: F.struct(start.alias("from"), end.alias("to"), F.lit(mask).alias("mask"))
        starts = F.concat(F.transform(at, lambda s: kept(F.lit(0), s["start"], mask)), F.array(kept(F.lit(0), length, "")))
        reach = F.concat(F.array(F.lit(0)), running(F.transform(at, lambda s: s["end"]), F.greatest))
        moved = F.zip_with(starts, reach, lambda p, r: F.struct(r.alias("from"), p["to"].alias("to"), p["mask"].alias("mask")))
        return F.filter(moved, lambda p: p["from"] <= p["to"])

    def block(kept: Column, b: Column) -> Column:
        low, high = b * BLOCK, (b + 1) * BLOCK

        def written(own: Column) -> Column:
            def one(p: Column) -> Column:
                start = F.greatest(p["from"], low)
                stays = F.substring(own, start - low + 1, F.greatest(F.least(p["to"], high) - start, F.lit(0)))
                return F.concat(stays, F.when((p["to"] >= low) & (p["to"] < high), p["mask"]).otherwise(""))

            return F.array_join(F.transform(F.filter(kept, lambda p: (p["to"] >= low) & (p["from"] <= high)), one), "")

        return bound(F.substring(text, low + 1, F.lit(BLOCK)), written)

    def whole(at: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int"))
        return bound(pieces(at, F.length(text)), lambda kept: F.array_join(F.transform(blocks, lambda b: block(kept, b)), ""))

    return bound(spans, lambda at: F.when(F.size(at) > 0, whole(at)).otherwise(text))


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs` with each secret of the text replaced by `mask`; overlapping ones by one mask.

    Other columns are as they were, whatever their names; a null text stays null.
    """
    plain, names = apart(docs)
    found = scanned(plain, names[text])
    return together(found, names, **{names[text]: masked(F.col(names[text]), F.col("spans"), mask)})
