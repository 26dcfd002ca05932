"""Quality rules, judged with the host a document comes from.

Each document is measured and tried against two sets of rules. A document that breaks a
hard rule goes. Breaking a soft rule is weak evidence on its own (lists and code do it
too), so it counts only where the host is bad at that rule: failures are summed per host,
each host's rate is shrunk towards that of all hosts by a beta prior fitted to the hosts'
rates, and the host's verdict is joined back to its documents. A document that breaks no
rule stays whatever its host.

Defined results: a null or empty text has no words and fails. Documents without a host
form one host. With an empty table the result is empty. Repeated rows are judged alike,
each on its own. Columns of the input that carry one of the names in `MEASURES`,
`base_failed` or `kept` are replaced; all others come back as they were, whatever their name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.shared import written
from .frames import WORD, apart, bound, words

SYMBOL = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is bad at a rule when its odds of failure are surely above so many times those of all documents.
TIMES = 3
#: Surely: by so many standard deviations of the posterior.
SURE = 2
#: Strength of the prior, in documents, where hosts differ no more than chance lets them.
MAX_STRENGTH = 1000.0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rules that count only with a bad host: SQL conditions over the measures.
SOFT_RULES = {
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_dup_lines > 5 AND 10 * n_dup_lines > n_lines * 3",
    "repeats": "100 * n_repeat_words > 30 * n_words",
}


#: Failures of the hard rules, among the rules a host can be bad at.
HARD = "hard"


def repeat_words(found: Column) -> Column:
    """Words in three-word windows that occur twice or more; `found` is an array of words.

    Windows are compared by their 64-bit hash. Only a text in which one recurs has
    its windows sorted.
    """

    def starts(s: Column) -> Column:
        """Where the windows begin that equal a neighbour in sorted order."""
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        again = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | same(x, F.get(s, j - 1)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def spread(p: Column) -> Column:
        step = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def covered(hashes: Column) -> Column:
        at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        recurs = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(recurs, bound(at, lambda s: bound(starts(s), spread))).otherwise(F.lit(0))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(found) - 3),
        lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)),
    )
    return F.when(F.size(found) < 4, F.lit(0)).otherwise(bound(hashes, covered))


def measures(text: Column) -> Column:
    """A struct of the measures of a text, and its lines that have a word."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    # One opaque value, so that reading its fields never computes it again.
    return bound(
        words(text),
        lambda w: bound(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
            ),
        ),
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measures, `base_failed`, and one boolean `_soft_<rule>` per soft rule."""
    kept = [c for c in docs.columns if c not in (*MEASURES, "base_failed", "kept")]
    got = docs.select(*kept, measures(F.col(text)).alias("_m"))
    got = got.select(*kept, *(F.col(f"_m.{m}") for m in MEASURES), F.col("_m.n_lines").alias("_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    got = got.withColumn("base_failed", failed)
    for name, rule in SOFT_RULES.items():
        got = got.withColumn(f"_soft_{name}", F.expr(rule.replace("n_lines", "_lines")))
    return got.drop("_lines")


def host_rates(tried: DataFrame, host: str) -> DataFrame:
    """Per host and rule (the hard ones count as one): documents, failures, the rate shrunk by an empirical beta prior, `bad`.

    The prior has the mean rate of all documents; its strength follows from how much
    the hosts' rates differ beyond what their sizes explain (method of moments).
    """
    counts = tried.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f"_soft_{r}")).alias(r) for r in SOFT_RULES), F.count_if("base_failed").alias(HARD)
    )
    long = written(counts, "hosts").select(
        "host", "n", F.explode(F.create_map(*[x for r in (*SOFT_RULES, HARD) for x in (F.lit(r), F.col(r))])).alias("rule", "failures")
    )
    mean = F.sum("failures") / F.sum("n")
    spread = F.sum(F.col("failures") * F.col("failures") / F.col("n"))
    prior = long.groupBy("rule").agg(
        mean.alias("mean"), (spread / F.sum("n") - mean * mean).alias("var"),
        (F.count(F.lit(1)) / F.sum("n")).alias("per_doc"),
    )
    chance = F.col("mean") * (1 - F.col("mean"))
    between = F.col("var") - chance * F.col("per_doc")
    strength = F.when(between * MAX_STRENGTH > chance, chance / between).otherwise(F.lit(MAX_STRENGTH))
    prior = prior.select("rule", "mean", strength.alias("strength"))
    rated = long.join(prior, "rule").withColumn(
        "rate", (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    )
    low = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return rated.withColumn("bad", low * (1 - F.col("mean")) > TIMES * F.col("mean") * (1 - low))


def judged(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """`docs` with the measures, `base_failed` and `kept`."""
    own, at = apart(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "base_failed", "kept"))))
    tried = measured(own, at[text])
    bad = (
        host_rates(tried, at[host])
        .where("bad")
        .groupBy("host")
        .agg(F.collect_set("rule").alias("_bad"))
        .withColumnRenamed("host", "_host")
    )
    both = tried.join(bad, F.col(at[host]).eqNullSafe(F.col("_host")), "left")
    counts = lambda r: F.coalesce(F.array_contains("_bad", r) | F.array_contains("_bad", HARD), F.lit(False))
    kept = reduce(lambda a, r: a & ~(F.col(f"_soft_{r}") & counts(r)), SOFT_RULES, ~F.col("base_failed"))
    return both.select(*(F.col(n).alias(c) for c, n in at.items()), *MEASURES, "base_failed", kept.alias("kept"))


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with the columns they came with.

    The measures are taken under names of their own, so that no column is replaced.
    """
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    got = judged(plain, at[text], at[host]).where("kept")
    return got.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
