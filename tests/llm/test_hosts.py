"""Host verdicts of the quality rules: planted hosts, plain Python, odd column names."""

import math
import random

import duckdb
import pytest
from brute import quality as measured
from pyspark.sql import functions as F

from basewright.llm import quality as rules
from basewright.llm import queries as q

CLEAN = " ".join(f"word{i}" for i in range(100))
SYMBOLS, SHORT = CLEAN + " #" * 20, "too short"


def planted():
    """Ten hosts alike, one bad at symbols, one bad at the hard rules, one that is bad by chance only."""
    pick, rows = random.Random(2), []
    for host in [*(f"h{i}" for i in range(10)), None]:
        rows += [(pick.choices([CLEAN, SYMBOLS, SHORT], [90, 5, 5])[0], host) for _ in range(200)]
    rows += [(pick.choices([CLEAN, SYMBOLS, SHORT], [60, 35, 5])[0], "symbols") for _ in range(200)]
    rows += [(pick.choices([CLEAN, SYMBOLS, SHORT], [45, 5, 50])[0], "short") for _ in range(200)]
    rows += [(SYMBOLS, "once"), (CLEAN, "once"), (CLEAN, "once")]
    return [(i, t, h) for i, (t, h) in enumerate(rows)]


def verdicts(docs):
    """doc_id -> kept, in plain Python."""
    tried = {}
    for i, text, _ in docs:
        m = measured(text)
        w, lines = m["n_words"], len([x for x in (text or "").split("\n") if x.split()])
        soft = [
            m["word_chars"] < 2 * w or m["word_chars"] > 15 * w, 10 * m["n_symbols"] > w,
            m["n_dup_lines"] > 5 and 10 * m["n_dup_lines"] > 3 * lines, 100 * m["n_repeat_words"] > 30 * w,
        ]
        tried[i] = [*soft, w < 50 or 100 * m["n_repeat_words"] > 50 * w]
    hosts = {h: [i for i, _, x in docs if x == h] for h in {h for _, _, h in docs}}
    bad = set()
    for k in range(5):
        rate = {h: sum(tried[i][k] for i in ids) / len(ids) for h, ids in hosts.items()}
        n, mean = len(docs), sum(t[k] for t in tried.values()) / len(docs)
        between = sum(rate[h] ** 2 * len(hosts[h]) for h in hosts) / n - mean**2 - mean * (1 - mean) * len(hosts) / n
        strength = mean * (1 - mean) / between if between * rules.MAX_STRENGTH > mean * (1 - mean) else rules.MAX_STRENGTH
        for h, ids in hosts.items():
            r = (rate[h] * len(ids) + mean * strength) / (len(ids) + strength)
            low = r - rules.SURE * math.sqrt(r * (1 - r) / (len(ids) + strength + 1))
            if low * (1 - mean) > rules.TIMES * mean * (1 - low):
                bad.add((h, k))
    kept = {i: not tried[i][4] and not any(t and ((h, k) in bad or (h, 4) in bad) for k, t in enumerate(tried[i][:4])) for i, _, h in docs}
    return kept, bad


def test_planted_hosts_are_bad_and_no_others(spark):
    docs = planted()
    wanted, bad = verdicts(docs)
    assert bad == {("symbols", 1), ("short", 4)}
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in rules.judged(df).collect()}
    assert got == wanted
    assert all(got[i] for i, t, _ in docs if t == CLEAN)
    assert {h for i, t, h in docs if t == SYMBOLS and not got[i]} == {"symbols", "short"}


def test_planted_hosts_by_sql(spark, tmp_path):
    df = spark.createDataFrame(planted(), "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        found = c.execute(q.ORACLES["op10_quality_rules"]).fetchall()
        names = [d[0] for d in c.description]
    got = q.QUERIES["op10_quality_rules"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found)
    assert any(not r["kept"] and not r["base_failed"] for r in got)


def test_given_documents_have_the_verdicts_of_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert {r["doc_id"]: r["kept"] for r in q.QUERIES["op10_quality_rules"](spark, folder).collect()} == verdicts(docs)[0]


@pytest.mark.parametrize("name", ["_m", "_bad", "_host", "_soft_symbols", "_lines", "_c0", "host", "rule", "a.b"])
def test_columns_of_any_name_come_back(spark, name):
    docs = [(1, CLEAN, "a", "x"), (1, CLEAN, "a", "x"), (None, None, None, None)]
    df = spark.createDataFrame(docs, f"doc_id long, text string, source string, `{name}` string")
    got = rules.judged(df).select("doc_id", F.col(f"`{name}`").alias("v"), "kept").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x", True), (1, "x", True), (None, None, False)]
