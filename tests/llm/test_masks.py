"""Masked secrets: whole texts against plain Python, long texts in time, no text left in other columns."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basewright.llm import frames, secret_scan


def plainly(text, spans, mask="[SECRET]"):
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out.append(text[at:start] + mask)
        at = max(at, end)
    return "".join(out) + text[at:]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200, 9000])
def test_running_values(spark, n):
    values = [random.Random(n).randrange(-50, 50) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(
        frames.running(F.col("v"), lambda a, b: a + b).alias("sums"), frames.running(F.col("v"), F.greatest).alias("tops")
    ).first()
    assert row["sums"] == [sum(values[: i + 1]) for i in range(n)] and row["tops"] == [max(values[: i + 1]) for i in range(n)]


def test_masks_against_plain_python(spark, monkeypatch):
    """Spans that touch, overlap, lie inside each other and cross the blocks a text is cut into."""
    monkeypatch.setattr(secret_scan, "BLOCK", 32)
    pick, rows = random.Random(4), []
    for i in range(300):
        text = "".join(pick.choices("ab é\U0001f600", k=pick.randrange(0, 200)))
        spans = sorted((a, min(len(text), a + pick.randrange(1, 60))) for a in (pick.randrange(max(len(text), 1)) for _ in range(pick.randrange(5))) if a < len(text))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "id int, text string, spans array<struct<start:int,end:int>>")
    got = df.select("id", secret_scan.masked(F.col("text"), F.col("spans"), "[SECRET]").alias("m")).collect()
    assert {r["id"]: r["m"] for r in got} == {i: plainly(t, s) for i, t, s in rows}


def test_spans_beside_others(spark):
    pick, rows = random.Random(5), []
    drawn = lambda n: sorted((a, a + pick.randrange(1, 9)) for a in pick.sample(range(150), n))
    for i in range(300):
        rows.append((i, drawn(pick.randrange(9)), drawn(pick.randrange(9))))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"id int, spans {kind}, base {kind}")
    got = {r["id"]: [tuple(s) for s in r["s"]] for r in df.select("id", secret_scan.not_overlapping(F.col("spans"), F.col("base")).alias("s")).collect()}
    assert got == {i: [s for s in spans if not any(b[0] < s[1] and s[0] < b[1] for b in base)] for i, spans, base in rows}


def test_a_long_text_of_secrets_takes_time_in_proportion(spark):
    """32,000 hexadecimal words in one text; the plan is made before the clock starts."""
    pick = random.Random(6)
    words = ["".join(pick.choices("0123456789abcdef", k=16)) for _ in range(32_000)]
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")
    scanned = secret_scan.scanned(df)
    began = time.monotonic()
    [row] = scanned.collect()
    assert time.monotonic() - began < 30
    assert [(s["start"], s["end"], s["found"]) for s in row["spans"]] == [(17 * i, 17 * i + 16, w) for i, w in enumerate(words)]


def test_no_column_holds_the_secret(spark):
    """Columns with the names that the scan uses inside come back as they were."""
    key = "token=abcdefghijklmnop"
    df = spark.createDataFrame([(1, f"x {key} y", "en", "s", 26, "p", [1], 7, "b", "t", "a")], "doc_id long, text string, lang string, source string, n_chars long, _plain string, spans array<int>, _before int, base string, tried string, _c0 string")
    [row] = secret_scan.redacted(df).collect()
    assert row.asDict() == {**df.first().asDict(), "text": "x [SECRET] y"}
    [row] = corpus_pipeline.secret_scans(spark, df, "").collect()
    assert row.asDict() == {**df.first().asDict(), "text": "x [SECRET] y", "n_chars": 12}
    nothing = df.withColumn("text", F.lit(None).cast("string"))
    assert corpus_pipeline.secret_scans(spark, nothing, "").first()["text"] is None
    assert secret_scan.scanned(df).columns == [*(c for c in df.columns if c != "spans"), "spans"]
