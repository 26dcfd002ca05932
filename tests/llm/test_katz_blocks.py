"""How the Katz model splits, deals and looks up: blocks instead of a row per pair, and no shuffle files left behind."""

import math
import random

import pyarrow as pa
import pytest

from basewright.llm import katz

ODD = [
    None, "", " \n\t ", "A  b\n\nc\r\n\x1c d e \x85", "é́İſ中文 ÀB\x0b\x0c x", "\x1fA\x00b c d", " lead", "trail ", "x" * 100, " one two",
]


def test_split_has_the_words_of_every_text():
    keys, at, lengths = katz.split(pa.array(ODD, pa.string()))
    wanted = [w for t in ODD for w in katz.tokens(t)]
    assert keys[at].tolist() == katz._word_keys(wanted).tolist()
    assert lengths.tolist() == [len(katz.tokens(t)) for t in ODD]
    assert len(set(keys.tolist())) == len(set(wanted)) and all(k < 0 and k % 2 for k in keys.tolist())


def corpus(n):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    return [(i, " ".join(pick.choices(words, weights=[1 / k for k in range(1, 301)], k=pick.randrange(80)))) for i in range(n)]


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))


def test_steps_leave_no_shuffle_files(spark):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string").repartition(4).localCheckpoint()
    before, option = shuffle_bytes(spark), spark.conf.get(katz.CLEANUP)
    katz.Katz(docs.where("doc_id % 3 > 0"))
    assert shuffle_bytes(spark) <= before + 10_000
    assert spark.conf.get(katz.CLEANUP) == option


def test_a_chunk_sends_each_part_one_block_a_kind(spark):
    docs = spark.createDataFrame(corpus(600), "id long, text string").selectExpr("id", "text", "id % 3 = 0 AS held_out").coalesce(1)
    model = katz.Katz(docs.where("NOT held_out"), 10, 5)
    assert model._asked(docs, 4).count() <= 1 + 3 * 4


@pytest.mark.parametrize("bound", ["HOT_PAIRS", "CHUNK_TOKENS", "CHUNK_TEXTS"])
def test_bounds_change_no_score(spark, monkeypatch, bound):
    docs = spark.createDataFrame(corpus(300) + [(None, "no id w1 w2"), (7, None)], "doc_id long, text string").repartition(3)
    scored = lambda: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["score"], 6)) for r in katz.corpus_scores(docs).collect())
    wanted = scored()
    with monkeypatch.context() as m:
        m.setattr(katz, bound, 10)
        got = scored()
    assert len(got) == 302 and all(a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=2e-6) for a, b in zip(got, wanted, strict=True))
