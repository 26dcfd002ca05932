"""Near copies: families of any size, any ids, and the pipeline's stages, against plain Python."""

import random

import pytest
from brute import jaccard_components, quality
from pyspark.sql import functions as F

import corpus_pipeline
from basewright.llm import grouped_join as G


def family(pick, n, words=150, most=3):
    """Copies with one to `most` words changed: with up to two, nearly all link to those with one."""
    base = [f"w{pick.randrange(10**6)}" for _ in range(words)]
    found = []
    for _ in range(n):
        own = list(base)
        for _ in range(pick.randrange(1, most + 1)):
            own[pick.randrange(words)] = f"x{pick.randrange(10**6)}"
        found.append(" ".join(own))
    return found


def components(spark, docs, near):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in G.joined(df, near).collect()}


def test_ids_of_any_size(spark):
    pick = random.Random(1)
    same = family(pick, 1)[0]
    ids = [2**62 + 5, 2**62 + 9, -(2**63), 2**63 - 1, 0, 2**62]
    docs = [(i, same) for i in ids] + [(2**62 + 77, "another text of a few words"), (-5, "another text of a few words")]
    got = components(spark, docs, G.Near(3, 90))
    assert got == jaccard_components(docs)
    assert {got[i][1] for i in ids} == {-(2**63)}
    nameless = [*docs, (None, same), (None, "nothing like the others at all")]
    df = spark.createDataFrame(nameless, "doc_id long, text string")
    rows = G.joined(df, G.Near(3, 90)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == got
    assert sorted((r["component_id"] is None, r["component_id"]) for r in rows if r["doc_id"] is None) == [(False, -(2**63)), (True, None)]


def test_a_family_is_joined_without_all_its_pairs(spark, monkeypatch):
    """Candidate pairs grow about in proportion to the family."""
    seen = []
    monkeypatch.setattr(G, "FEW_PAIRS", 1000)
    real = G.not_too_different
    monkeypatch.setattr(G, "not_too_different", lambda pairs, *rest: (seen.append(pairs.count()), real(pairs, *rest))[1])
    counts = {}
    for n in (250, 1000):
        pick, seen[:] = random.Random(n), []
        docs = list(enumerate(family(pick, n, most=2)))
        got = components(spark, docs, G.Near(5, 80))
        counts[n] = sum(seen)
        if n == 250:
            assert {i: c for i, (_, c) in got.items()} == brute_components(docs, 5, 80)
    assert counts[1000] < 7 * counts[250]


def brute_components(docs, words, near):
    # The lone shingle of a text with fewer words is all of them; a text without words has none.
    sets = {i: {tuple(w[k : k + words]) for k in range(max(len(w) - words, 0) + 1)} - {()} for i, w in ((i, t.split()) for i, t in docs)}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= near * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    parent[y] = x
    return {i: top(i) for i in sets}


DOCS = "doc_id long, text string, lang string, source string, n_chars long, _dropped string, _before int, component string, id int, n int, _host string"


def odd_documents():
    pick = random.Random(3)
    good = [" ".join(f"g{pick.randrange(5000)}" for _ in range(80)) for _ in range(6)]
    texts = [None, "", "few words", *good, *good[:2], good[0] + " one more", good[3] + " password=abcdefghijklmnop", *family(pick, 6, 90)]
    rows = [(i, t, "en", "s", None if t is None else len(t), "d", 1, "c", 2, 3, "h") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, good[0], "en", None, 9, None, None, None, None, None, None), (None, good[5] + " x", "en", None, 9, None, None, None, None, None, None)]


def test_stage_near_duplicates(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    component = brute_components([(r[0], r[1] or "") for r in rows if r[0] is not None], 5, 80)
    wanted = sorted(r for r in rows if r[0] is not None and component[r[0]] == r[0])
    assert sorted(tuple(r) for r in got.collect() if r["doc_id"] is not None) == wanted
    assert not [r for r in got.collect() if r["doc_id"] is None]  # both link to a document with an id


def test_stage_quality_rules(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.quality_rules(spark, df, "")
    assert got.columns == df.columns
    ok = lambda t: quality(t)["n_words"] >= 50 and 2 * quality(t)["n_repeat_words"] <= quality(t)["n_words"]
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if ok(r["text"]))


def test_stage_packing(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows[:-2], DOCS)
    got = corpus_pipeline.best_fit_packing(spark, df, "").collect()
    at = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert {r["doc_id"] for r in got} == {r[0] for r in rows[:-2]}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), "").count() == 0


def test_the_pipeline_is_its_stages(spark):
    """run() on a given table: as many documents as the stages keep one after the other, each whole."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    placed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in placed.select("doc_id").distinct().collect()} == kept and len(kept) > 50
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
