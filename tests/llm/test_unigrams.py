"""The unigram model learnt from a table, and the counts of all rows, against plain Python."""

import math
from collections import Counter
from functools import cache

import pytest
import regex

from basewright.llm import queries as q
from basewright.llm import trie_counts
from basewright.llm.pieces import LONG_RUN
from basewright.llm.speculative_bpe import SPLIT

SF_DIR = "/root/testdata/sf0.001"
RANKS = trie_counts._ranks(q.RANKED_VOCABULARY)
LONGEST = max(map(len, RANKS))
SPLITTER = regex.compile(SPLIT)


@cache
def merged(word):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, at = min((RANKS.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def model_of(texts):
    counts = Counter(t for text in texts for word in SPLITTER.findall(text or "") for t in merged(word.encode()))
    return {t: math.log((counts[t] + 1) / (counts.total() + len(RANKS))) for t in RANKS}


def counted(text, log_p, known):
    n_words, tokens, score = 0, 0, 0.0
    for word in SPLITTER.findall(text or ""):
        word = word.encode()
        if word not in known:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                starts = range(max(0, end - LONGEST), end)
                best.append(max((best[s][0] + log_p[word[s:end]], best[s][1] - 1) for s in starts if word[s:end] in log_p))
            known[word] = best[-1]
        n_words, tokens, score = n_words + 1, tokens - known[word][1], score + known[word][0]
    return n_words, tokens, score


def same(found, texts):
    log_p, known = model_of(texts.values()), {}
    assert math.isclose(sum(map(math.exp, log_p.values())), 1)
    assert len(found) == len(texts)
    for r in found:
        words, tokens, score = counted(texts[r["doc_id"]], log_p, known)
        assert (r["n_pretokens"], r["n_tokens"]) == (words, tokens)
        assert math.isclose(r["log_score"], score, rel_tol=1e-9, abs_tol=1e-9)


def test_all_given_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    same(q.op4_token_counts(spark, SF_DIR).collect(), texts)


def test_odd_texts_repeated_rows_and_null_ids(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 2_000), (5, "a b " * 3_000), (None, "no id, é中🙂"), (7, "don't 'S \x85 <|endoftext|>"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS token", "2 AS n_tokens", "3 AS row")
    got = trie_counts.token_counts(df, q.RANKED_VOCABULARY).collect()
    log_p, known = model_of([t for _, t in rows]), {}
    wanted = [(i, *counted(t, log_p, known)) for i, t in rows]
    order = lambda x: (str(x[0]), *x[1:])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(wanted, key=order), strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("text", ["a" * (LONG_RUN + 5), " " * (2 * LONG_RUN + 1) + "end", "word " * 200_000])
def test_very_long_texts_are_counted_whole(spark, text):
    counts = trie_counts.merged_counts(spark.createDataFrame([(text,)], "text string"), q.RANKED_VOCABULARY).collect()
    of_rank = {i: t for t, i in RANKS.items()}
    assert sum(len(of_rank[r["token"]]) * r["n"] for r in counts) == len(text.encode())


def test_an_empty_table_has_equal_probabilities(spark):
    log_p = trie_counts.learnt(spark.createDataFrame([], "text string"), q.RANKED_VOCABULARY)
    assert all(math.isclose(math.exp(log_p[i]), 1 / len(RANKS)) for i in RANKS.values())
