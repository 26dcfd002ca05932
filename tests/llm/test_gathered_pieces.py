"""Pieces of many texts gathered at once, and words that go on from the one before, against one by one."""

import math
import random

import pytest

from basewright.llm import queries as q
from basewright.llm import trie_counts
from basewright.llm.pieces import ODD, Pieces


def texts():
    pick = random.Random(2)
    odd = ["", " ", "\n", "\n\n", "a", "a b " * 10, "A\tb  c", "\r\n", "don't 'S \x85 <|endoftext|>", "é中🙂"]
    return odd + ["".join(pick.choices("ab é\n\t'0.", k=pick.randrange(30))) for _ in range(300)]


@pytest.mark.parametrize("spaces", [True, False])
def test_gathered_values_are_those_of_each_text(spaces):
    new = lambda: Pieces(lambda pieces: [len(p) for p in pieces], spaces)
    values, place, lengths = new().gathered(texts())
    found, at = [], 0
    for n in lengths.tolist():
        here = [values[i] for i in place[at : at + n]]
        found.append(None if ODD in here else here)
        at += n
    assert at == len(place) and found == new().values(texts())
    assert len(values) == len({p for t in texts() for p in new().split(t)})


@pytest.fixture(scope="module")
def log_p():
    ranks = trie_counts._ranks(q.RANKED_VOCABULARY)
    return [-1.0 - (7 * rank) % 1000 / 100 for rank in range(max(ranks.values()) + 1)]


def test_counts_do_not_depend_on_the_words_before(log_p):
    words = sorted({w.encode() for t in texts() for w in [t, *t.split()]})
    mixed = random.Random(4).sample(words, len(words))
    one_by_one = {w: trie.counts([w])[0] for trie in [trie_counts.UnigramTrie(q.RANKED_VOCABULARY, log_p)] for w in words}
    trie = trie_counts.UnigramTrie(q.RANKED_VOCABULARY, log_p)
    assert trie.counts(mixed) == [one_by_one[w] for w in mixed]
    assert trie.counts(words) == [one_by_one[w] for w in words]


def test_the_number_of_texts_together_changes_no_count(log_p, monkeypatch):
    trie = trie_counts.UnigramTrie(q.RANKED_VOCABULARY, log_p)
    together = list(trie.of_texts([None, *texts()]))
    monkeypatch.setattr(trie_counts, "CHARS_AT_ONCE", 20)
    for a, b in zip(trie.of_texts([None, *texts()]), together, strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-11, abs_tol=1e-11)
