"""Words whose guess fails, and the segmentations a trie node tries."""

import math
import random

import public_tokenizers
from tokenizers import Tokenizer

from basewright.llm import queries as q
from basewright.llm.speculative_bpe import USUAL, SpeculativeBpe
from basewright.llm.trie_counts import UnigramTrie, _ranks


def test_failed_guesses_are_not_merged_pair_by_pair(monkeypatch):
    bpe, pick = SpeculativeBpe(q.BYTE_VOCABULARY), random.Random(3)
    library = Tokenizer.from_file(public_tokenizers.path(q.BYTE_VOCABULARY))
    words = ["".join(pick.choices("abcdefghinorstuéß", k=pick.randint(1, 30))) for _ in range(2000)]
    wanted = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [bpe.exact(w.encode()) for w in words] == wanted
    long = b"ab" * USUAL
    assert bpe.corrected(long) == bpe.exact(long)
    monkeypatch.setattr(bpe, "exact", None)
    assert bpe.encode_words([w.encode() for w in words]) == wanted and bpe.failed


def test_a_node_tries_only_ends_of_tokens():
    ranks, pick = _ranks(q.RANKED_VOCABULARY), random.Random(5)
    log_p = [-pick.uniform(3, 12) for _ in range(max(ranks.values()) + 1)]

    trie = UnigramTrie(q.RANKED_VOCABULARY, log_p)
    words = sorted({"".join(pick.choices("aeinorst ", k=pick.randint(1, 12))).encode() for _ in range(300)})
    for word, (tokens, score) in zip(words, trie.counts(words), strict=True):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            found = [(best[a][0] + log_p[ranks[word[a:end]]], best[a][1] + 1) for a in range(end) if word[a:end] in ranks]
            best.append(max(found))
        assert best[-1][1] == tokens and math.isclose(best[-1][0], score)
    assert trie.ends[b"he"] > -math.inf and all(t[1:] in trie.ends for t in list(ranks)[300:600])
