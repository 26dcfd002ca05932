"""Edited texts take words and scores over from the two texts they are made of, and come out as if read anew."""

import random

import pyarrow as pa

from basewright.llm import weighted_sampling
from basewright.llm.shingling import word_hashes, word_hashes_of
from basewright.llm.weighted_sampling import Document


def texts():
    pick = random.Random(1)
    odd = [None, "", " ", "a", "a b", "A B  C", " x", "x ", "é中 ü", "\x1f", "\x0b\x0c a", "a b " * 300]
    return odd + ["".join(pick.choices("ab é\n\x1cC ", k=pick.randrange(40))) for _ in range(300)]


def test_words_of_many_texts():
    for text, found in zip(texts(), word_hashes_of(pa.array(texts(), pa.string())), strict=True):
        assert found.tolist() == word_hashes(text).tolist()
    assert word_hashes_of(pa.array([], pa.string())) == []


def test_an_edited_text_is_as_if_read_anew():
    docs = [Document(t) for t in texts()]
    for one, following in zip(docs, docs[1:], strict=False):
        edited, third = one.edited(following), len(one.text) // 3
        assert edited.text == one.text[: len(one.text) - third] + following.text[:third]
        assert edited.words.tolist() == word_hashes(edited.text).tolist()
        assert edited.fingerprint() == Document(edited.text).fingerprint()


def test_only_shingles_of_neither_text_are_scored(monkeypatch):
    scored, plain = [], weighted_sampling.scores
    one, following = (Document(" ".join(f"{p}{i}" for i in range(900))) for p in "ab")
    monkeypatch.setattr(weighted_sampling, "scores", lambda hashes, weights: scored.append(len(hashes)) or plain(hashes, weights))
    one.edited(following)
    assert sum(scored) <= 2 * weighted_sampling.SHINGLE
