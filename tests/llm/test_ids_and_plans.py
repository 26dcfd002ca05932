"""Ids against the tokenizers library; packing plans made by the program."""

import json
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from basewright.llm import packing, pieces
from basewright.llm import queries as q
from basewright.llm.pieces import LONG_RUN, IdEncoder

ODD = [
    None, "", " ", "\n", "  a  b", "a\n\n b\t c\r\n", "x\x01y \x01 z", "\x01", "<|endoftext|>", "a <|endoftext|>b<|startoftext|> c",
    "don't DON'T we'll 're 'x", "é ́a b́ é", " a b c\x85d\x1ce", "İstanbul ǅ ß ﬁ", "日本語 テスト 한국어", "🙂🙂‍🔥 a",
    "1234567 12 3", "a" * 3000, "!" * 3000 + " x", "a" + " " * (LONG_RUN + 5) + "b", "ab" * LONG_RUN, "\n" * (LONG_RUN + 5),
]


@pytest.mark.parametrize("name", [q.BYTE_VOCABULARY, q.WORD_VOCABULARY])
def test_ids_are_those_of_the_library(name):
    encoder = IdEncoder(name)
    rng = random.Random(3)
    some = [chr(i) for i in [*range(0x20, 0x250), *range(0x300, 0x600), *range(0x2000, 0x2070), *range(0x1F600, 0x1F640)]]
    drawn = ["".join(rng.choices(some, k=rng.randrange(1, 60))) + " " * rng.randrange(3) + "word, Word." for _ in range(1500)]
    texts = ODD + drawn
    for _ in range(2):  # the second time from what is remembered
        got = list(encoder.encode(texts))
        want = [e.ids for e in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == want


def test_both_vocabularies_take_their_short_way():
    assert IdEncoder(q.BYTE_VOCABULARY).whole
    assert IdEncoder(q.WORD_VOCABULARY).between is not None


def test_merges_out_of_order_go_to_the_library():
    from basewright.llm.pieces import PLAIN_BYTES, _byte_ranks

    plain = [chr(b) for low, high in PLAIN_BYTES for b in range(low, high + 1)]
    letters = plain + [chr(256 + i) for i in range(256 - len(plain))]
    vocab = {c: i for i, c in enumerate(letters)} | {"ab": 256, "abc": 257, "<e>": 258}
    layout = {"model": {"type": "BPE", "vocab": vocab, "merges": [["a", "b"], "ab c"]}}
    assert _byte_ranks(layout, ["<e>"])[b"abc"] == 257
    assert _byte_ranks({"model": layout["model"] | {"vocab": vocab | {"ab": 257, "abc": 256}}}, ["<e>"]) is None
    assert _byte_ranks({"model": layout["model"] | {"merges": [["a", "b"]]}}, ["<e>"]) is None
    assert _byte_ranks({"model": layout["model"] | {"ignore_merges": True}}, ["<e>"]) is None


def test_best_configuration_is_the_dearest():
    rng = np.random.default_rng(1)
    for capacity in (1, 2, 7, 40):
        for _ in range(20):
            price = np.full(capacity + 1, -np.inf)
            lengths = rng.choice(np.arange(1, capacity + 1), max(1, capacity // 3), False)
            price[lengths] = rng.random(len(lengths)) * lengths
            value = np.zeros(capacity + 1)
            for c in range(1, capacity + 1):
                value[c] = max([value[c - 1]] + [price[x] + value[c - x] for x in lengths if x <= c])
            chosen = packing.best_configuration(price, capacity)
            assert sum(chosen) <= capacity
            assert sum(price[x] for x in chosen) == pytest.approx(value[capacity])


def test_the_plan_is_the_programs():
    encoder, counts = IdEncoder(q.BYTE_VOCABULARY), Counter()
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for raw in encoder.encode(texts):
        n = len(raw) // encoder.dtype.itemsize + 1
        counts[n % q.SEQUENCE or q.SEQUENCE] += 1
        counts[q.SEQUENCE] += (n - 1) // q.SEQUENCE
    parts = {x: n for x, n in counts.items() if x != q.SEQUENCE and n}
    programs = [packing.configurations(parts, q.SEQUENCE, step)[0] for step in (packing.SHARE, packing.LEAST_SHARE)]
    patterns = packing.plan(dict(counts), q.SEQUENCE)
    inside = [(tuple(items), times) for items, times in patterns]
    assert any(all((tuple(i), t) in inside for i, t in p) and sum(t for _, t in p) > len(inside) / 10 for p in programs)
    got = Counter()
    for items, times in patterns:
        assert sum(items) <= q.SEQUENCE
        for x in items:
            got[x] += times
    assert got == +counts
    fewest = -(-sum(x * n for x, n in counts.items()) // q.SEQUENCE)
    assert sum(t for _, t in patterns) <= max(fewest + 1, fewest * 1.001)


def test_every_token_of_the_word_vocabulary_is_what_its_own_bytes_merge_to():
    """What merging by joined strings rests on; see `_word_ranks`."""
    with open(pieces.vocabulary_path(q.WORD_VOCABULARY), encoding="utf-8") as f:
        layout = json.load(f)
    ranks, ids = pieces._word_ranks(layout, [t["content"] for t in layout["added_tokens"]])
    pair_rank = {}
    for i, m in enumerate(layout["model"]["merges"]):
        pair_rank[tuple(m.split(" ") if isinstance(m, str) else m)] = i
    for token in layout["model"]["vocab"]:
        if token.startswith("<|"):
            continue
        body = token.removesuffix("</w>")
        parts = list(body)
        if body != token:
            parts[-1] += "</w>"
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda k: pair_rank.get((parts[k], parts[k + 1]), 1 << 30))
            assert (parts[at], parts[at + 1]) in pair_rank, token
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
    assert len(ranks) == len(ids) == len(set(ids))


def test_plain_and_odd_pieces_have_the_ids_of_the_library():
    encoder, pick = IdEncoder(q.WORD_VOCABULARY), random.Random(3)
    assert encoder.words is not None
    letters = "theinganotsé ÉßŒſĳŉİıÀÿŸƏǅ'sT’“”…–.,;:!?()[]<|>_#$%&0123456789½²ªº\xad\xa0\x01\x02\x1c\x7f\x85\tΣσς中文🙂́ﬁK"
    parts = ["the", "ing", "'s", "'LL", "n't", "<|endoftext|>", "<|", "http://", "1999", "naïve", *letters]
    some = ["", "A" * 999, "Ab" * 700, *("".join(pick.choices(parts, k=pick.randrange(1, 9))).replace(" ", "") for _ in range(30_000))]
    wanted = [encoder._bytes(e.ids) for e in encoder.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    assert encoder._encode_pieces(some) == wanted
    texts = [" ".join(pick.choices(some, k=20)) + "\n" for _ in range(300)]
    assert list(encoder.encode(texts)) == [encoder._bytes(e.ids) for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
