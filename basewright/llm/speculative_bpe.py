"""Byte-level BPE by speculation: guess a word's tokens, check them, merge exactly where the guess fails.

Greedy longest match proposes tokens for a word. They are its BPE tokens exactly if
each token stands for itself and no two neighbours would have been merged across their
border, which can be read off the merge ranks by undoing the neighbours' own merges,
latest first. All neighbours of all new words of a batch are checked at once, as
arrays. Words that fail are merged exactly, lowest rank first; where the merges stand in
order of id, as in public vocabularies, tiktoken does this for words of usual length.

Defined results: a null or empty text has no ids and decodes to nothing. Texts are
encoded whole at any length; a special token's string becomes its id, as the tokenizers
library has it. Repeated rows are encoded alike, each on its own; empty tables give
empty results.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches
from .pieces import TEXTS_AT_ONCE, Pieces, _byte_ranks, vocabulary_path

#: Fixed value: how text is split before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Control characters that the `regex` module takes for white space and the library doesn't.
NO_SPACE = "\x1c\x1d\x1e\x1f"
#: Words up to this many bytes are merged by plain scans.
SHORT = 48
#: Words up to this many bytes are merged by tiktoken, where the vocabulary allows it.
USUAL = 400


def _byte_alphabet() -> dict[str, int]:
    """The vocabulary writes printable bytes as themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    def __init__(self, path: str):
        import numpy as np
        from tokenizers.pre_tokenizers import ByteLevel

        with open(vocabulary_path(path), encoding="utf-8") as f:
            layout = json.load(f)
        before = layout.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or layout.get("normalizer"):
            raise ValueError("only byte-level vocabularies without a normalizer are supported")
        self.alphabet = alphabet = _byte_alphabet()
        vocab = layout["model"]["vocab"]
        raw = {t: bytes(alphabet[c] for c in t) for t in vocab}
        self.id_of = {raw[t]: i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in layout["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        #: Rank of the merge of two ids (`left * size + right`), and what each rank makes.
        self.merge_rank: dict[int, int] = {}
        self.made: list[int] = []
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1 for a byte
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for rank, pair in enumerate(layout["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.made.append(made)
            if self.merge_rank.setdefault(vocab[a] * size + vocab[b], rank) == rank and self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, vocab[a], vocab[b]
        self.size = size
        keys, ranks = (np.array(list(x), np.int64) for x in (self.merge_rank.keys(), self.merge_rank.values()))
        order = np.argsort(keys)
        self.pairs, self.pair_rank = keys[order], ranks[order]
        #: Tokens that BPE makes of their own bytes; only these are proposed.
        self.proposed = {b: i for b, i in self.id_of.items() if len(b) == 1 or self.exact(b) == [i]}
        self.longest = max(map(len, self.proposed))
        # Merging by joined strings is the same only if each token stands for itself.
        ranks = _byte_ranks(layout, self.special)
        self.by_rank = None
        if ranks and all(b in self.proposed for b in ranks):
            import tiktoken

            # The pattern takes a word as it is.
            self.by_rank = tiktoken.Encoding("word", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.splitter, self.rare = regex.compile(SPLIT), regex.compile("[\\x1c-\\x1f]|[^\\x00-\u024f]")
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[bytes, list[int]] = {}
        self.pieces = Pieces(self._of_pieces, True, self.special)
        self.failed = self.tried = 0

    def exact(self, word: bytes) -> list[int]:
        """The ids of a word by merging, lowest rank first, then leftmost."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        return self._merged(ids) if len(ids) <= SHORT else self._merged_long(ids)

    def corrected(self, word: bytes) -> list[int]:
        """The ids of a word whose guess failed; the same as `exact` gives."""
        return self.by_rank(word.decode()) if self.by_rank and len(word) <= USUAL else self.exact(word)

    def _merged(self, ids: list[int]) -> list[int]:
        rank_of, size, none = self.merge_rank.get, self.size, len(self.made)
        ranks = [rank_of(a * size + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i : i + 2] = [self.made[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] * size + ids[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] * size + ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, so that a word of any length takes about linear time."""
        rank_of, size, n = self.merge_rank.get, self.size, len(ids)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = [ids[i] * size + ids[i + 1] for i in range(n - 1)]
        heap = [(rank, i, p) for i, p in enumerate(pairs) if (rank := rank_of(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = following[i]
            if j >= n or ids[i] < 0 or ids[i] * size + ids[j] != pair:
                continue
            ids[i], ids[j] = self.made[rank], -1
            following[i] = following[j]
            if following[i] < n:
                before[following[i]] = i
            for a in (before[i], i):
                if a >= 0 and following[a] < n:
                    p = ids[a] * size + ids[following[a]]
                    if (rank := rank_of(p)) is not None:
                        heapq.heappush(heap, (rank, a, p))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        known, at, ids, end = self.proposed, 0, [], len(word)
        while at < end:
            stop = min(end, at + self.longest)
            while word[at:stop] not in known:
                stop -= 1
            ids.append(known[word[at:stop]])
            at = stop
        return ids

    def compatible(self, left, right):
        """For arrays of neighbours: whether no merge would have crossed their border."""
        import numpy as np

        good = np.ones(len(left), bool)
        open_, limit = np.arange(len(left)), np.full(len(left), np.iinfo(np.int64).max)
        left, right = left.copy(), right.copy()
        while len(open_):
            key = left * self.size + right
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            crossed = (self.pairs[at] == key) & (self.pair_rank[at] < limit)
            good[open_[crossed]] = False
            # Undo the later of the two tokens' merges; of two alike, the right one came later.
            a, b = self.rank[left], self.rank[right]
            on = ~crossed & ((a >= 0) | (b >= 0))
            undo_left = a > b
            limit = np.where(undo_left, a, b + 1)[on]
            left, right = np.where(undo_left, self.right[left], left)[on], np.where(undo_left, right, self.left[right])[on]
            open_ = open_[on]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        import numpy as np

        ids = [self.propose(w) for w in words]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = owner[:-1] == owner[1:]
        good = self.compatible(flat[:-1][inside], flat[1:][inside])
        for i in np.unique(owner[:-1][inside][~good]).tolist():
            ids[i] = self.corrected(words[i])
            self.failed += 1
        self.tried += len(words)
        return ids

    def _split(self, text: str) -> list[bytes]:
        """Words of a text; by the library's own splitter where Unicode versions may disagree."""
        rare = () if text.isascii() and not any(c in text for c in NO_SPACE) else self.rare.findall(text)
        if rare and any(c in NO_SPACE or unicodedata.category(c) == "Cn" for c in rare):
            return [bytes(map(self.alphabet.__getitem__, w)) for w, _ in self.library.pre_tokenize_str(text)]
        return [w.encode() for w in self.splitter.findall(text)]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts split in one go."""
        cut = [self.between.split(t) if self.between else [t] for t in texts]
        split = [[[s] if s in self.special else self._split(s) for s in parts] for parts in cut]
        words = dict.fromkeys(w for parts in split for part in parts for w in part if isinstance(w, bytes))
        ids = dict(zip(words, self.encode_words(list(words)), strict=True)) if words else {}
        flat = lambda part: [i for w in part for i in (ids[w] if isinstance(w, bytes) else (self.special[w],))]
        return [[i for part in parts for i in flat(part)] for parts in split]

    def _of_pieces(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(ids, "<u4").tobytes() for ids in self._whole(texts)]

    def encode(self, texts: list[str | None]) -> Iterator:
        """The ids of each text as an array."""
        import numpy as np

        texts = [t or "" for t in texts]
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[at : at + TEXTS_AT_ONCE]
            for text, values in zip(some, self.pieces.values(some), strict=True):
                joined = self._of_pieces([text])[0] if values is None else b"".join(values)[4:]
                yield np.frombuffer(joined, "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def speculative_bpe(path: str) -> SpeculativeBpe:
    """One for a worker's life."""
    return SpeculativeBpe(path)


def encoded(docs: DataFrame, vocabulary: str, row: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` and `ids` of every document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = speculative_bpe(vocabulary)
        for batch in batches:
            ids = pa.array([x.astype("int32") for x in bpe.encode(batch.column(1).to_pylist())], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["row", "ids"])

    kind = dict(docs.dtypes)[row]
    got = map_batches(docs.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text")), run, f"row {kind}, ids array<int>")
    return got.withColumnRenamed("row", row)


def decoded(ids: DataFrame, vocabulary: str, row: str = "doc_id") -> DataFrame:
    """`ids` with `text`: what the tokens stand for, special ones included."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = speculative_bpe(vocabulary)
        for batch in batches:
            column = batch.column(1).fill_null([])
            at, ids = column.offsets.to_pylist(), column.values.to_numpy()
            texts = [bpe.decode(ids[i:j].tolist()).decode("utf-8", "replace") for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["row", "ids", "text"])

    kind = dict(ids.dtypes)[row]
    got = map_batches(ids.select(F.col(row).alias("row"), "ids"), run, f"row {kind}, ids array<int>, text string")
    return got.withColumnRenamed("row", row)
