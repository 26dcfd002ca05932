"""Token counts by a unigram model, with the forward scores of shared prefixes computed once.

The text is split into pre-tokens. The distinct new ones of a batch go into a trie of
bytes; each node holds the best score of any segmentation of the bytes that lead to it,
which depends on those bytes only, so all pre-tokens with that prefix share it. What
stands at a pre-token's last node (tokens, score) is kept as its count.

The vocabulary is a public list of byte strings by rank. The model is learnt from the table
itself: every text is segmented once by the vocabulary's own merges, tokens are counted over
all texts, and p(token) = (count + 1) / (tokens + vocabulary), which sums to 1 and leaves no
token without a probability. Only these counts, one a vocabulary entry, come to the driver. The
segmentation with the highest score is taken; of equal ones, that with fewer tokens.

Defined results: a null or empty text has no tokens and a score of 0. In counting, a text
with a run of more than `LONG_RUN` white or other characters is segmented in slices of that
length. Every byte is in
the vocabulary, so every text can be segmented; texts are taken whole. Repeated rows get
the same counts, each on its own; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches
from .pieces import BYTE_PATTERN, LONG_RUN, ODD, RUN, Pieces, vocabulary_path
from .speculative_bpe import SPLIT

#: A trie with more nodes than this is begun anew: bounds memory, not results.
MAX_NODES = 300_000
#: Characters of texts whose pieces are looked up together (a longer text goes alone).
CHARS_AT_ONCE = 4 << 20
#: Tokens counted together; each count goes over the whole vocabulary.
COUNTED_AT_ONCE = 1_000_000


def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary_path(vocabulary), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _slices(text: str) -> list[str]:
    """The text, or slices of it where a run in it is too long for the splitting pattern."""
    if len(text) <= LONG_RUN or all(m.end() - m.start() <= LONG_RUN for m in RUN.finditer(text)):
        return [text]
    return [text[at : at + LONG_RUN] for at in range(0, len(text), LONG_RUN)]


def merged_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`token` (its rank) and `n`: how often it occurs when the texts are merged by rank."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import tiktoken

        ranks = _ranks(vocabulary)
        encode = tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        n, held = np.zeros(max(ranks.values()) + 1, np.int64), array("q")
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in _slices(text or ""):
                    held.extend(encode(part))
                if len(held) >= COUNTED_AT_ONCE:
                    n += np.bincount(held, minlength=len(n))
                    held = array("q")
        n += np.bincount(np.array(held, np.int64), minlength=len(n))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], names=["token", "n"])

    return map_batches(docs.select(F.col(text)), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def learnt(docs: DataFrame, vocabulary: str, text: str = "text"):
    """Natural logarithms of the probabilities by rank, as an array."""
    import numpy as np

    ranks = _ranks(vocabulary)
    n = np.zeros(max(ranks.values()) + 1)
    for r in merged_counts(docs, vocabulary, text).collect():
        n[r["token"]] = r["n"]
    return np.log((n + 1) / (n.sum() + len(ranks)))


class UnigramTrie:
    """`log_p` has the logarithm of the probability of each rank."""

    def __init__(self, vocabulary: str, log_p):
        self.log_p = {token: float(log_p[rank]) for token, rank in _ranks(vocabulary).items()}
        #: The same for every end of a token, minus infinity where it is none itself: longer strings than these are no tokens.
        self.ends = dict.fromkeys((t[at:] for t in self.log_p for at in range(len(t))), -math.inf) | self.log_p
        if any(bytes([b]) not in self.log_p for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.splitter = regex.compile(SPLIT)
        self.pieces = Pieces(self._of_pieces, True)
        self._clear()

    def _clear(self) -> None:
        #: Child of a node by byte, and per node the best score and its number of tokens.
        self.child: dict[int, int] = {}
        self.score, self.tokens = [0.0], [0]

    def counts(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Tokens and score of each word; sorted words go faster, as each goes on where it parts from the one before."""
        if len(self.score) > MAX_NODES:
            self._clear()
        child, ends, score, tokens, found = self.child.get, self.ends.get, self.score, self.tokens, []
        children, none = self.child, -math.inf
        path, last = [0], b""
        for word in words:
            # The nodes of the prefixes shared with the last word, and then those of the longer ones.
            same = 0
            for x, y in zip(word, last, strict=False):
                if x != y:
                    break
                same += 1
            del path[same + 1 :]
            last, node = word, path[same]
            for at in range(same, len(word)):
                key = node << 8 | word[at]
                node = child(key, -1)
                if node < 0:
                    best, fewest, end = none, 0, at + 1
                    for start in range(at, -1, -1):
                        p = ends(word[start:end])
                        if p is None:
                            break
                        before = path[start]
                        p += score[before]
                        if p > best or p == best and tokens[before] < fewest:
                            best, fewest = p, tokens[before]
                    node = children[key] = len(score)
                    score.append(best)
                    tokens.append(fewest + 1)
                path.append(node)
            found.append((tokens[node], score[node]))
        return found

    def _of_pieces(self, texts: list[str]) -> list[tuple[int, int, float]]:
        """Pre-tokens, tokens and score of each text."""
        split = list(map(self.splitter.findall, texts))
        # Most pieces are one pre-token each.
        distinct = sorted({w.encode() for words in split for w in words})
        known = {w.decode(): value for w, value in zip(distinct, self.counts(distinct), strict=True)}
        found = []
        for words in split:
            if len(words) == 1:
                found.append((1, *known[words[0]]))
            else:
                values = [known[w] for w in words]
                found.append((len(words), sum(v[0] for v in values), math.fsum(v[1] for v in values)))
        return found

    def of_texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, float]]:
        texts = [t or "" for t in texts]
        line_end, at = self._of_pieces(["\n"])[0], 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size + len(texts[at]) <= CHARS_AT_ONCE):
                some.append(texts[at])
                size, at = size + len(texts[at]), at + 1
            yield from self._summed(some, line_end)

    def _summed(self, texts: list[str], line_end: tuple[int, int, float]) -> Iterator[tuple[int, int, float]]:
        import numpy as np

        values, place, lengths = self.pieces.gathered(texts)
        of_text = np.repeat(np.arange(len(texts)), lengths)
        odd = np.bincount(of_text[np.fromiter((v is ODD for v in values), bool, len(values))[place]], minlength=len(texts)) > 0
        columns = zip(*((0, 0, 0.0) if v is ODD else v for v in values), strict=True)
        sums = (np.bincount(of_text, np.array(c, float)[place], len(texts)) - less for c, less in zip(columns, line_end, strict=True))
        words, tokens, scores = (x.tolist() for x in sums)
        for i, text in enumerate(texts):
            yield self._of_pieces([text])[0] if odd[i] else (int(words[i]), int(tokens[i]), scores[i])


_latest: dict[tuple, UnigramTrie] = {}


def unigram_trie(vocabulary: str, log_p) -> UnigramTrie:
    """One for as long as a worker goes on with the same model."""
    key = (vocabulary, log_p.tobytes())
    if key not in _latest:
        _latest.clear()
        _latest[key] = UnigramTrie(vocabulary, log_p)
    return _latest[key]


def token_counts(docs: DataFrame, vocabulary: str, row: str = "doc_id", text: str = "text") -> DataFrame:
    """`row`, `n_pretokens`, `n_tokens` and `log_score` (natural) of every document, by a model learnt from all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(learnt(docs, vocabulary, text))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trie = unigram_trie(vocabulary, shared.value)
        for batch in batches:
            words, tokens, scores = zip(*trie.of_texts(batch.column(1).to_pylist()), strict=True) if len(batch) else ((), (), ())
            columns = [pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "n_pretokens", "n_tokens", "log_score"])

    kind = dict(docs.dtypes)[row]
    got = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    return map_batches(got, run, f"row {kind}, n_pretokens long, n_tokens long, log_score double").withColumnRenamed("row", row)
