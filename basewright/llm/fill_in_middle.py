"""Fill-in-middle: documents cut into prefix, middle and suffix at token ends, rearranged.

Cuts are found by content-defined chunks. A rolling hash over the last 32 bytes cuts a text
where its low bits are zero, so a passage that many documents share falls into the same
chunks wherever it stands. For each chunk a task remembers a boundary summary: code points,
words, and whether it begins and ends inside a word. Chunks are looked up by their whole
content, so that no other chunk's summary is ever taken. Summaries combine: a word that runs
over a chunk's end is counted once, where it ends. The running sums of word ends tell which chunk
holds a cut, and only that chunk is split.

A token is a word with the white space before it, or white space at the end of the text. Whether
and where a document is cut follows from the SHA-256 of a seed and its id alone.

Defined results: a null text is empty; an empty text, and one that contains a marker, stays
plain. A null id hashes as the empty string. Repeated rows are treated alike. An empty table gives an
empty result. Other columns of the input are not carried along. A task holds one text, its chunks' counts
and at most `CACHED_BYTES` of remembered chunks; a text is hashed in blocks.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bound, map_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that are rearranged, and of those that get the suffix first.
REARRANGED, SUFFIX_FIRST = 50, 80
SEED = "42"

#: Bytes the rolling hash looks at (a power of two), and the sizes of chunks.
WINDOW, LEAST, USUAL, MOST = 32, 64, 512, 4096
#: Bytes hashed at once, and bytes of chunks that a task remembers.
BLOCK, CACHED_BYTES = 1 << 20, 32 << 20

_SPACES = frozenset(b"\x20\x09\x0a\x0b\x0c\x0d")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: One well-mixed number per byte value, from a rule.
_MIX = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


class Summary(NamedTuple):
    chars: int
    words: int
    begins_in_word: bool
    ends_in_word: bool


#: What comes after a text.
NOTHING = Summary(0, 0, False, False)


def summary_of(chunk: bytes) -> Summary:
    """The summary of a chunk; bytes.split() knows the same six kinds of white space."""
    return Summary(len(chunk.decode()), len(chunk.split()), chunk[0] not in _SPACES, chunk[-1] not in _SPACES)


def _rolling(block: np.ndarray) -> np.ndarray:
    """At each byte a hash of the `WINDOW` bytes that end there; a sum of 2, 4, 8 ... bytes at a time."""
    h, span = _MIX[block], 1
    while span < WINDOW:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def candidates(data: bytes) -> Iterator[int]:
    """Places where the rolling hash asks for a cut; never inside a character."""
    whole = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(data), BLOCK):
        start = max(0, at - WINDOW + 1)
        block = whole[start : at + BLOCK]
        wanted = (_rolling(block) & np.uint32(USUAL - 1)) == 0
        ends = np.flatnonzero(wanted[at - start :]) + at + 1
        ends = ends[ends < len(data)]
        yield from ends[(whole[ends] & 0xC0) != 0x80].tolist()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text: candidates at least `LEAST` apart, others where a chunk would pass `MOST`."""
    found, last = [], 0

    def forced(until: int) -> None:
        nonlocal last
        while until - last > MOST:
            last += MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            found.append(last)

    for end in candidates(data):
        forced(end)
        if end - last >= LEAST:
            found.append(end)
            last = end
    forced(len(data))
    return [*found, len(data)] if data else []


class Chunks:
    """Summaries of chunks by their content; beyond `CACHED_BYTES` all are forgotten."""

    def __init__(self, limit: int = CACHED_BYTES):
        self.limit, self.held, self.known = limit, 0, {}

    def summary(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            if self.held > self.limit:
                self.known.clear()
                self.held = 0
            found = self.known[chunk] = summary_of(chunk)
            self.held += len(chunk)
        return found


class Counted:
    """A text with the combined counts of its chunks."""

    def __init__(self, data: bytes, chunks: Chunks):
        self.data, self.ends = data, cuts(data)
        self.starts = [0, *self.ends][:-1]
        found = [chunks.summary(data[a:b]) for a, b in zip(self.starts, self.ends, strict=True)]
        #: Word ends and code points up to the end of each chunk; a word that goes on ends later.
        self.word_ends = list(accumulate(s.words - (s.ends_in_word and after.begins_in_word) for s, after in zip(found, [*found[1:], NOTHING])))
        self.chars = list(accumulate(s.chars for s in found))
        self.words = self.word_ends[-1] if found else 0
        self.tokens = self.words + (bool(found) and not found[-1].ends_in_word)

    def token_end(self, k: int) -> tuple[int, int]:
        """Where the k-th token ends, in bytes and in code points; (0, 0) for none."""
        if k == 0:
            return 0, 0
        if k > self.words:
            return len(self.data), self.chars[-1]
        i = bisect_left(self.word_ends, k)
        before, chars = (self.word_ends[i - 1], self.chars[i - 1]) if i else (0, 0)
        chunk = self.data[self.starts[i] : self.ends[i]]
        word = next(islice(_WORD.finditer(chunk), k - before - 1, None))
        return self.starts[i] + word.end(), chars + len(chunk[: word.end()].decode())


def _draws(seed: str, id: object) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


_MARKERS = re.compile(b"|".join(re.escape(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)))


def rearranged(id: object, data: bytes, chunks: Chunks, seed: str = SEED) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    text, (h1, h2, h3, h4) = Counted(data, chunks), _draws(seed, id)
    n = text.tokens
    if not data or h3 % 100 >= REARRANGED or _MARKERS.search(data):
        return n, "plain", None, None, data
    (first, first_chars), (second, second_chars) = (text.token_end(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", first_chars, second_chars - first_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first_chars, second_chars - first_chars, b"".join((p, prefix, s, suffix, m, middle))


#: Bytes of output that a task gathers before it hands them on.
GATHERED = 8 << 20


def filled_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and output of every row."""
    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"

    def batches_of(batches: Iterator) -> Iterator:
        chunks = Chunks()
        for batch in batches:
            ids, texts, got, held = batch.column(0), batch.column(1).cast(pa.binary()), [], 0
            for i in range(len(batch)):
                got.append((ids[i], *rearranged(ids[i].as_py(), texts[i].as_py() or b"", chunks, seed)))
                held += len(got[-1][-1])
                if held > GATHERED or i == len(batch) - 1:
                    yield _as_batch(got, ids.type)
                    got, held = [], 0

    return map_batches(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), batches_of, schema)


def _as_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    ids, n, form, prefix, middle, output = zip(*rows, strict=True)
    columns = [
        pa.array([i.as_py() for i in ids], id_type), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
        pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone. No text that was cut contains a marker, and none
    can arise across the border of a part: a marker begins with `<` and ends with `>` only."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    joined = bound(parts, lambda p: F.when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1])))
    return F.when(form == "plain", output).otherwise(joined)
