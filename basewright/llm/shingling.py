"""Hashes of words and of runs of words, as 64-bit numbers."""

from __future__ import annotations

from itertools import islice

from .frames import at_end_of_task

#: Words whose hash a task remembers; beyond it the older half goes. The first ones, the most common, outlive the task.
CACHED_WORDS, LASTING_WORDS = 300_000, 50_000
#: Odd multipliers of the mixing function.
MIX_1, MIX_2, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15

_known: dict[bytes, int] = {}


@at_end_of_task
def _forget() -> None:
    if len(_known) > LASTING_WORDS:
        kept = dict(islice(_known.items(), LASTING_WORDS))
        _known.clear()
        _known.update(kept)


def mixed(x):
    """A one-to-one mix of each 64-bit number."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def split(texts):
    """Words (A-Z lower-cased, parted by ASCII white space) of an Arrow array of texts, null ones empty: the distinct
    words, the place of each word among them, and the number of each text's."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found, offsets = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    # White space at either end of a text leaves an empty string.
    full = pc.greater(pc.binary_length(found), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    words = found.filter(full).dictionary_encode()
    return words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), words.indices.to_numpy(), np.diff(before[offsets])


def hashed(words):
    """Hashes of words."""
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def word_hashes_of(texts):
    """`word_hashes` of each text of an Arrow array."""
    import numpy as np

    words, at, lengths = split(texts)
    return np.split(hashed(words)[at], np.cumsum(lengths)[:-1]) if len(lengths) else []


def word_hashes(text: str | None, lead: int = 0):
    """Hashes of a text's words (A-Z lower-cased, parted by ASCII white space), after `lead` empty ones."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    found = np.zeros(len(words) + lead, np.uint64)
    found[lead:] = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    if len(_known) > CACHED_WORDS:
        for w in list(islice(_known, CACHED_WORDS // 2)):
            del _known[w]
    return found


def runs(hashes, size: int):
    """The hash of every run of `size` words."""
    import numpy as np

    n = max(len(hashes) - size + 1, 0)
    joined = np.full(n, size, np.uint64)
    for i in range(size):
        joined = mixed(joined * np.uint64(GOLDEN) + hashes[i : i + n])
    return joined
