"""Ids of whole texts as the tokenizers library gives them, in less time.

Three ways, all with the library's ids:

- A byte-level vocabulary whose merges stand in order of id, the public layout of such
  vocabularies, is handed to tiktoken, which merges by that order. Texts with a special
  token's string, or with a run of a length that its pattern has no stack for, go to the library.
- A vocabulary that drops white space: texts are split at spaces and each distinct piece of
  some texts is encoded once, many pieces in one call with a control character between them;
  the texts' ids are then gathered from those of their pieces.
  If its words end in a mark and its merges stand in order, plain pieces go to tiktoken as
  well, with a control character for the mark (`_word_ranks`).
- Any other: the library, text by text.

`Pieces` holds the values of pieces. A tokenizer's splitting never looks across a single
space between two other characters, so a text is the concatenation of its pieces. With
`spaces`, a text with other white space, runs of it, or a special token's string is
encoded in one go instead.
"""

from __future__ import annotations

import json
import os
import re
import sys
import weakref
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import islice
from typing import Any

from .frames import at_end_of_task

#: Values kept by a task; beyond it the older half goes. The first ones, the most common, outlive the
#: task. Bounds memory, not results.
CACHED_PIECES, LASTING_PIECES = 700_000, 400_000
#: Texts looked at together.
TEXTS_AT_ONCE = 256
#: Bytes of texts whose pieces are looked at together (a longer text goes alone).
BYTES_AT_ONCE = 16 << 20
#: Pieces encoded in one call.
PIECES_AT_ONCE, PLAIN_AT_ONCE = 200, 20_000
#: How byte-level vocabularies split a text, and the bytes that they write as themselves.
BYTE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
#: Between pieces in one call; a word of its own, with an id of its own.
BETWEEN = "\x01"
#: Stands for the end of a word in bytes given to tiktoken.
WORD_END = "\x02"
#: Pieces that every normaliser in use leaves alone but for lower case, a character each: printable Latin, without the dotted capital I.
PLAIN_PIECE = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]{0,1000}")
#: Texts longer than this are looked through for longer runs of one kind.
LONG_RUN = 50_000

_SPACE = re.compile(r"\s")
RUN = re.compile(r"\s+|\S+")
ODD = object()


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary lies on this machine; a path is returned as it is."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Split texts, and remember a value for each piece.

    `of_pieces` gives a value for each of a list of pieces. With `spaces`, a piece
    carries the space or line end before it, as byte-level tokenizers need; without, the
    tokenizer drops white space. `special` strings make a text odd.
    """

    def __init__(self, of_pieces: Callable[[list[str]], list[Any]], spaces: bool, special: Iterable[str] = ()):
        self.of_pieces, self.spaces, self.special = of_pieces, spaces, tuple(special)
        self.known: dict[str, Any] = {}
        # A worker may go on with another model: what it remembers of this one isn't kept alive.
        this = weakref.ref(self)
        at_end_of_task(lambda: this() and this().forget())

    def forget(self) -> None:
        if len(self.known) > LASTING_PIECES:
            self.known = dict(islice(self.known.items(), LASTING_PIECES))

    def _parted(self, text: str) -> str:
        """The text with a space between its pieces."""
        return ("\n" + text).replace("\n", " \n")[1:] if self.spaces else text.replace("\n", " ")

    def split(self, text: str) -> list[str]:
        return self._parted(text).split(" ")

    def _make_room(self) -> None:
        if len(self.known) > CACHED_PIECES:
            for piece in list(islice(self.known, len(self.known) // 2)):
                del self.known[piece]

    def gathered(self, texts: list[str]):
        """The values of the distinct pieces of all texts (`ODD` ones included), the place of each piece among them, and
        the number of pieces of each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        self._make_room()
        lists = pc.split_pattern(pa.array(map(self._parted, texts), pa.string()), " ")
        pieces = lists.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.known.get, distinct))
        if None in values:
            self._learn(p for p, v in zip(distinct, values, strict=True) if v is None)
            values = list(map(self.known.get, distinct))
        return values, pieces.indices.to_numpy(), pc.list_value_length(lists).to_numpy()

    def _is_odd(self, piece: str) -> bool:
        body = piece[1:] if piece[:1] == "\n" else piece
        return not body or _SPACE.search(body) is not None or any(s in body for s in self.special)

    def _learn(self, missing: Iterable[str]) -> None:
        plain = list(dict.fromkeys(missing))
        if self.spaces:
            self.known.update((p, ODD) for p in plain if self._is_odd(p))
            plain = [p for p in plain if p not in self.known]
        texts = [p if not self.spaces or p[0] == "\n" else " " + p for p in plain]
        self.known.update(zip(plain, self.of_pieces(texts), strict=True))

    def values(self, texts: list[str]) -> list[list[Any] | None]:
        """For each text the values of its pieces, or None where it has to go in one go.

        With `spaces`, the first value has a line end before it that the text has not.
        """
        self._make_room()
        get = self.known.get
        split = [self.split(t) for t in texts]
        found = [list(map(get, pieces)) for pieces in split]
        late = [i for i, values in enumerate(found) if None in values]
        if late:
            self._learn(p for i in late for p, v in zip(split[i], found[i], strict=True) if v is None)
            for i in late:
                found[i] = list(map(get, split[i]))
        return [None if ODD in values else values for values in found]


def _byte_ranks(layout: dict, special: Iterable[str]) -> dict[bytes, int] | None:
    """The tokens of a byte-level vocabulary as bytes, if merges make them in the order of their ids; else None."""
    model = layout["model"]
    odd = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return None
    plain = {b for low, high in PLAIN_BYTES for b in range(low, high + 1)}
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    left, special = {t: i for t, i in model["vocab"].items() if t not in special}, set(special)
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    made = [left.get(t, -1) for t in merged]
    if len(left) != 256 + len(merged) or any(c not in left for c in byte_of) or made != sorted(set(made)):
        return None
    if made and min(made) <= max(left[c] for c in byte_of):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in left.items()}


def _word_ranks(layout: dict, special: Iterable[str]) -> tuple[dict[bytes, int], list[int]] | None:
    """Byte strings by order of merging, words closed by `WORD_END`, and the id of each; None for another layout.

    The first merges join the last byte of a word and its end, which is how such vocabularies
    begin; all others follow in their order. Merging by the joined string instead of by pair
    gives the same as long as merging a token's own bytes gives that token (tested for the
    public vocabulary): until its turn, its bytes merge as they do alone.
    """
    model, before = layout["model"], layout.get("pre_tokenizer") or {}
    odd = ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges", "fuse_unk")
    mark, steps = model.get("end_of_word_suffix"), [s.get("type") for s in before.get("pretokenizers", [])]
    if model.get("type") != "BPE" or not mark or any(model.get(k) for k in odd) or steps != ["Split", "ByteLevel"]:
        return None
    plain = {b for low, high in PLAIN_BYTES for b in range(low, high + 1)}
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    end, special = WORD_END.encode(), set(special)

    def raw(token: str) -> bytes:
        body = token.removesuffix(mark)
        return bytes(byte_of[c] for c in body) + (end if body != token else b"")

    if any(c not in byte_of for t in model["vocab"] if t not in special for c in t.removesuffix(mark)):
        return None
    ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    merged = [raw("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single = [bytes([b]) for b in range(256)]
    order = [*single, *(b + end for b in single), *merged]
    if len(set(order)) != len(order) or set(order) != set(ids):
        return None
    return {b: i for i, b in enumerate(order)}, [ids[b] for b in order]


class IdEncoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(vocabulary_path(path), encoding="utf-8") as f:
            layout = json.load(f)
        self.special = [t["content"] for t in layout["added_tokens"]]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Two bytes an id where the vocabulary allows it.
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        kind = self._kind(layout)
        ranks = _byte_ranks(layout, self.special) if kind == "bytes" else None
        self.pieces = self.whole = self.between = None
        self.dropped = kind == "dropped"
        if ranks:
            import tiktoken

            self.whole = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        elif kind == "bytes":
            self.pieces = Pieces(self._encode_pieces, True, self.special)
        alone = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        if kind == "dropped" and len(alone) == 1:
            self.between = alone[0]
        of_words = _word_ranks(layout, self.special) if self.between is not None else None
        self.words = None
        if of_words:
            import regex
            import tiktoken

            self.words = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=of_words[0], special_tokens={})
            self.id_of = np.array(of_words[1], self.dtype)
            self.find_words = regex.compile(layout["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall

    @staticmethod
    def _kind(layout: dict) -> str | None:
        """How white space is treated; None for a tokenizer that isn't known to split at spaces."""
        before, normal = layout.get("pre_tokenizer") or {}, layout.get("normalizer")
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
            return "bytes"
        first = (before.get("pretokenizers") or [{}])[0]
        dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        steps = {s["type"] for s in (normal or {}).get("normalizers", [])}
        return "dropped" if dropped and steps <= {"NFC", "Replace", "Lowercase"} else None

    def _bytes(self, ids: list[int]) -> bytes:
        found = array(self.code, ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        if self.between is None:
            return self._encode(pieces)
        if self.words is None:
            return self._encode_joined(pieces)
        odd = [i for i, match in enumerate(map(PLAIN_PIECE.fullmatch, pieces)) if match is None]
        if any(s in "\n".join(pieces) for s in self.special):
            odd = sorted({*odd, *(i for i, p in enumerate(pieces) if any(s in p for s in self.special))})
        plain = pieces[:]
        for i in odd:
            plain[i] = ""
        found = list(self._encode_plain(plain))
        for i, ids in zip(odd, self._encode_joined([pieces[i] for i in odd]), strict=True):
            found[i] = ids
        return found

    def _encode_plain(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of plain pieces, by merging whole words."""
        import numpy as np

        size, last = self.dtype.itemsize, self.words.encode_single_token((BETWEEN + WORD_END).encode())
        for at in range(0, len(pieces), PLAIN_AT_ONCE):
            found = self.find_words(f" {BETWEEN} ".join([*pieces[at : at + PLAIN_AT_ONCE], ""]).lower())
            ranks = np.array(self.words.encode_ordinary(WORD_END.join([*found, ""])), np.int64)
            raw, start = self.id_of[ranks].tobytes(), 0
            for end in (np.flatnonzero(ranks == last) * size).tolist():
                yield raw[start:end]
                start = end + size

    def _encode_joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece by the library, many pieces in one call."""
        import numpy as np

        groups = [pieces[at : at + PIECES_AT_ONCE] for at in range(0, len(pieces), PIECES_AT_ONCE)]
        found: list[bytes] = []
        for group, raw in zip(groups, self._encode([f" {BETWEEN} ".join(g) for g in groups]), strict=True):
            ids = np.frombuffer(raw, self.dtype)
            cuts = (np.flatnonzero(ids == self.between) * self.dtype.itemsize).tolist()
            if len(cuts) != len(group) - 1:  # a piece has the character itself
                found += self._encode(group)
                continue
            starts = [0, *(c + self.dtype.itemsize for c in cuts)]
            found += [raw[a:b] for a, b in zip(starts, [*cuts, len(raw)], strict=True)]
        return found

    def _gathered(self, texts: Any) -> Iterator[bytes]:
        """The ids of each text (an Arrow array) of a vocabulary that drops white space."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids = self._encode_pieces(coded.dictionary.to_pylist())
        size, code = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize, coded.indices.to_numpy()
        start, n = np.cumsum(size) - size, size[code]
        ends = np.cumsum(n)
        place = np.repeat(start[code] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        found, places = np.frombuffer(b"".join(ids), self.dtype)[place], np.concatenate(([0], ends))
        pieces = pc.list_value_length(split).to_numpy()
        cuts = places[np.concatenate(([0], np.cumsum(pieces)))].tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield found[a:b].tobytes()

    def encode_column(self, texts: Any) -> Iterator[bytes]:
        """`encode` of an Arrow array of strings."""
        import numpy as np
        import pyarrow.compute as pc

        if not self.dropped:
            yield from self.encode(texts.to_pylist())
            return
        go = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(go)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from self._gathered(texts.slice(a, b - a))

    def _for_library(self, text: str) -> bool:
        if len(text) > LONG_RUN and any(m.end() - m.start() > LONG_RUN for m in RUN.finditer(text)):
            return True
        return any(s in text for s in self.special)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; a null text has none."""
        if self.dropped:
            import pyarrow as pa

            yield from self.encode_column(pa.array(list(texts), pa.string()))
            return
        texts = [t or "" for t in texts]
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            some = texts[at : at + TEXTS_AT_ONCE]
            if self.whole:
                for text in some:
                    yield self._encode([text])[0] if self._for_library(text) else self._bytes(self.whole(text))
                continue
            if self.pieces is None:
                yield from self._encode(some)
                continue
            skip = self.dtype.itemsize if self.pieces.spaces else 0
            for text, values in zip(some, self.pieces.values(some), strict=True):
                yield self._encode([text])[0] if values is None else b"".join(values)[skip:]


@cache
def id_encoder(path: str) -> IdEncoder:
    """One encoder for a worker's life."""
    return IdEncoder(path)
