"""Many substrings as one pattern.

A test for each of ten thousand needles would make a plan of ten thousand expressions. Here the needles are merged
into a tree by their common beginnings, which is written out as one regular expression; a text is read once, and
at each place only the branch that fits is followed. A needle that begins with another one is implied
by it and left out.
"""

from __future__ import annotations

from collections.abc import Iterable


def _escaped(char: str) -> str:
    return char if char.isalnum() and char.isascii() else f"\\x{{{ord(char):x}}}"


def _tree(needles: Iterable[str]) -> dict:
    """Nested dicts by character; a needle's end is an empty dict, and nothing goes on from there."""
    root: dict = {}
    for needle in sorted(set(needles)):  # a beginning comes before what it begins
        node, is_new = root, not root
        for char in needle:
            if not node and not is_new:
                break
            is_new = char not in node
            node = node.setdefault(char, {})
    return root


def _written(node: dict) -> str:
    """The tree as a pattern. Without recursion: needles can be longer than Python's stack is deep."""
    done: dict[int, str] = {}
    stack = [(node, False)]
    while stack:
        at, children_done = stack.pop()
        if not children_done:
            stack.append((at, True))
            stack.extend((below, False) for below in at.values())
            continue
        single = [char for char, below in at.items() if not below]
        parts = [_escaped(char) + done.pop(id(below)) for char, below in at.items() if below]
        for char in single:
            done.pop(id(at[char]))
        if len(single) > 1:
            parts.append(f"[{''.join(map(_escaped, single))}]")
        else:
            parts.extend(map(_escaped, single))
        done[id(at)] = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
    return done[id(node)]


def alternation(needles: Iterable[str]) -> str | None:
    """A pattern that is found in a text exactly if one of the needles is; None if there are no needles.

    An empty needle is in every text.
    """
    wanted = set(needles)
    if not wanted:
        return None
    return "" if "" in wanted else _written(_tree(wanted))
