"""Plain Python versions of the queries, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = [
    ("assign", re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return words((text or "").translate(UPPER))


def base_spans(text):
    found = []
    for rank, (kind, pattern, good) in enumerate(BASE):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if good(m)]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def shingles(text, n=3):
    w = lowered(text)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def jaccard_components(docs, near=90):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= near * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= near * (len(x) + len(y) - both):
                    a2, b2 = sorted((top(a), top(b)))
                    parent[b2] = a2
    return {i: (len(sets[i]), top(i)) for i in ids}


def quality(text):
    w = words(text)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
    }


def crc_of_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def base_scores(docs):
    """doc_id -> (held_out, n_tokens, n_known, base_score), and the training tokens."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter()
    for i, t in docs:
        if not held[i]:
            counts.update([*lowered(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    found = {}
    for i, t in docs:
        tokens = [*lowered(t), "\n"]
        score = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens)
        found[i] = (held[i], len(tokens), sum(counts[x] > 0 for x in tokens), score)
    return found, n
