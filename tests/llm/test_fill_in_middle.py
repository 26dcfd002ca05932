"""Fill-in-middle against a plain version that tokenizes every text as a whole."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basewright.llm import fill_in_middle as M
from basewright.llm import queries as q

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(i, text):
    """n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    tokens = TOKEN.findall(text)
    h = sha(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def passage(pick, words):
    spaces = [" "] * 8 + ["\n", "  ", "\t\r\n", "\x0b\x0c", "\xa0", "\x1c", "\x85"]
    return "".join(pick.choice(["a", "Wort", "élève", "中文字", "\U0001f600", "<", "<P", "S>", "x" * pick.randrange(1, 90)]) + pick.choice(spaces) for _ in range(words))


def odd_texts():
    pick = random.Random(11)
    shared = passage(pick, 4000)
    texts = [None, "", " ", " \n\t ", "one", " one", "one ", "a<P>b", "x" * 30_000, "é" * 9_001, " " * 20_000, "a " * 30_000, "\U0001f600" * 5000, shared * 60]
    texts += [passage(pick, pick.randrange(1, 60)) + shared[pick.randrange(9000) :] + passage(pick, 5) for _ in range(60)]
    return texts + [passage(pick, pick.randrange(1, 900)) for _ in range(150)]


def test_every_odd_text(spark):
    rows = [(None if i % 40 == 39 else i - 3, t, "clash") for i, t in enumerate(odd_texts())]
    rows += rows[:9]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").withColumn("id", F.lit(1)).repartition(3)
    made = M.filled_in_middle(df).withColumn("again", M.restored(F.col("output"), F.col("form")))
    got = Counter((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in made.collect())
    assert got == Counter((i, *plain(i, t), t or "") for i, t, _ in rows)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


@pytest.mark.parametrize("cached", [0, 5_000, 32 << 20])
def test_counts_and_every_cut(cached):
    """All token ends of texts, with chunks remembered from other texts or forgotten all the time."""
    chunks = M.Chunks(cached)
    for text in odd_texts()[1:40]:
        tokens, data = TOKEN.findall(text), text.encode()
        counted = M.Counted(data, chunks)
        assert counted.tokens == len(tokens)
        ends = [0]
        for t in tokens:
            ends.append(ends[-1] + len(t))
        for k in random.Random(3).sample(range(len(ends)), min(40, len(ends))):
            at, chars = counted.token_end(k)
            assert chars == ends[k] and data[:at].decode() == text[:chars]
        assert counted.token_end(len(tokens))[0] == len(data)


def test_chunks_are_bounded_and_follow_the_content():
    pick = random.Random(5)
    shared = passage(pick, 6000).encode()
    chunks = M.Chunks()

    def pieces(data):
        ends = M.cuts(data)
        assert all(b - a <= M.MOST for a, b in zip([0, *ends], ends)) and (not data or ends[-1] == len(data))
        found = [data[a:b] for a, b in zip([0, *ends], ends)]
        for c in found:
            c.decode()  # never inside a character
            chunks.summary(c)
        return found

    one = set(pieces(shared))
    for _ in range(20):
        other = pieces(passage(pick, pick.randrange(1, 200)).encode() + shared)
        assert len(one & set(other)) > 0.9 * len(one)
    assert len(pieces(b"x" * 100_000)) < 100_000 / M.LEAST + 1


def test_blocks_give_the_same_cuts(monkeypatch):
    data = passage(random.Random(8), 3000).encode()
    whole = list(M.candidates(data))
    for block in (33, 64, 1000):
        monkeypatch.setattr(M, "BLOCK", block)
        assert list(M.candidates(data)) == whole


def test_the_cache_is_bounded_by_bytes():
    chunks = M.Chunks(10_000)
    for i in range(1000):
        chunks.summary(f"{i} ".encode() * 20)
        assert sum(map(len, chunks.known)) <= 10_200


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert q.op13_fill_in_middle(spark, str(tmp_path)).count() == 0
