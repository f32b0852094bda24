"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import pytest

from citewell.llm import runs
from citewell.llm.common import table, word_hashes
from citewell.llm.queries import QUERIES


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        at = q
        while at < n:
            end = at
            while end < n and words[end] == words[end - q]:
                end += 1
            start, length = at - q, end - at + q
            if length >= max(6, 4 * q) and not any(words[start : start + length - d] == words[start + d : start + length] for d in range(1, q)):
                out.append((start, length, q))
            at = end + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    one = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *one, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_made_words(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n, kinds = rng.randrange(70), rng.choice([1, 2, 2, 3, 6])
        words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if words:
                a, p = rng.randrange(len(words)), rng.randrange(1, 9)
                words = words[:a] + [words[a + i % min(p, len(words) - a)] for i in range(rng.randrange(40))] + words[a:]
        want = plain_runs(words)
        assert runs.find_runs(words) == want
        parts = runs.windows(word_hashes(words))
        assert all(sum(a < s + length and s < b for a, b in parts) == 1 for s, length, _ in want)


def test_squares_are_the_last_former_ends():
    rng = random.Random(5)
    text = [rng.randrange(3) for _ in range(60)]
    got = {}
    for i, e, size in runs.squares(text):
        got.setdefault(i, {})[e] = size
    for i in range(1, len(text) + 1):
        want = {}
        for size in range(1, i + 1):
            ends = [e for e in range(size, i) if text[e - size : e] == text[i - size : i]]
            if ends:
                want[max(ends)] = size
        assert got.get(i, {}) == want


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    short = {r.doc_id for r in docs if len((r.text or "").split()) <= 900}  # plain loops take the square of a text
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs) and len(short) > len(docs) / 2
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in docs if r.doc_id in short}
    assert {k: got[k] for k in short} == want
    assert sum(x[1] > 0 for x in want.values()) > 3


def test_long_texts():
    rng = random.Random(2)
    words = [b"%d" % rng.randrange(50) for _ in range(30_000)]
    inside = words[:20_000] + words[10_000:20_000] * 3 + [b"x"] * 50_000 + words[20_000:]
    assert runs.find_runs(inside) == [(10_000, 40_000, 10_000), (50_000, 50_000, 1)]
    assert runs.collapse(inside, runs.find_runs(inside)) == words[:20_000] + [b"x"] + words[20_000:]


def test_odd_rows(spark):
    rows = [(1, None), (1, ""), (2, " \t"), (3, "a a a a a"), (3, "a a a a a a"), (None, "b c " * 4), (4, "Aa aa " * 9 + "é\x1c")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, runs string, start int")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs).collect()]
    assert got == [
        (1, [], ""), (1, [], ""), (2, [], ""), (3, [], "a a a a a"), (3, [(0, 6, 1)], "a"), (None, [(0, 8, 2)], "b c"), (4, [(0, 18, 2)], "Aa aa é\x1c"),
    ]
    digests = runs.digest_runs(runs.periodic_runs(docs, runs.planted)).collect()
    assert len(digests) == len(rows) and all(None not in (r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in digests)
    assert runs.digest_runs(runs.periodic_runs(docs.limit(0))).count() == 0
