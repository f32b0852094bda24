"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citewell.llm import simhash
from citewell.llm.common import table
from citewell.llm.queries import QUERIES


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest place reachable, by all pairs."""
    label = list(range(len(fps)))
    for _ in fps:
        before = list(label)
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    label[i] = min(label[i], label[j])
        if label == before:
            return label
    return label


def clustered(seed, n):
    rng = random.Random(seed)
    found = set()
    while len(found) < n:
        x = rng.getrandbits(64)
        found.add(x)
        for _ in range(rng.randrange(6)):  # chains of small steps
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            found.add(x)
    return sorted(found)[:n]


def test_the_hash_is_sparks_own(spark):
    got = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("seed", range(20))
def test_trie_join_connects_what_all_pairs_connect(seed):
    fps = clustered(seed, 120)
    label = list(range(len(fps)))
    for r, start in enumerate(simhash.STARTS[:-1]):
        turned = sorted(((x << start | x >> (64 - start)) % 2**64, i) for i, x in enumerate(fps))
        v = np.array([x for x, _ in turned], np.uint64)
        key = (v >> np.uint64(52)).astype(np.int64)
        got = simhash.trie_join(key, np.zeros(len(v), int), np.full(len(v), r), v, 12)
        for at, low in enumerate(got):
            a, b = (label[turned[x][1]] for x in (at, int(low)))
            label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == plain_components(fps)


def test_empty_children_at_the_end():
    """More pairs than a leaf holds, whose last node has no value with the next bit set."""
    v = np.sort(np.array([(1 << 20) + (i << 3) for i in range(200)] + [(1 << 20) + (i << 3) + 1 for i in range(200)], np.uint64))
    got = simhash.trie_join(np.zeros(len(v), int), np.zeros(len(v), int), np.zeros(len(v), int), v)
    low = {int(x): plain for x, plain in zip(v, plain_components([int(x) for x in v]), strict=True)}
    inside = [x for x in range(len(v)) if got[x] != x]
    assert inside and all(low[int(v[x])] == low[int(v[got[x]])] for x in inside)


@pytest.mark.parametrize("task_rows", [3, 10_000])
def test_links_by_any_size_of_task(spark, task_rows):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    near = {centre} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    fps = sorted({*near, *clustered(3, 80)})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), task_rows).collect()
    at = {x: i for i, x in enumerate(signed)}
    label = list(range(len(fps)))
    for row in got:
        a, b = label[at[row.a]], label[at[row.b]]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == plain_components(fps)


def test_query_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    groups = plain_components(fps)
    first = {}
    for g, r in zip(groups, docs, strict=True):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    want = {(r.doc_id, f"{f:016x}", first[g]) for r, f, g in zip(docs, fps, groups, strict=True)}
    got = QUERIES["op11_simhash_trie_join"](spark, sf).collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == want
    assert len(first) < len(docs)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "x"), (5, "one\ttwo ", "x"), (None, "one two", "x"), (None, "alone here", None), (6, "ÄB é", "x"), (6, "other text of the same id", "x"), (7, "a b c d " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").withColumn("fp", F.lit(1)).withColumn("key", F.lit("k"))
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(i, "0" * 16, 1) for i in (1, 2, 3)]
        + [(4, f"{plain_fingerprint('one two'):016x}", 4), (5, f"{plain_fingerprint('one two'):016x}", 4), (None, f"{plain_fingerprint('one two'):016x}", 4)]
        + [(None, f"{plain_fingerprint('alone here'):016x}", None), (6, f"{plain_fingerprint('ÄB é'):016x}", 6), (6, f"{plain_fingerprint('other text of the same id'):016x}", 6), (7, f"{plain_fingerprint('a b c d ' * 40_000):016x}", 7)],
        key=str,
    )
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
