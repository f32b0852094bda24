"""SimHash near-duplicates: fingerprints linked within a Hamming distance, by a self-join of binary tries.

1. A document becomes a 64-bit fingerprint of its word shingles; equal fingerprints are one from there on.
2. The fingerprints are put into five tries, each with another block of bits on top. If two fingerprints differ in at most
   BITS places, there is a trie where every prefix that ends with a block has at most its share of the differing bits.
   So the top block must be equal, and pairs of nodes start as one node met with itself.
3. Pairs of nodes are walked down together. A bit where both differ is added to the pair's errors, and a pair whose
   errors exceed the share allowed at its depth is dropped. Tasks hold whole pairs of nodes; a pair with too many
   fingerprints for a task is walked down by Spark, four bits at a time, before it is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialize
from .components import EDGE, connected_components

SEED = 42
#: Differing bits that still link.
BITS = 4
#: Sizes of the blocks of bits; one more than BITS.
BLOCKS = (13, 13, 13, 13, 12)
STARTS = tuple(int(x) for x in np.cumsum((0, *BLOCKS)))
#: Fingerprints of one pair of nodes that a task takes; more are walked down first.
TASK_ROWS = 4096
#: Bits of such a step.
STEP = 4
#: Fingerprints and pairs of nodes that a task handles at a time.
BUFFER, FRONTIER = 100_000, 200_000
#: Pairs of nodes with so few pairs of fingerprints are compared directly.
LEAF = 32


def allowed(depth: int, rotation: int) -> int:
    """Differing bits that a prefix of this length may have in the trie of this rotation: the share of the blocks it touches."""
    sizes = np.cumsum([BLOCKS[(rotation + i) % len(BLOCKS)] for i in range(len(BLOCKS))])
    return int(np.searchsorted(sizes, depth) + 1) * BITS // len(BLOCKS) if depth else 0


ALLOWED = np.array([[allowed(d, r) for d in range(65)] for r in range(len(BLOCKS))], dtype=np.int8)


def fingerprint(text: bytes | None, k: int = 4) -> int:
    """Unsigned fingerprint of a UTF-8 text: a bit is 1 if more than half of the hashes of its k-word shingles have it."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and blanks of ASCII only
    if not words:
        return 0
    n = max(len(words) - k + 1, 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        some = range(at, min(at + 65_536, n))
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in some), ">u8", len(some))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """``doc_id, fp``: one row per row; the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                found = np.fromiter((fingerprint(x.as_py(), k) for x in part.column(1)), np.uint64, len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest label reachable, after links between the places i and j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not (label[label] == label).all():
            label = label[label]


def trie_join(key: np.ndarray, side: np.ndarray, rotation: np.ndarray, v: np.ndarray, least: int = 0) -> np.ndarray:
    """For every place the smallest place that links reach, within each key.

    The rows come sorted by key, side and value. A key is a pair of nodes: with side 0 one node met with itself, else
    the nodes of sides 1 and 2. ``v`` are the fingerprints, turned so that the trie's first bit is the highest one. All
    values of a node share their first ``least`` bits.
    """
    n = len(v)
    label = np.arange(n)
    cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])])
    lo, hi, s, k = cut, np.r_[cut[1:], n], side[cut], key[cut]
    own = np.flatnonzero(s == 0)
    left = np.flatnonzero((s[:-1] == 1) & (s[1:] == 2) & (k[:-1] == k[1:]))
    start = np.stack([np.r_[lo[own], lo[left]], np.r_[hi[own], hi[left]], np.r_[lo[own], lo[left + 1]], np.r_[hi[own], hi[left + 1]]])
    errors = np.bitwise_count((v[start[0]] ^ v[start[2]]) >> np.uint64(64 - least)) if least else np.zeros(start.shape[1], np.uint8)
    stack = [(least, start, errors.astype(np.int8))]
    while stack:
        depth, p, err = stack.pop()
        if p.shape[1] > FRONTIER:
            half = p.shape[1] // 2
            stack += [(depth, p[:, half:], err[half:]), (depth, p[:, :half], err[:half])]
            continue
        # pairs of nodes whose fingerprints are all connected already tell nothing new
        changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        known = (changes[p[0]] == changes[p[1] - 1]) & (changes[p[2]] == changes[p[3] - 1]) & (label[p[0]] == label[p[2]])
        p, err = p[:, ~known], err[~known]
        width, height = p[1] - p[0], p[3] - p[2]
        few = width * height <= LEAF if depth < 64 else np.ones(p.shape[1], bool)
        q = p[:, few]
        for at in range(0, q.shape[1], FRONTIER):
            a0, a1, b0, b1 = q[:, at : at + FRONTIER]
            each = (a1 - a0) * (b1 - b0)
            pair = np.repeat(np.arange(len(each)), each)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            i, j = a0[pair] + step // (b1 - b0)[pair], b0[pair] + step % (b1 - b0)[pair]
            near = np.bitwise_count(v[i] ^ v[j]) <= BITS
            label = _connect(label, i[near], j[near])
        p, err = p[:, ~few], err[~few]
        if not p.shape[1]:
            continue
        ones = np.r_[0, np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)]
        a, b = p[1] - (ones[p[1]] - ones[p[0]]), p[3] - (ones[p[3]] - ones[p[2]])  # where the bit becomes 1
        selves = p[0] == p[2]
        same = [np.stack([p[0], a, p[2], b]), np.stack([a, p[1], b, p[3]])]
        cross = [np.stack([p[0], a, b, p[3]]), np.stack([a, p[1], p[2], b])[:, ~selves]]
        children = np.concatenate([*same, *cross], axis=1)
        left_err = np.concatenate([err, err, err + 1, err[~selves] + 1])
        full = (children[0] < children[1]) & (children[2] < children[3])
        children, left_err = children[:, full], left_err[full]
        fits = left_err <= ALLOWED[rotation[children[0]], depth + 1]
        stack.append((depth + 1, children[:, fits], left_err[fits]))
    return label


def _turned(column, by: int):
    return column if by == 0 else F.shiftleft(column, by).bitwiseOR(F.shiftrightunsigned(column, 64 - by))


def _walk_down(rows: DataFrame, depth: int) -> DataFrame:
    """The pairs of children of each pair of nodes in ``rows(key, side, err, rotation, v)``, STEP bits further down."""
    bits = F.shiftrightunsigned("v", 64 - depth - STEP).bitwiseAND(F.lit((1 << STEP) - 1)).cast("int")
    share = F.element_at(F.array(*(F.lit(int(ALLOWED[r, depth + STEP])) for r in range(len(BLOCKS)))), F.col("rotation") + 1)
    masks = F.array(*(F.lit(m) for m in range(1 << STEP)))
    met = F.explode(F.filter(masks, lambda m: F.bit_count(m) + F.col("err") <= F.col("share")))
    rows = rows.withColumns({"bits": bits, "share": share}).withColumn("mask", met)
    other = F.col("bits").bitwiseXOR(F.col("mask"))
    first = F.when(F.col("side") == 0, F.least("bits", other)).when(F.col("side") == 1, F.col("bits")).otherwise(other)
    second = F.when(F.col("side") == 0, F.greatest("bits", other)).when(F.col("side") == 1, other).otherwise(F.col("bits"))
    side = F.when(F.col("side") != 0, F.col("side")).when(F.col("mask") == 0, 0).when(F.col("bits") < other, 1).otherwise(2)
    return rows.select(F.xxhash64("key", first, second).alias("key"), side.alias("side"), (F.col("err") + F.bit_count("mask")).cast("int").alias("err"), "rotation", "v")


def links(found: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``a, b``: links that connect all fingerprints ``fp`` (distinct longs) that differ in at most BITS bits."""
    turned = F.explode(F.array(*(F.struct(F.lit(r).alias("rotation"), _turned(F.col("fp"), STARTS[r]).alias("v")) for r in range(len(BLOCKS)))))
    rows = found.select(turned.alias("t")).select("t.rotation", "t.v")
    depth = min(BLOCKS)
    top = F.shiftrightunsigned("v", 64 - depth)
    rows = materialize(rows.select((F.col("rotation") * (1 << depth) + top).alias("key"), F.lit(0).alias("side"), F.lit(0).alias("err"), "rotation", "v"))
    parts, shares = [], []
    while True:
        per_key = rows.groupBy("key").agg(F.count("*").alias("n"))
        large = materialize(per_key.filter(F.col("n") > task_rows).select("key"))
        if depth + STEP > 64 or large.isEmpty():
            parts.append(rows)
            shares.append(depth)
            break
        parts.append(rows.join(large, "key", "left_anti"))
        shares.append(depth)
        rows = materialize(_walk_down(rows.join(large, "key", "left_semi"), depth))
        depth += STEP

    def join(least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            size = 0

            def work(table: pa.Table) -> pa.RecordBatch:
                key, side, rotation, v = (table.column(c).to_numpy() for c in ("key", "side", "rotation", "v"))
                v = v.view(np.uint64)
                # a node's fingerprints share their first bits, but for keys that collide: those walk from the top
                label = trie_join(key, side, rotation, v, least if _share_bits(key, side, v, least) else 0)
                at = np.flatnonzero(label != np.arange(len(v)))
                turn = np.array(STARTS[:-1], dtype=np.uint64)[rotation]
                back = np.where(turn == 0, v, (v >> turn) | (v << ((np.uint64(64) - turn) & np.uint64(63))))
                fp = back.view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[label[at]])], names=["a", "b"])

            for batch in batches:
                held.append(batch)
                size += len(batch)
                if size >= BUFFER:
                    table = pa.Table.from_batches(held)
                    key = table.column("key").to_numpy()
                    cut = int(np.searchsorted(key, key[-1]))
                    if cut:
                        yield work(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), len(key) - cut
            if size:
                yield work(pa.Table.from_batches(held))

        return run

    out = None
    for part, least in zip(parts, shares, strict=True):
        dealt = part.repartition("key").sortWithinPartitions("key", "side", F.shiftrightunsigned("v", 1), F.col("v").bitwiseAND(F.lit(1)))
        one = dealt.select("key", "side", "rotation", "v").mapInArrow(join(least), EDGE)
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def _share_bits(key: np.ndarray, side: np.ndarray, v: np.ndarray, least: int) -> bool:
    """Whether all rows of a key and side share their first bits."""
    same = (key[1:] == key[:-1]) & (side[1:] == side[:-1])
    return not ((v[1:] ^ v[:-1]) >> np.uint64(64 - least))[same].any()


def near_duplicates(docs: DataFrame, k: int = 4, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Fingerprints (16 hex digits) are linked if they differ in at most BITS bits; ``component_id`` is the smallest doc_id
    that links reach. A null, empty or wordless text has fingerprint zero and is linked like any other; a text of fewer
    than k words is one shingle. Rows, not ids, are linked: repeated rows are copies, and a row with a null doc_id is
    linked by its text and takes the smallest id of its component, if there is any. Other columns are ignored; an empty
    table gives no rows.
    """
    rows = materialize(fingerprints(docs, k))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    comps = materialize(connected_components(links(distinct.select("fp"), task_rows)))
    linked = distinct.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left")
    linked = materialize(linked.filter("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "fp")))
    first = materialize(linked.groupBy("component").agg(F.min("first").alias("component_id")))
    found = materialize(linked.join(first, "component").select("fp", "component_id"))
    joined = rows.join(found, "fp", "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
