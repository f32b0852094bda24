"""Grouped prefix join: all documents linked by the Jaccard similarity of their word shingles, as components.

1. A document becomes the sorted hashes of its distinct shingles; equal sets become one. One order ranks all shingles:
   first those with a hash below a cut, by how many sets have them, then the rest by hash. Two linked sets share one of
   the first ``n - ceil(t n) + 1`` shingles of this order (their prefix).
2. Sets with identical prefix and size collapse into one group. Groups that share a prefix shingle form pairs, filtered
   by size and by the shingle's position; where more than LIST groups share one, they are connected through pivots.
3. The members of each connected candidate set are packed into blocks, a row each. Each pair of blocks that can hold
   links is verified by exact counts of common shingles; a block goes to a fixed number of tasks at most, which read the
   pairs one by one, and only counts and a spanning set of links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, release_memory, rolling, word_hashes
from .components import EDGE, connected_components

#: Documents in a block, and shingles that make a block of one candidate set.
BLOCK_DOCS, BLOCK_TOKENS = 512, 250_000
#: Classes of blocks in a size band; a pair of classes is a task's share of a candidate set.
GRID = 8
PLACE = ["comp", "band", "h", "cuts", "above", "below"]
#: Documents whose links a task adds up before it passes them on.
TASK_DOCS = 200_000
#: Groups that share a prefix shingle and meet in pairs; more are connected through pivots.
LIST = 64
UNRANKED = 1 << 60
#: Of each document's shingles so many times the prefix's share are ranked; what a prefix lacks comes in hash order.
RANKED = 1.4
SKETCH = "doc_id long, n long, s1 long, s2 long, ranked long, low array<long>"


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, no word is none."""
    words = text.encode().lower().split()  # bytes: A-Z only, and blanks of ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(rolling(hashes, min(k, len(hashes))))


def signature(tokens: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (x >> 65), x & ((1 << 63) - 1)


def prefix_size(n: Column | int, percent: int):
    """n - ceil(percent n / 100) + 1"""
    if isinstance(n, int):
        return n - (percent * n + 99) // 100 + 1
    return (n - F.floor((n * percent + 99) / 100) + 1).cast("long")


def sketch(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: set size, signature and the lowest hashes: all below the cut (``ranked``), and more up to the prefix size."""
    cut = np.uint64(min(2**63 - 1, int(2**63 * RANKED * (1 - percent / 100))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                n, s1, s2, ranked, low, sizes = [], [], [], [], [], [0]
                for text in part.column(1).to_pylist():
                    tokens = np.unique(shingles(text or "", k) >> np.uint64(1)) if text else np.zeros(0, np.uint64)
                    a, b = signature(tokens)
                    below = int(np.searchsorted(tokens, cut))
                    own = tokens[: max(below, prefix_size(len(tokens), percent))] if len(tokens) else tokens
                    n.append(len(tokens)), s1.append(a), s2.append(b), ranked.append(below), low.append(own), sizes.append(len(own))
                flat = np.concatenate(low).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n, s1, s2, ranked)), lists], names=["doc_id", "n", "s1", "s2", "ranked", "low"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)
    return found.withColumn("row", F.monotonically_increasing_id())


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """``row, doc_id, n, prefix, alone`` of sets that share something in their prefix; the rest can't have partners.

    ``prefix`` holds the shingles that more than one set has, in the common order; before them come the ``alone`` ones.
    """
    tokens = rows.select("row", F.explode(F.slice("low", F.lit(1), F.col("ranked").cast("int"))).alias("token"))
    shared = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    beyond = rows.filter(F.col("ranked") < prefix_size(F.col("n"), percent))
    beyond = beyond.select("row", F.explode(F.slice("low", (F.col("ranked") + 1).cast("int"), F.size("low"))).alias("token"), F.lit(UNRANKED).alias("df"))
    own = tokens.join(shared, "token").select("row", "token", "df").unionByName(beyond)
    own = own.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    own = rows.select("row", "doc_id", "n", "ranked").join(own, "row")
    alone = F.col("ranked") - F.size(F.filter("own", lambda x: x["df"] < UNRANKED))
    own = own.withColumn("alone", alone).withColumn("take", (prefix_size(F.col("n"), percent) - F.col("alone")).cast("int")).filter("take > 0")
    return own.select("row", "doc_id", "n", F.transform(F.slice("own", F.lit(1), F.col("take")), lambda x: x["token"]).alias("prefix"), "alone")


def group_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of groups from ``posts(token, n, at, gid)``, whose lists are short: those that can be similar enough.

    Sizes must be compatible, and what is left of both sets after the shared shingle (at position ``at``) must suffice.
    Two similar sets pass at the first shingle that they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at, gid = (batch.column("list").flatten().field(k).to_numpy(zero_copy_only=False) for k in ("n", "at", "gid"))
            sizes = np.diff(batch.column("list").offsets.to_numpy())
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            left, right = [], []
            for step in range(1, int(sizes.max(initial=0))):  # each list against itself, moved on by one more
                i = np.flatnonzero(np.arange(len(n)) - starts >= step)
                j = i - step
                common = 1 + np.minimum(n[i] - at[i], n[j] - at[j])
                fits = 100 * common >= percent * (n[i] + n[j] - common)
                left.append(np.maximum(gid[i], gid[j])[fits]), right.append(np.minimum(gid[i], gid[j])[fits])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], names=["a", "b"])

    lists = posts.groupBy("token").agg(F.collect_list(F.struct("n", "at", "gid")).alias("list")).filter(F.size("list") > 1)
    return lists.select("list").mapInArrow(run, EDGE).filter("a <> b").distinct()


def candidate_edges(found: DataFrame, percent: int) -> DataFrame:
    """Edges that connect all documents that may be linked.

    Groups that share a prefix shingle with at most LIST groups meet in pairs, which the filters thin out. A list that
    is longer has too many pairs to write; its groups are connected through one pivot per size band, and what they
    really have in common is found block by block.
    """
    own = F.when(F.col("alone") > 0, F.col("row"))  # it has a shingle that no other set has
    found = materialize(found.withColumn("key", F.xxhash64("n", "prefix", "alone", own)))
    groups = materialize(found.groupBy("key").agg(F.min("doc_id").alias("gid"), F.any_value("n").alias("n"), F.any_value("alone").alias("alone"), F.any_value("prefix").alias("prefix")))
    expand = found.select("key", "doc_id").join(groups.select("key", "gid"), "key").select(F.col("doc_id").alias("a"), F.col("gid").alias("b"))
    posts = groups.select("gid", "n", "alone", F.posexplode("prefix").alias("i", "token")).select("token", "gid", "n", (F.col("alone") + F.col("i") + 1).alias("at"))
    long = materialize(posts.groupBy("token").agg(F.count("*").alias("groups")).filter(F.col("groups") > LIST).select("token"))
    pairs = group_pairs(posts.join(long, "token", "left_anti"), percent)
    band = F.floor(F.log(F.col("n")) / (1.001 * math.log(100 / percent))).cast("long") if percent < 100 else F.col("n")
    many = materialize(posts.join(long, "token").select("gid", band.alias("band"), "token"))
    pivots = materialize(many.groupBy("token", "band").agg(F.min("gid").alias("pivot"), F.count("*").alias("members")))
    to_pivot = many.join(pivots.filter("members > 1").select("token", "band", "pivot"), ["token", "band"]).select(F.col("gid").alias("a"), F.col("pivot").alias("b"))
    next_band = pivots.select("token", (F.col("band") - 1).alias("band"), F.col("pivot").alias("above"))
    across = pivots.join(next_band, ["token", "band"]).select(F.col("pivot").alias("a"), F.col("above").alias("b"))
    return expand.unionByName(pairs).unionByName(to_pivot).unionByName(across).filter("a <> b")


def token_sets(texts: DataFrame, k: int) -> DataFrame:
    """Rows whose text has the set that ``n, s1, s2`` name, with ``tokens``, its sorted shingles, in place of the text."""
    names = [*PLACE, "doc_id", "n", "s1", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                own, keep = [], []
                for i, (text, n, s1, s2) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "n", "s1", "s2")), strict=True)):
                    tokens = np.unique(shingles(text, k) >> np.uint64(1))
                    if len(tokens) == n and signature(tokens) == (s1, s2):
                        own.append(tokens.astype(np.int64)), keep.append(i)
                if keep:
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(keep)) for c in names), lists], names=[*names, "tokens"])

    return texts.select(*names, "s2", "text").mapInArrow(run, "comp long, band long, h int, cuts int, above int, below int, doc_id long, n long, s1 long, copies long, tokens array<long>")


def placed(members: DataFrame, percent: int) -> DataFrame:
    """Members of candidate sets with the place of their block: ``comp, band, h, cuts, above, below``.

    A small set is one block. A larger one is cut by size band and then by hash into ``cuts`` blocks a band; ``above``
    and ``below`` are the cuts of the neighbouring bands, as linked sets lie in the same or in neighbouring ones.
    """
    sets = materialize(members.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).filter("docs > 1"))
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("shingles") <= BLOCK_TOKENS)
    band = F.floor(F.log(F.col("n")) / (1.001 * math.log(100 / percent))).cast("long") if percent < 100 else F.col("n")
    own = materialize(members.join(sets, "comp").withColumn("band", F.when(small, 0).otherwise(band)).drop("docs", "shingles"))
    cuts = own.groupBy("comp", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("cuts"))
    cuts = materialize(cuts)
    above = cuts.select("comp", (F.col("band") - 1).alias("band"), F.col("cuts").alias("above"))
    below = cuts.select("comp", (F.col("band") + 1).alias("band"), F.col("cuts").alias("below"))
    cuts = materialize(cuts.join(above, ["comp", "band"], "left").join(below, ["comp", "band"], "left").na.fill(0))
    return own.join(cuts, ["comp", "band"]).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int"))


def blocks(held: DataFrame) -> DataFrame:
    """One row per block: its place, ``id`` and its members in ``block``."""
    packed = held.groupBy(*PLACE).agg(F.collect_list(F.struct("doc_id", "s1", "copies", "tokens")).alias("block"))
    return packed.select(*PLACE, F.xxhash64("comp", "band", "h").alias("id"), "block")


def deal(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The left and right sides of all pairs of different blocks: ``key, h, id, block``; those of one ``key`` meet.

    Blocks of a band fall into at most GRID classes, and pairs of classes are the keys: a block goes to at most four
    times GRID of them, however many blocks a band has, and each pair of blocks meets under one key.
    """
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(GRID)) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.pmod(F.col("h"), F.least("cuts", F.lit(GRID)))
    cell = lambda band, step, x, y: F.struct(F.col("comp").alias("comp"), band.alias("band"), F.lit(step).alias("step"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    classes, band = upto(F.col("cuts")), F.col("band")
    several = F.col("cuts") > 1
    none = F.array().cast("array<struct<comp:bigint,band:bigint,step:int,x:int,y:int>>")
    left = F.concat(
        F.when(several, F.transform(F.filter(classes, lambda y: y >= own), lambda y: cell(band, 0, own, y))).otherwise(none),
        F.transform(upto(F.col("above")), lambda y: cell(band, 1, own, y)),
    )
    right = F.concat(
        F.when(several, F.transform(F.filter(classes, lambda x: x <= own), lambda x: cell(band, 0, x, own))).otherwise(none),
        F.transform(upto(F.col("below")), lambda x: cell(band - 1, 1, x, own)),
    )
    met = packed.filter("cuts > 1 OR above > 0 OR below > 0")
    return tuple(met.select(F.explode(side).alias("key"), "h", "id", "block") for side in (left, right))


class Block:
    """The sets of a block: ids, copies, sizes, and its distinct shingles with the rows that have them."""

    def __init__(self, rows: pa.StructArray) -> None:
        ids, s1 = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "s1"))
        lists = rows.field("tokens")
        sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
        keep = np.zeros(len(ids), bool)
        keep[np.unique(np.stack([ids, s1]), axis=1, return_index=True)[1]] = True  # a repeated row is one of the copies
        row = np.repeat(np.arange(len(ids)), sizes)
        flat, row = flat[keep[row]], (np.cumsum(keep) - 1)[row[keep[row]]]
        self.ids, self.copies, self.sizes = ids[keep], rows.field("copies").to_numpy(zero_copy_only=False)[keep], sizes[keep].astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.row = row[order]
        self.names, self.start, self.times = np.unique(flat[order], return_index=True, return_counts=True)


def _entries(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have the shingles ``at``, and which of them."""
    times = block.times[at]
    which = np.repeat(np.arange(len(at)), times)
    return block.row[np.repeat(block.start[at] - np.cumsum(times) + times, times) + np.arange(len(which))], which


def common_shingles(left: Block, right: Block) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``: few pairs are counted, many multiplied."""
    shape = (len(left.ids), len(right.ids))
    shared = np.zeros(shape, np.int64)
    _, a, b = np.intersect1d(left.names, right.names, assume_unique=True, return_indices=True)
    pairs = left.times[a] * right.times[b]
    rare = 100 * pairs < shape[0] * shape[1]
    la, lb, upto = a[rare], b[rare], np.cumsum(pairs[rare])
    at = 0
    while at < len(la):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 1_000_000, "right")))
        x, y = la[at:end], lb[at:end]
        row, which = _entries(left, x)
        many = right.times[y][which]
        place = np.repeat(right.start[y][which] - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared += np.bincount(np.repeat(row, many) * shape[1] + right.row[place], minlength=shape[0] * shape[1]).reshape(shape)
        at = end
    la, lb = a[~rare], b[~rare]
    for at in range(0, len(la), 4096):
        sides = []
        for block, some in ((left, la[at : at + 4096]), (right, lb[at : at + 4096])):
            hit = np.zeros((len(block.ids), len(some)), np.float32)
            hit[_entries(block, some)] = 1
            sides.append(hit)
        shared += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return shared


def linked_pairs(left: Block, right: Block | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Exact links of two blocks, or inside one: ids with links, a root that each reaches by them, and linked copies."""
    other = left if right is None else right
    shared = common_shingles(left, other)
    linked = 100 * shared >= percent * (left.sizes[:, None] + other.sizes[None, :] - shared)
    if right is None:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return
    above, a, b = np.iinfo(np.int64).max, left.ids.copy(), other.ids.copy()
    while True:  # smallest id among the neighbours until nothing changes
        low = np.minimum(a, np.where(linked, b[None, :], above).min(axis=1))
        back = np.minimum(b, np.where(linked, low[:, None], above).min(axis=0))
        if right is None:
            low = back = np.minimum(low, back)
        if (low == a).all() and (back == b).all():
            break
        a, b = low, back
    for block, root, links in ((left, a, linked @ other.copies), (other, b, linked.T @ left.copies))[: 1 if right is None else 2]:
        at = np.flatnonzero(links)
        yield block.ids[at], root[at], links[at]


def verify(pairs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, root, links`` of ``pairs(left_id, left, right)`` of blocks, added up in each task; a null ``right``: inside ``left``.

    ``links`` are linked documents, copies counted; ``root`` is a document reached by links, so that all of them span
    the components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        up: dict[int, int] = {}
        count: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def flush() -> pa.RecordBatch:
            out = [pa.array(x, pa.int64()) for x in (list(count), [root(x) for x in count], list(count.values()))]
            up.clear(), count.clear()
            return pa.RecordBatch.from_arrays(out, names=["doc_id", "root", "links"])

        last, left = None, None
        for batch in batches:
            for at, block in enumerate(batch.column("left_id").to_pylist()):
                if left is None or block != last:
                    last, left = block, Block(batch.column("left")[at].values)
                right = batch.column("right")[at]
                for ids, roots, links in linked_pairs(left, Block(right.values) if right.is_valid else None, percent):
                    for x, y, n in zip(ids.tolist(), roots.tolist(), links.tolist(), strict=True):
                        count[x] = count.get(x, 0) + n
                        x, y = root(x), root(y)
                        up[max(x, y)] = min(x, y)
                if len(count) > TASK_DOCS:
                    yield flush()
        yield flush()

    return pairs.select("left_id", "left", "right").mapInArrow(run, "doc_id long, root long, links long")


def links_of(packed: DataFrame, percent: int) -> DataFrame:
    """Exact links inside the blocks of ``packed`` and between them."""
    left, right = deal(packed)
    left = left.select("key", F.col("h").alias("left_h"), F.col("id").alias("left_id"), F.col("block").alias("left"))
    right = right.select("key", "h", F.col("block").alias("right"))
    once = (F.col("key.x") < F.col("key.y")) | (F.col("key.step") == 1) | (F.col("left_h") < F.col("h"))
    across = left.hint("merge").join(right, "key").filter(once).select("left_id", "left", "right")
    inside = packed.select(F.col("id").alias("left_id"), F.col("block").alias("left"), F.lit(None).cast(packed.schema["block"].dataType).alias("right"))
    return verify(inside, percent).unionByName(verify(across, percent))


def similarity_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, n_links``.

    Two documents are linked if their sets of distinct k-word shingles have a Jaccard similarity of ``percent`` / 100 or
    more; ``component_id`` is the smallest doc_id that links reach, ``n_links`` the number of linked rows. A null or
    wordless text has no shingle and no link; a row with a null doc_id has no link and a null component; rows that
    repeat a doc_id are one node. Other columns are ignored; an empty table gives no rows.
    """
    rows = materialize(sketch(docs, k, percent))
    slim = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "n", "s1", "s2", "row")
    first = F.min(F.struct("doc_id", "row"))
    sets = slim.groupBy("n", "s1", "s2").agg(first["doc_id"].alias("doc_id"), first["row"].alias("row"), F.count("*").alias("copies"))
    sets = materialize(sets)  # equal sets are one from here on
    own = rows.select("row", "doc_id", "n", "ranked", "low").join(sets.select("row"), "row", "left_semi")
    found = materialize(prefixes(own, percent))
    comps = materialize(connected_components(candidate_edges(found, percent)))
    members = sets.join(comps.withColumnRenamed("node", "doc_id"), "doc_id").select(F.col("component").alias("comp"), "n", "s1", "s2", "doc_id", "copies")
    place = materialize(placed(materialize(members), percent))
    wanted = materialize(place.select("doc_id").distinct())
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id")
    checked = materialize(links_of(materialize(blocks(token_sets(place.join(texts, "doc_id"), k))), percent))
    final = connected_components(checked.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("doc_id").agg(F.sum("links").alias("links"))
    linked = materialize(links.join(final.withColumnRenamed("node", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "component", "links"))
    copies = materialize(sets.filter("copies > 1").select("n", "s1", "s2", F.col("doc_id").alias("rep"), "copies"))
    with_rep = rows.select("doc_id", "n", "s1", "s2").join(copies, ["n", "s1", "s2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")))
    joined = with_rep.join(linked, "rep", "left")
    real = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(real, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(real, F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )
