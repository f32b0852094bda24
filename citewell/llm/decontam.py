"""Benchmark decontamination: BM25 over an inverted index of test items, by block-max WAND, then verification.

Every training passage (a window of words, overlapping by half, so that any item lies whole in one) is a query, and all
items above a threshold are wanted. An item's weights are divided by its own threshold, so that 1 holds for all. Posting
lists are sorted by item and cut into blocks of items with the block's greatest weight. The threshold never moves, so
WAND's pivot is the same for a passage's whole lists: sorted by their greatest weights, the lists before the pivot
together can't reach the threshold, and no item that only they hold is ever touched. The blocks of the other lists are
bounded by block maxima over all lists, and the postings of those that may reach the threshold are scored exactly. These
steps are made for the passages of many texts at once, on arrays. Item and document are then compared by shingles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, release_memory, rolling

MARKS = b".,;:!?\"'()[]"
K1, B = 1.2, 0.75
#: Words of the test items in one index, about; a larger benchmark is queried in several passes.
INDEX_WORDS = 2_000_000
BLOCK_ITEMS = 8
#: Raw tokens that are remembered, and their bytes: some 20 MB.
MOST_CACHED, SHORT = 100_000, 64
#: Words, postings or block entries, and texts that are worked on together; these bound memory and change no result.
BATCH_WORDS, BATCH_ENTRIES, BATCH_TEXTS = 50_000, 1_000_000, 500
#: An item's threshold is taken so much lower than computed, and as this share of its score at least: rounding only.
#: A word's weight is no less than half of one by the number of items, so that real shares lie far above.
ROUNDING, LEAST_SHARE = 1e-3, 1e-13
HITS = "doc_id long, item_id long, n_shingles long, n_matched long, n_question long, n_answer long, bm25 double"


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII blanks, without punctuation at the ends."""
    return [w for x in text.encode().lower().split() if (w := x.strip(MARKS))]


def item_shingles(words: list, k: int) -> list[tuple]:
    k = min(k, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the windows of k term ids, in order."""
    return rolling(ids.astype(np.uint64), k) if len(ids) >= k else np.zeros(0, np.uint64)


def most_lost(weights: list[float], k: int, spare: int) -> float:
    """The greatest sum of word weights that a text can lack while at most ``spare`` of its k-word windows are broken.

    A lost word breaks the windows over it. Kept for every number of broken windows: the most lost up to a word.
    """
    n = len(weights)
    k = min(k, n)
    last = n - k  # the last window's start
    best = {(-1, 0): 0.0}  # (last broken window, broken windows) -> weight lost
    for i, w in enumerate(weights):
        after = dict(best)
        upto = min(i, last)
        for (end, used), lost in best.items():
            broken = used + max(0, upto - max(end, i - k, -1))
            if broken <= spare and after.get((upto, broken), -1.0) < lost + w:
                after[upto, broken] = lost + w
        best = {key: lost for key, lost in after.items() if key[0] > i - k or key[0] == -1}
        for (end, used), lost in after.items():  # windows that end here or before all count as none
            if -1 < end <= i - k and best.get((-1, used), -1.0) < lost:
                best[-1, used] = lost
    return max(best.values())


@dataclass
class Index:
    terms: dict[bytes, int]
    item_ids: list[int]
    shingles: list[np.ndarray]  # hashes, in order
    sizes: list[int]
    starts: np.ndarray  # per term: where its postings begin, and one more
    items: np.ndarray
    weights: np.ndarray
    most: np.ndarray  # per term: its greatest weight
    block_starts: np.ndarray  # per term: where its block entries begin, and one more
    blocks: np.ndarray
    block_most: np.ndarray
    shares: np.ndarray  # per item: its threshold as a share of its own best score
    window: int


def build_index(items: list[tuple[int, str]], df: dict[bytes, int], n_items: int, average: float, k: int, percent: int = 80, threshold: float = 0.5) -> Index:
    """Index the items; ``df``, ``n_items`` and ``average`` length are of the whole benchmark.

    An item's threshold is ``threshold`` of its own score, or less where ``percent`` of its shingles can leave less,
    however little that is: where an item's weight lies in few words, a passage with any of them is compared.
    """
    rows = sorted((len(w := words_of(t)), i, w) for i, t in items)
    rows = [r for r in rows if r[0]]
    terms: dict[bytes, int] = {}
    found: list[tuple[int, int, float]] = []
    shares = []
    for at, (size, _, words) in enumerate(rows):
        weights = {}
        for w, tf in Counter(words).items():
            idf = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
            weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))
        best = sum(weights.values())
        n_shingles = max(1, size - k + 1)
        spare = n_shingles - -(-percent * n_shingles // 100)
        own = [weights[w] for w in words]
        share = threshold
        if sum(sorted(own)[len(own) - spare :]) > (1 - threshold) * best:  # no more than `spare` words can be lost
            share = max(LEAST_SHARE, min(threshold, (1 - most_lost(own, k, spare) / best) * (1 - ROUNDING)))
        shares.append(share)
        found += [(terms.setdefault(w, len(terms)), at, x / best / shares[-1]) for w, x in weights.items()]
    found.sort()
    term, item, weight = (np.array([x[i] for x in found], t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    numbers = np.arange(len(terms) + 1)
    starts = np.searchsorted(term, numbers)
    n_blocks = -(-len(rows) // BLOCK_ITEMS)
    entries, at = np.unique(term * max(1, n_blocks) + item // BLOCK_ITEMS, return_inverse=True)
    most = np.zeros(len(terms))
    np.maximum.at(most, term, weight)
    block_most = np.zeros(len(entries))
    np.maximum.at(block_most, at, weight)
    ids = [np.array([terms[w] for w in r[2]], np.int64) for r in rows]
    return Index(
        terms, [r[1] for r in rows], [shingle_hashes(x, min(k, len(x))) for x in ids], [r[0] for r in rows], starts, item, weight, most,
        np.searchsorted(entries, numbers * max(1, n_blocks)), entries % max(1, n_blocks), block_most, np.array(shares), 2 * max((r[0] for r in rows), default=1),
    )


class TermIds(dict):
    """raw token -> term id, -1 unknown, -2 nothing but punctuation; a bounded cache."""

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, token: bytes) -> int:
        w = token.strip(MARKS)
        found = self.terms.get(w, -1) if w else -2
        if len(token) <= SHORT:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[token] = found
        return found


def _rows(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists ``which``, one after the other, and for each place the position of its list in ``which``."""
    sizes = starts[which + 1] - starts[which]
    to = np.cumsum(sizes)
    of = np.repeat(np.arange(len(which)), sizes)
    return np.arange(to[-1] if len(to) else 0) - np.repeat(to - sizes - starts[which], sizes), of


def wand(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, item, score) with a score of 1 or more, from the passages' distinct terms, sorted by passage."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    n_items, n_blocks = len(index.item_ids), -(-len(index.item_ids) // BLOCK_ITEMS)
    least = 1 - 1e-5
    order = np.lexsort((index.most[term], passage))  # each passage's lists by their greatest weights
    passage, term = passage[order], term[order]
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(passage) else np.zeros(0, np.int64)
    upto = np.cumsum(index.most[term])
    sizes = np.diff(np.r_[first, len(term)])
    upto -= np.repeat(upto[first] - index.most[term[first]], sizes)
    alive = np.repeat(upto[np.r_[first[1:], len(term)] - 1] >= least, sizes) if len(first) else np.zeros(0, bool)
    passage, term, pivot = passage[alive], term[alive], (upto >= least)[alive]
    if not len(term):
        return none
    places, of = _rows(index.block_starts, term[pivot])
    wanted = np.unique(passage[pivot][of] * n_blocks + index.blocks[places])  # blocks that a list from the pivot on holds
    places, of = _rows(index.block_starts, term)
    key = passage[of] * n_blocks + index.blocks[places]
    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    hit = wanted[at] == key
    bound = np.bincount(at[hit], weights=index.block_most[places[hit]], minlength=len(wanted))
    wanted = wanted[bound >= least]
    if not len(wanted):
        return none
    live = np.isin(passage, wanted // n_blocks)
    passage, term = passage[live], term[live]
    places, of = _rows(index.starts, term)
    key = passage[of] * n_blocks + index.items[places] // BLOCK_ITEMS
    hit = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
    places, of = places[hit], of[hit]
    pairs, at = np.unique(passage[of] * n_items + index.items[places], return_inverse=True)
    scores = np.bincount(at, weights=index.weights[places], minlength=len(pairs))
    good = scores >= 1 - 1e-9
    return pairs[good] // n_items, pairs[good] % n_items, scores[good]


def retrieve(index: Index, ids: list[np.ndarray]) -> dict[tuple[int, int], float]:
    """(text, item) -> best BM25 share over the text's passages, for all at or above the item's threshold."""
    half = max(1, index.window // 2)
    n_terms = max(1, len(index.terms))
    counts = [max(1, -(-len(x) // half)) for x in ids]
    first = np.concatenate([[0], np.cumsum(counts)])
    keys = []
    for i, x in enumerate(ids):
        at = np.flatnonzero(x >= 0)
        passage = first[i] + at // half
        keys.append(passage * n_terms + x[at])
        back = at >= half
        keys.append((passage[back] - 1) * n_terms + x[at[back]])
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    passage, term = np.divmod(keys, n_terms)
    work = np.cumsum(index.starts[term + 1] - index.starts[term])
    found: dict[tuple[int, int], float] = {}
    at = 0
    while at < len(keys):  # passages in batches by the length of their lists
        end = int(np.searchsorted(work, (work[at - 1] if at else 0) + BATCH_ENTRIES, side="right"))
        end = max(end, at + 1)
        end = int(np.searchsorted(passage, passage[end - 1], side="right")) if end < len(keys) else end
        for p, item, score in zip(*wand(index, passage[at:end], term[at:end]), strict=True):
            key = int(np.searchsorted(first, p, side="right")) - 1, int(item)
            found[key] = max(found.get(key, 0.0), float(score * index.shares[item]))
        at = end
    return found


def _searches(benchmark: DataFrame, k: int, percent: int, part_percent: int, threshold: float) -> list[Callable[[list[bytes | None]], list[tuple]]]:
    """One function per index over a part of the benchmark: texts -> (text's number, item_id, counts as in HITS, score)."""
    spark = benchmark.sparkSession
    items = materialize(benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))

    def count(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                yield pa.RecordBatch.from_arrays([pa.array([b"", *sorted(set(words))], pa.binary()), pa.array([len(words), *[1] * len(set(words))], pa.int64())], names=["term", "n"])

    df = materialize(items.mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")))
    total = df.filter(F.octet_length("term") == 0).first()
    n_items = items.count()
    n_parts = -(-total["n"] // INDEX_WORDS) if total and total["n"] else 0

    def search(index) -> Callable[[list[bytes | None]], list[tuple]]:
        caches: dict[int, TermIds] = {}

        def run(texts: list[bytes | None]) -> list[tuple]:
            x = index.value
            cache = caches.setdefault(0, None) or caches.__setitem__(0, TermIds(x.terms)) or caches[0]
            rows, at = [], 0
            while at < len(texts):
                ids, words, start = [], 0, at
                while at < len(texts) and (words < BATCH_WORDS or at == start):
                    tokens = (texts[at] or b"").lower().split()
                    own = np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))
                    ids.append(own[own > -2])
                    words, at = words + len(tokens), at + 1
                sets: dict[tuple[int, int], np.ndarray] = {}
                for (text, item), score in sorted(retrieve(x, ids).items()):
                    size = min(k, x.sizes[item])
                    if (text, size) not in sets:
                        sets[text, size] = np.unique(shingle_hashes(ids[text], size))
                    hit = np.isin(x.shingles[item], sets[text, size])
                    answer_from = max(0, 2 * x.sizes[item] // 3 - size + 1)  # first shingle that ends in the answer
                    n, question, answer = int(hit.sum()), int(hit[:answer_from].sum()), int(hit[answer_from:].sum())
                    if 100 * n >= percent * len(hit) and 100 * question >= part_percent * answer_from and 100 * answer >= part_percent * (len(hit) - answer_from):
                        rows.append((start + text, x.item_ids[item], len(hit), n, question, answer, score))
            return rows

        return run

    searches = []
    for part in range(n_parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part).distinct().collect()  # about INDEX_WORDS words
        terms = spark.createDataFrame([(w,) for w in sorted({w for r in own for w in words_of(r["text"])})], "term binary")
        known = {bytes(r["term"]): r["n"] for r in df.join(F.broadcast(terms), "term").collect()}
        searches.append(search(spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in own], known, n_items, total["n"] / n_items, k, percent, threshold))))
    return searches


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, BATCH_TEXTS) for batch in batches for at in range(0, len(batch), BATCH_TEXTS))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, part_percent: int = 50, threshold: float = 0.5) -> DataFrame:
    """All pairs of a document and a test item that it contains: HITS, with the item's shingles and those matched.

    A pair counts if ``percent`` % of the item's k-word shingles occur in the document, and ``part_percent`` % of those
    that end in its question and of those that end in its answer (its last third). Retrieval asks for ``threshold`` of
    the item's own BM25 score in one passage of twice the longest item's words, or for less where that share of an
    item's shingles can leave less; an item scattered over a document in parts that never lie in one passage is not
    found. Items shorter than k words are one shingle; items without words, null texts and empty tables give no pairs.
    Repeated rows give repeated pairs; other columns are ignored. The documents are read once per INDEX_WORDS words of
    the benchmark.
    """
    names = [x.split()[0] for x in HITS.split(", ")]
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    result = None
    for search in _searches(benchmark, k, percent, part_percent, threshold):

        def query(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            release_memory()
            for batch in _slices(batches):
                doc_ids = batch.column(0).to_pylist()
                found = [(doc_ids[r[0]], *r[1:]) for r in search(batch.column(1).to_pylist())]
                if found:
                    kinds = [pa.float64() if n == "bm25" else pa.int64() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        hits = rows.mapInArrow(query, HITS)
        result = hits if result is None else result.unionByName(hits)
    return docs.sparkSession.createDataFrame([], HITS) if result is None else result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, part_percent: int = 50, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that contain no test item (see ``contaminated``), with all their columns.

    Each row is judged for itself, so that null and repeated ids don't matter; a null or empty text stays.
    """
    schema = docs.schema
    at = docs.columns.index("text")
    for search in _searches(benchmark, k, percent, part_percent, threshold):

        def clean(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            release_memory()
            for batch in _slices(batches):
                leaks = {r[0] for r in search([None if t is None else t.encode() for t in batch.column(at).to_pylist()])}
                yield batch.filter(pa.array([i not in leaks for i in range(len(batch))], pa.bool_()))

        docs = docs.mapInArrow(clean, schema)
    return docs
