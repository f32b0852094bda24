"""Cross-entropy difference: a target and a background bigram model over all words score each document."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import mix, word_hashes

#: Symbols that the smoothing spreads over, at least: more words than these count as many as they are.
SYMBOLS = 1 << 16
#: The number of a text's start for a caller that numbers words from 1; nothing here depends on it.
START = SYMBOLS - 1
MIX, ADDED = 0.7, 0.5
#: Bytes of text in one block, about; each text has ROW_BYTES besides.
BLOCK_BYTES, ROW_BYTES = 8 << 20, 100
#: One doc_id's rows are dealt over this many blocks, each with its own copy of the target ids.
SALTS = 16
COUNTS = "block long, part long, n binary, n_target binary, words long, tokens long, target_tokens long"


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *more)


def pack(values: np.ndarray) -> bytes:
    """Numbers by byte planes, most of them zero, compressed here as Spark's sort would hold them whole."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


class Block:
    """The words of some texts and, in order, the 63-bit keys of their distinct bigrams, words and contexts; a word's key is odd.

    A context is a word, or the start of a text, as what another word follows.
    """

    def __init__(self, texts: list[bytes]):
        found = [word_hashes(_words(t)) for t in texts]
        self.sizes = np.array([len(x) for x in found], np.int64)
        own = np.concatenate([*found, np.zeros(0, np.uint64)])
        del found
        self.of = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        words, self.word = np.unique(own, return_inverse=True)
        self.word = self.word.astype(np.int32)
        contexts = np.r_[words, np.uint64(0)]
        self.before = np.r_[np.int32(len(words)), self.word[:-1]][: len(own)]
        self.before[np.r_[True, self.of[1:] != self.of[:-1]][: len(own)]] = len(words)
        even = np.uint64(2**64 - 2)
        pairs = mix(mix(contexts[self.before]) * np.uint64(0x9E3779B97F4A7C15) + own) & even
        del own
        pairs, self.pair = np.unique(pairs, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        keys = np.concatenate([pairs, mix(words ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1), mix(contexts ^ np.uint64(0x14057B7EF767814F)) & even])
        self.at = np.cumsum([0, len(pairs), len(words), len(contexts)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """The weights' sums by key."""
        parts = (self.pair, self.word, self.before)
        return np.concatenate([np.bincount(x, weights=weights, minlength=n) for x, n in zip(parts, np.diff(self.at), strict=True)])[self.order]

    def losses(self, counts: np.ndarray, tokens: int, words: int) -> np.ndarray:
        """Per word -log P(word | previous): bigram shares mixed with smoothed word shares, from the whole corpus's counts by key."""
        by = np.empty(len(counts), np.float64)
        by[self.order] = counts
        pair, word, context = (by[a + x] for a, x in zip(self.at, (self.pair, self.word, self.before), strict=False))
        single = (word + ADDED) / (tokens + ADDED * max(SYMBOLS, words + 2))
        share = np.divide(pair, context, out=single.copy(), where=context > 0)
        return -np.log(MIX * share + (1 - MIX) * single)


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_tokens, target_loss, background_loss, score``.

    ``target`` names the target documents by ``doc_id``; the background is all documents. Words are cut at ASCII blanks,
    A-Z lower-cased; both models hold all words and bigrams (by 63-bit hashes), so that none is unknown. Losses are means
    per word in nats; ``score`` is the mean of the words' differences (target minus background): the lower, the more like
    the target. A null or wordless text has no words and null losses. Without target documents the target model is the
    uniform one. Repeated rows count and are scored each; other columns are ignored; an empty table gives no rows.

    Texts are dealt into blocks by a hash. Each block sends its distinct keys with its counts to the keys' owners; these
    add up all blocks' counts and send each block the sums of its keys, with which it scores its texts. A key comes once
    from a block however often it occurs, so a very common word or pair makes no large group.
    """
    spark = docs.sparkSession
    texts = _texts(docs)
    n_blocks = max(1, math.ceil((texts.agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES))).first()[0] or 0) / BLOCK_BYTES))
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS))
    by_id = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", salt))
    rows = texts.select(F.pmod(by_id, F.lit(n_blocks)).alias("block"), "doc_id", "text")
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    copies = ids.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    chosen = copies.select(F.pmod(F.xxhash64("doc_id", "salt"), F.lit(n_blocks)).alias("block"), "doc_id", F.lit(None).cast("binary").alias("text"))
    blocks = rows.unionByName(chosen)  # a row without a text is a target id
    edges = np.array([i * 2**64 // n_blocks for i in range(1, n_blocks)], np.uint64)

    def ask(block: pa.Table) -> pa.Table:
        is_text = pc.is_valid(block.column("text"))
        ids = set(block.filter(pc.invert(is_text)).column("doc_id").to_pylist())
        own = block.filter(is_text)
        if not len(own):
            return pa.table({k: pa.array([], t) for k, t in (("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("n_target", pa.binary()))})
        found = Block(own.column("text").to_pylist())
        wanted = np.array([x in ids for x in own.column("doc_id").to_pylist()], np.float64)
        sums = [found.counts(np.ones(len(found.of))), found.counts(wanted[found.of])]
        cut = np.searchsorted(found.keys, edges)
        keys = [pack(np.diff(k, prepend=np.uint64(0))) for k in np.split(found.keys, cut)]
        n, n_target = ([pack(x) for x in np.split(s, cut)] for s in sums)
        number = block.column("block")[0].as_py()
        return pa.table({"part": pa.array(range(n_blocks), pa.int64()), "block": pa.array([number] * n_blocks, pa.int64()), "keys": pa.array(keys, pa.binary()), "n": pa.array(n, pa.binary()), "n_target": pa.array(n_target, pa.binary())})

    def add(part: pa.Table) -> pa.Table:
        lists = [np.cumsum(unpack(k), dtype=np.uint64) for k in part.column("keys").to_pylist()]
        cut = np.cumsum([len(x) for x in lists])[:-1]
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        del lists
        is_word = (keys & np.uint64(1)).astype(bool)
        sums, totals = [], []
        for name in ("n", "n_target"):
            total = np.bincount(at, weights=np.concatenate([unpack(x) for x in part.column(name).to_pylist()]), minlength=len(keys))
            totals.append(int(total[is_word].sum()))
            sums.append(pa.array([pack(x) for x in np.split(total[at], cut)], pa.binary()))
        same = lambda x: pa.array([x] * len(part), pa.int64())
        return pa.table([part.column("block"), part.column("part"), *sums, same(int(is_word.sum())), same(totals[0]), same(totals[1])], names=["block", "part", "n", "n_target", "words", "tokens", "target_tokens"])

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = block.filter(pc.is_valid(block.column("text")))
        found = Block(own.column("text").to_pylist())
        none = found.sizes == 0
        means = []
        if len(own):
            answers = answers.sort_by("part")
            words, tokens, target_tokens = (sum(answers.column(c).to_pylist()) for c in ("words", "tokens", "target_tokens"))
            for name, total in (("n_target", target_tokens), ("n", tokens)):
                losses = found.losses(np.concatenate([unpack(x) for x in answers.column(name).to_pylist()]), total, words)
                means.append(np.divide(np.bincount(found.of, weights=losses, minlength=len(own)), found.sizes, out=np.zeros(len(own)), where=~none))
        else:
            means = [np.zeros(0), np.zeros(0)]
        values = [pa.array(x, pa.float64(), mask=none) for x in (*means, means[0] - means[1])]
        return pa.table([own.column("doc_id"), pa.array(found.sizes), *values], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    asked = blocks.groupBy("block").applyInArrow(ask, "part long, block long, keys binary, n binary, n_target binary")
    counts = asked.groupBy("part").applyInArrow(add, COUNTS)
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
