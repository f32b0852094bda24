"""Packing of tokenised documents into sequences.

Only the histogram of piece lengths decides who lies with whom, and it has at most ``capacity`` rows. Dominance
reduction (Martello and Toth) first fixes bins that some best packing has, then best-fit takes the rest; both work on
counts, so the plan is a small table of bin patterns. Pieces are numbered within their length, and number ranges meet
the plan's slots.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize, release_memory

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"

#: How this tokenizer finds words; texts that try its corners.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBES = (" The quick brown fox", "don't  we'll\n\n stop.\t x", "1234 a1b2 \u00e9\u00df\u6f22 \U0001f600\u200d", " nterthish hoverestion", "&amp;&&& %%% $$$ ###", "<|endoftext|> a", "\xa0\u2003 b\x00c", "IT'S 'tis''re")

_workers: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids as little-endian uint32 bytes, with a cache by blank-separated chunk.

    This tokenizer starts a new word at each blank that something visible follows, so that chunks between such blanks
    may be encoded apart. Texts in which a blank is followed by white space or nothing are encoded whole.
    """

    MOST, SHORT = 100_000, 48  # cached chunks in all, and their characters: some 30 MB; longer ones are encoded each time

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.fast = self._same_in_fewer_seconds()

    def _same_in_fewer_seconds(self):
        """The file's vocabulary in tiktoken, four times as fast; None unless it gives the tokenizer's ids for all probes."""
        import tiktoken

        byte_of = {}
        for b in range(256):  # byte-level vocabularies write visible bytes as themselves and the others from U+0100 on
            shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
            byte_of[chr(b if shown else 256 + len([c for c in byte_of if ord(c) > 255]))] = b
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        try:
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            fast = tiktoken.Encoding("same", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            same = all(fast.encode_ordinary(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in PROBES)
        except (KeyError, ValueError):
            return None
        return fast if same else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.fast:
            return [array("I", ids).tobytes() for ids in map(self.fast.encode_ordinary, texts)]
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _look_up(self, cache: dict[str, bytes], chunks: set[str], before: str) -> dict[str, bytes]:
        """Ids of those chunks that are new to the cache; short ones are put there, long ones only returned."""
        new = list(chunks - cache.keys())
        found = dict(zip(new, self._encode([before + x for x in new]), strict=True))
        cache.update((x, ids) for x, ids in found.items() if len(x) <= self.SHORT)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.later) + len(self.first) > self.MOST:
            self.later, self.first = {}, {}
        cut = [t.split(" ") for t in texts]
        first, later = self.first, self.later
        heads = self._look_up(first, {c[0] for c in cut}, "")
        rest = set()
        for c in cut:
            rest.update(c[1:])
        tails = self._look_up(later, {x for x in rest if x and not x[0].isspace()}, " ")
        out = []
        for text, c in zip(texts, cut, strict=True):
            try:
                out.append((first.get(c[0]) or heads.get(c[0], b"")) + b"".join([later.get(x) or tails[x] for x in c[1:]]))
            except KeyError:  # a blank before white space or the end
                out.append(self._encode([text])[0])
        return out


def tokenized_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, end each document with END_ID and cut only what is longer than ``capacity``.

    Cut pieces are full, but for the first. ``part`` and ``number`` place each piece among those of its length in its
    task. Null texts are empty. The result has to be written before use, which fixes these numbers.
    """
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        release_memory()
        encoder = _workers.setdefault(path, None) or _workers.__setitem__(path, Encoder(path)) or _workers[path]
        part, seen = TaskContext.get().partitionId(), Counter()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 512):
                ids = batch.column(0).slice(at, 512).to_pylist()
                texts = [x or "" for x in batch.column(1).slice(at, 512).to_pylist()]
                rows = []
                for doc_id, data in zip(ids, encoder.encode(texts), strict=True):
                    data += end
                    n, start, piece = len(data) // 4, 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity if piece == 0 else capacity
                        rows.append((doc_id, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix bins that dominate every other bin with the same item; return (pattern, times) and what is left.

    For each length L, the largest first: with a partner that fills the bin exactly, that pair dominates. If nothing
    fits beside L it stays alone. If no two items fit beside L, L with the largest that fits dominates. Else L is left
    for best-fit. A partner may be longer than L; only the single item L itself is none.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for big in sorted(left, reverse=True):
            while left.get(big):
                others = Counter(left)  # what may lie beside one item of this length
                others[big] -= 1
                fitting = sorted(x for x, n in others.items() if n and x <= capacity - big)
                if not fitting:
                    pattern, times = (big,), 1 if big * 2 <= capacity else left[big]
                else:
                    two = fitting[0] * 2 if others[fitting[0]] > 1 else sum(fitting[:2]) if len(fitting) > 1 else capacity
                    if fitting[-1] != capacity - big and two <= capacity - big:
                        break
                    pattern = (big, fitting[-1])
                    times = left[big] // 2 if fitting[-1] == big else min(left[big], left[fitting[-1]])
                fixed.append((pattern, times))
                changed = True
                for x in pattern:
                    left[x] -= times
                    if not left[x]:
                        del left[x]
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: bins in the same state are one entry."""
    states: dict[int, Counter] = defaultdict(Counter)  # room left -> pattern -> bins
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], room: int, times: int) -> None:
        if room not in states or not states[room]:
            if room not in rooms:
                bisect.insort(rooms, room)
        states[room][pattern] += times

    for length in sorted(counts, reverse=True):
        need = counts[length]
        while need:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                full, rest = divmod(need, per)
                if full:
                    put((length,) * per, capacity - per * length, full)
                if rest:
                    put((length,) * rest, capacity - rest * length, 1)
                break
            room = rooms[at]
            pattern, times = next(iter(states[room].items()))
            take = min(times, need)
            states[room][pattern] -= take
            if not states[room][pattern]:
                del states[room][pattern]
            if not states[room]:
                rooms.pop(at)
            put((*pattern, length), room - length, take)
            need -= take
    return [(p, n) for room in sorted(states) for p, n in states[room].items() if n]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns with their number of bins; together they hold each length exactly as often as counted."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length rows (first number, first bin, offset), sorted: the i-th piece of a length lies in the last row's range."""
    used, bins, found = Counter(), 0, defaultdict(list)
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            found[length].append((used[length], bins, offset))
            used[length] += times
            offset += length
        bins += times
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Null and empty texts are one end token.
    Repeated rows are packed each, a null doc_id stays null, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, tokenizer, capacity))
    per_task = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    # At most `capacity` rows reach the driver.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(plan_bins(counts, capacity)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = materialize(per_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("base")))
    numbered = pieces.join(base, ["length", "part"]).withColumn("number", F.col("number") + F.col("base")).drop("part", "base")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros_like(number), np.zeros_like(number)
            for x in np.unique(length):
                own, table = length == x, plan.value[int(x)]
                row = np.searchsorted(table[:, 0], number[own], side="right") - 1
                sequence[own] = table[row, 1] + number[own] - table[row, 0]
                offset[own] = table[row, 2]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("start"), batch.column("length"), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=names)

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
