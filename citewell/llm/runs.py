"""Periodic runs of words: a suffix automaton whose links carry the last occurrence, recoloured by link-cut access.

The automaton of a text has a state per set of end places. When word i is appended, all suffixes of what was read, the
path from the root to one state, get i as their last end. Preferred paths of one colour are splay trees, so an access
recolours that path and meets each stretch of one former end e once. If the longest suffix with that end has at least
``i - e`` words, those end places are the two halves of a square of period ``i - e``, and the length says how far it
reaches back; a stretch of such squares that share a start is a run.

Before that, the text is cut to the windows that can hold a run: inside a run of period q, from word q + 3 on, the four
words that end at a place were last seen at most q places earlier. Windows are found by hashes; equal words always have
equal hashes, so no run is lost, and what is reported comes from the automaton alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import rolling, word_hashes

#: A run has at least this many words and this many periods.
LEAST, TIMES = 6, 4
#: Words of the hashed groups that find windows.
GROUP = 4


def windows(h: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint parts of a text, by its words' hashes, that each hold whole all runs they share a word with."""
    n = len(h)
    if n < least:
        return []
    grams = rolling(h, GROUP)
    code = np.unique(grams, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    back = np.full(len(code), n, dtype=np.int64)
    again = code[order[1:]] == code[order[:-1]]
    if not again.any():
        return []
    back[order[1:][again]] = (order[1:] - order[:-1])[again]
    cover = np.zeros(n + 1, dtype=np.int64)
    most = 1
    while most <= 2 * n // times:  # periods over most / 2, up to most
        near = np.r_[False, back <= most, False]
        edge = np.flatnonzero(near[1:] != near[:-1])
        first, last = edge[::2], edge[1::2]
        period = most // 2 + 1
        fits = last - first >= max(least, times * period) - period - (GROUP - 1)
        np.add.at(cover, np.maximum(first[fits] - most, 0), 1)
        np.add.at(cover, last[fits] + GROUP - 1, -1)
        most *= 2
    inside = np.r_[False, np.cumsum(cover)[:n] > 0, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


class Automaton:
    """Suffix automaton of a sequence: suffix links, lengths, and the state of each prefix."""

    def __init__(self, text: list[int]):
        # state 1 is the root, 0 none; a state's first transition is kept apart, as most have one only
        self.link, self.length = [0, 0], [0, 0]
        word, to, more = [-1, -1], [0, 0], {}
        self.prefix = []
        last = 1
        link, length = self.link, self.length
        for c in text:
            new = len(link)
            link.append(0), length.append(length[last] + 1), word.append(-1), to.append(0)
            p = last
            q = 0
            while p:
                if word[p] == c:
                    q = to[p]
                    break
                if p in more and c in more[p]:
                    q = more[p][c]
                    break
                if word[p] < 0:
                    word[p], to[p] = c, new
                else:
                    more.setdefault(p, {})[c] = new
                p = link[p]
            if not p:
                link[new] = 1
            elif length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q]), length.append(length[p] + 1), word.append(word[q]), to.append(to[q])
                if q in more:
                    more[copy] = dict(more[q])
                while p:
                    if word[p] == c:
                        if to[p] != q:
                            break
                        to[p] = copy
                    elif p in more and more[p].get(c) == q:
                        more[p][c] = copy
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = copy
            last = new
            self.prefix.append(new)


def squares(text: list[int]) -> Iterator[tuple[int, int, int]]:
    """``i, e, size``: the suffixes of the first i words whose last end before was e, the longest of them with ``size`` words."""
    automaton = Automaton(text)
    parent, length = list(automaton.link), automaton.length  # parent: in a splay tree, or of a whole path's top
    parent[1] = 0
    n = len(parent)
    left, right, colour = [0] * n, [0] * n, [0] * n  # colour: of a path, kept at its splay tree's root

    def turn(x: int) -> None:
        """Rotate x above its parent; what becomes a splay tree's root takes the colour over."""
        p = parent[x]
        g = parent[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            parent[b] = p
        parent[p], parent[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
            else:
                colour[x] = colour[p]
        else:
            colour[x] = colour[p]

    def splay(x: int) -> None:
        while (p := parent[x]) and (left[p] == x or right[p] == x):
            g = parent[p]
            if g and (left[g] == p or right[g] == p):
                turn(p if (left[g] == p) == (left[p] == x) else x)
            turn(x)

    for i, state in enumerate(automaton.prefix, 1):
        x, below = state, 0
        while x:
            splay(x)
            e = colour[x]
            r = right[x]
            if r:
                colour[r] = e
            right[x] = below
            if e and x != 1:
                yield i, e, length[x]
            below, x = x, parent[x]
        splay(state)
        colour[state] = i


def find_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs, by start and then period.

    A run is a stretch of words with smallest period q, of at least ``least`` words and ``times`` periods, that no
    neighbouring word extends. ``least`` is at least 4 and ``times`` at least 2.
    """
    if len(words) < least:
        return []
    found = []
    for a, b in windows(word_hashes(words), least, times):
        names: dict[bytes, int] = {}
        text = [names.setdefault(w, len(names)) for w in words[a:b]]
        ends: dict[tuple[int, int], int] = {}
        for i, e, size in squares(text):
            period = i - e
            if size + period >= least and size >= (times - 1) * period:
                ends[i - size - period, period] = i
        found += [(a + start, end - start, period) for (start, period), end in ends.items()]
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words, without those that a run holds after its first period."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist(), strict=True) if not d]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words; of one document in ten, by its id, from some word on a repetition of the words there. No id: unchanged."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def periodic_runs(docs: DataFrame, change=None) -> DataFrame:
    """``doc_id, runs array<struct<start, length, period>>, collapsed``: the runs of each text, and the text without their repetitions.

    A null, empty or wordless text has no runs and an empty collapsed text. Texts are taken whole, however long; rows
    are worked on each for itself, so repeated rows give repeated rows and a null doc_id stays null. Other columns are
    ignored; an empty table gives no rows. ``change(words, doc_id)`` may replace a text's words first.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                runs, kept = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    words = (text.as_py() or b"").split()  # bytes: blanks of ASCII only
                    words = change(words, doc_id) if change else words
                    found = find_runs(words)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                    kept.append(b" ".join(collapse(words, found) if found else words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digest_runs(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: first start, then period) and digests of all runs and of the collapsed text."""
    longest = F.get(F.array_sort(F.transform("runs", lambda x: F.struct((-x["length"]).alias("m"), x["start"].alias("start"), x["period"].alias("period")))), F.lit(0))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    best = found.withColumn("best", longest).withColumn("length", -F.col("best.m"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        "length",
        F.col("best.period").alias("period"),
        F.expr("(1000 * length) DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
