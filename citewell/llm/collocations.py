"""Phrase collocations: frequent word sequences ranked by how much their parts belong together.

1. Texts are gathered into shards of one language each, words as numbers of the shard's own vocabulary, and written.
2. Words that are frequent in their language get global numbers; in the shards all others only part pieces, as no
   candidate can hold them.
3. Each shard is indexed twice, read forwards and backwards, by the Burrows-Wheeler transform over word numbers. A
   phrase is an interval in both; extending it by a word on either side narrows one interval by the transform's rank
   function and the other by counting smaller words. So all n-grams up to the depth come out, each with its count.
4. Counts are summed over shards, one length after the other. A phrase is extended only if it may be frequent itself, by
   a bit map of fixed size over the hashes of all frequent phrases of that length. A full map lets more phrases through
   and loses none.
5. Cuts, scores and ranks are joins and windows on the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, mix

#: Bytes of text that make a shard, and that a task holds for all languages.
SHARD, HELD = 1_000_000, 4_000_000
#: Windows that rank a language's candidates before the last one.
SALTS = 64
#: Bits of a map of frequent phrases, as a power of two: 8 MB.
MAP_BITS = 26
PARTING = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
SHARDS = "lang string, n long, words array<string>, counts array<long>, ids binary"


def _shard(lang: str, texts: list[bytes]) -> tuple[str, int, pa.Array, pa.Array, bytes]:
    """Language, words, distinct words, their counts, and all places as numbers of distinct words (-1: a piece ends)."""
    flat = b"\n".join(texts).lower().translate(PARTING).replace(b"\n", b" \n ")
    coded = pa.array([b"\n", *filter(None, flat.split(b" "))], pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int32)
    counts = np.bincount(ids)[1:]
    return lang, int(counts.sum()), coded.dictionary[1:].cast(pa.string()), pa.array(counts.astype(np.int64)), (ids - 1).tobytes()


def shards(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """``lang, n, words, counts, ids``: the texts of each language in blocks; a text's pieces may go to several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def give(lang: str) -> pa.RecordBatch:
            one = _shard(lang, held.pop(lang))
            sizes.pop(lang)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in one[2:4]]
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([one[1]]), *lists, pa.array([one[4]], pa.binary())], names=["lang", "n", "words", "counts", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = text.as_py() or b""
                at = 0
                while at < len(whole):
                    end = len(whole)
                    if end - at > shard_bytes:  # cut a very long text where a piece ends
                        cuts = [c for x in (b"\n", b".", b",", b";", b":", b"!", b"?", b"\r") if (c := whole.find(x, at + shard_bytes)) >= 0]
                        end = min(cuts, default=end - 1) + 1
                    held.setdefault(lang, []).append(whole[at:end])
                    sizes[lang] = sizes.get(lang, 0) + end - at
                    at = end
                    if sizes[lang] >= shard_bytes:
                        yield give(lang)
                if sum(sizes.values()) >= HELD:
                    yield give(max(sizes, key=sizes.get))
        for lang in list(held):
            yield give(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, SHARDS).withColumn("shard", F.monotonically_increasing_id())


class Index:
    """The Burrows-Wheeler transform of a text that begins and ends with 0, sorted by the first ``depth`` symbols.

    Any phrase of at most ``depth`` symbols above 0 is an interval of its order, and the rank function is exact for it.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        n = self.n = len(text)
        rank = text.astype(np.int64)
        for step in range(1, depth):
            rank = np.unique(rank * symbols + np.roll(text, -step), return_inverse=True)[1]
        order = np.argsort(rank, kind="stable")
        self.before = text[order - 1]  # the symbol on the left of each place in the order
        by = np.argsort(self.before, kind="stable")
        self.places = self.before[by].astype(np.int64) * (n + 1) + by
        self.start = np.searchsorted(np.sort(text), np.arange(symbols + 1))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places of the order before ``at`` that have ``symbol`` on their left end up: its start and rank."""
        return np.searchsorted(self.places, symbol.astype(np.int64) * (self.n + 1) + at)


def extend(index: Index, lo: np.ndarray, hi: np.ndarray, other: np.ndarray, symbols: int) -> tuple[np.ndarray, ...]:
    """All extensions of phrases at ``[lo, hi)`` of ``index``, which begin at ``other`` in the index of the other direction.

    Gives the phrase extended, the symbol, and the new ``lo, hi, other``.
    """
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]
    code, count = np.unique(owner * symbols + index.before[at], return_counts=True)
    owner, symbol = code // symbols, code % symbols
    smaller = np.cumsum(count) - count
    smaller -= np.repeat(smaller[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])], np.bincount(owner)[np.unique(owner)]) if len(owner) else smaller
    real = symbol > 0
    owner, symbol, count, smaller = owner[real], symbol[real], count[real], smaller[real]
    new = index.step(symbol, lo[owner])
    return owner, symbol, new, new + count, other[owner] + smaller


def enumerate_ngrams(text: np.ndarray, symbols: int, longest: int, maybe: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 to ``longest`` words: a row of symbols per distinct n-gram without 0, and its count.

    ``text`` begins and ends with 0. Even lengths are reached by extending to the left, odd ones to the right. ``maybe``
    tells which phrases are worth to be extended; n-grams that hold one that isn't may be left out.
    """
    forward, backward = Index(text, symbols, longest), Index(text[::-1].copy(), symbols, longest)
    phrase = np.arange(1, symbols)[:, None]
    lo, hi, back = forward.start[1:-1], forward.start[2:], backward.start[1:-1]
    for n in range(2, longest + 1):
        if maybe and n > 2:
            good = maybe(phrase)
            phrase, lo, hi, back = phrase[good], lo[good], hi[good], back[good]
        if n % 2 == 0:
            owner, symbol, lo, hi, back = extend(forward, lo, hi, back, symbols)
            phrase = np.concatenate([symbol[:, None], phrase[owner]], axis=1)
            other = phrase[:, :-1]
        else:
            owner, symbol, b, e, lo = extend(backward, back, back + hi - lo, lo, symbols)
            phrase, hi, back = np.concatenate([phrase[owner], symbol[:, None]], axis=1), lo + e - b, b
            other = phrase[:, 1:]
        if maybe and n > 2:
            good = maybe(other)
            phrase, lo, hi, back = phrase[good], lo[good], hi[good], back[good]
        yield phrase, hi - lo


def _places(words: np.ndarray, map_bits: int) -> np.ndarray:
    """The place in a bit map of each row of word numbers."""
    h = np.zeros(len(words), np.uint64)
    for c in range(words.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, c].astype(np.uint64) + np.uint64(1))
    return h >> np.uint64(64 - map_bits)


def bit_map(grams: DataFrame, names: list[str], map_bits: int = MAP_BITS) -> np.ndarray:
    """A map of fixed size with the places of all rows of ``grams``; at most a row per 64 bits comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _places(np.stack([batch.column(c).to_numpy() for c in names], axis=1), map_bits)
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["slot", "bits"])

    found = grams.select(*names).mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (map_bits - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def ngram_counts(numbered: DataFrame, n: int, maps: dict, map_bits: int = MAP_BITS) -> DataFrame:
    """``w1 .. wn, a``: counts of sequences of n frequent words, summed over shards.

    ``numbered(ids, known array<struct<i, id>>)``: a shard's places, and the global numbers of its frequent words.
    ``maps``: length -> broadcast bit map of the frequent phrases.
    """
    names = [f"w{i + 1}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                known = batch.column(1)[at].values
                if known is None or not len(known):
                    continue
                i, word = (known.field(c).to_numpy(zero_copy_only=False) for c in ("i", "id"))
                ids = np.frombuffer(batch.column(0)[at].as_py(), np.int32)
                local = np.zeros(max(int(ids.max()), int(i.max())) + 2, np.int64)
                local[i] = np.arange(1, len(i) + 1)  # the last entry is what -1 finds: 0
                text = np.r_[0, local[ids], 0]
                text = text[np.r_[True, (text[1:] > 0) | (text[:-1] > 0)]]

                def maybe(phrase: np.ndarray, word=word) -> np.ndarray:
                    place = _places(word[phrase - 1], map_bits)
                    return (maps[phrase.shape[1]].value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0

                for phrase, count in enumerate_ngrams(text, len(i) + 1, n, maybe):
                    if phrase.shape[1] == n:
                        for cut in range(0, len(count), 50_000):
                            some = word[phrase[cut : cut + 50_000] - 1]
                            yield pa.RecordBatch.from_arrays([*(pa.array(some[:, c]) for c in range(n)), pa.array(count[cut : cut + 50_000])], names=[*names, "a"])

    found = numbered.select("ids", "known").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "a"]))
    return found.groupBy(*names).agg(F.sum("a").alias("a"))


def score(a: str, l: str, r: str):  # noqa: E741
    """floor(1000000 a a / (l r)), exact for counts below 10 to the power of 15."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * CAST({a} AS DECIMAL(15, 0)) * CAST({a} AS DECIMAL(15, 0))) DIV (CAST({l} AS DECIMAL(15, 0)) * CAST({r} AS DECIMAL(15, 0)))")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, percent: int = 50, top: int = 2000, shard_bytes: int = SHARD, map_bits: int = MAP_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    ``a`` counts a phrase within pieces (at least ``least``), ``l`` and ``r`` the parts of its lowest-scoring cut, ``n``
    all words. A candidate whose words lie in a longer candidate with at least ``percent`` of its count is dropped. A
    null language is ``und``; a null, empty or wordless text has no words; repeated rows count each; a text is taken
    whole, however long. Ties are ranked by count, then by the phrase's bytes. Other columns are ignored; an empty
    table gives no rows.
    """
    names = [f"w{i + 1}" for i in range(longest)]
    held = materialize(shards(docs, shard_bytes))
    total = held.groupBy("lang").agg(F.sum("n").alias("n"))
    words = held.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "x")).select("shard", "lang", "i", F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    frequent = words.groupBy("lang", "word").agg(F.sum("count").alias("f")).filter(F.col("f") >= least)
    frequent = materialize(frequent.withColumn("id", F.monotonically_increasing_id()))
    own = words.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("i", "id")).alias("known"))
    numbered = materialize(held.select("shard", "ids").join(own, "shard"))
    grams, maps = None, {}
    for n in range(2, longest + 1):
        same = materialize(ngram_counts(numbered, n, maps, map_bits).filter(F.col("a") >= least))
        if n < longest:
            maps[n] = docs.sparkSession.sparkContext.broadcast(bit_map(same, names[:n], map_bits))
        same = same.withColumns({c: F.lit(-1).cast("long") for c in names[n:]}).select(*names, "a")
        grams = same if grams is None else grams.unionByName(same)

    single = frequent.select(F.col("id").alias("w1"), F.col("f").alias("a"))
    counts = single.withColumns({c: F.lit(-1).cast("long") for c in names[1:]}).select(*names, "a").unionByName(grams)
    count_of = lambda to: counts.select(*(F.col(c).alias(f"_{c}") for c in names), F.col("a").alias(to))

    def look_up(rows: DataFrame, part: list[str], to: str) -> DataFrame:
        """The count of the words in the columns ``part``."""
        full = [F.col(part[i]) if i < len(part) else F.lit(-1) for i in range(longest)]
        other = count_of(to).filter(F.col(f"_{names[len(part) - 1]}") >= 0).filter(F.col(f"_w{len(part) + 1}") < 0 if len(part) < longest else F.lit(True))
        on = [full[i] == F.col(f"_{names[i]}") for i in range(len(part))]
        return rows.join(other, on).drop(*(f"_{c}" for c in names))

    scored = None
    for k in range(2, longest + 1):
        own = names[:k]
        rows = grams.filter(F.col(own[-1]) >= 0)
        rows = rows.filter(F.col(names[k]) < 0) if k < longest else rows
        best = []
        for cut in range(1, k):
            rows = look_up(look_up(rows, own[:cut], f"l{cut}"), own[cut:], f"r{cut}")
            best.append(F.struct(score("a", f"l{cut}", f"r{cut}").alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
        rows = rows.withColumn("best", F.least(*best) if len(best) > 1 else best[0]).select(*names, "a", "best.*").drop("cut")
        for longer in range(k + 1, longest + 1):
            wide = grams.filter(F.col(names[longer - 1]) >= 0)
            wide = wide.filter(F.col(names[longer]) < 0) if longer < longest else wide
            for at in range(longer - k + 1):
                inside = wide.groupBy(*(F.col(names[at + i]).alias(own[i]) for i in range(k))).agg(F.max("a").alias("longer"))
                rows = rows.join(inside, own, "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")
        scored = rows if scored is None else scored.unionByName(rows)

    named = scored
    for i, c in enumerate(names):
        known = frequent.select(F.col("id").alias(c), F.col("word").alias(f"word{i}"), *([F.col("lang")] if i == 0 else []))
        named = named.join(known, c, "inner" if i < 2 else "left")
    named = named.withColumn("phrase", F.concat_ws(" ", *(f"word{i}" for i in range(longest)))).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
