"""Phrase matching with cited evidence: spans of a vocabulary in texts, leftmost and longest; and contact facts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.text import BLANK, fold, lines, missing, strip, tokens, words
from ..sources.documents import scratch, settled
from . import trie
from .vocabulary import MAX_PHRASE_TOKENS

#: Phrases of a trie that is built on the driver and held by each worker (about 200 bytes each); of a larger vocabulary each
#: part of the texts has a trie of its own.
TRIE_PHRASES = 100_000
#: Tokens of texts that are looked up together.
BATCH_TOKENS = 1_000_000
#: A part of the texts ends with so many tokens, or so many spans that may be phrases.
PART_TOKENS, PART_PHRASES = 4_000_000, 500_000
#: Bits that a phrase of a larger vocabulary has in the map of its phrases, and the map's largest size as a power of two.
PHRASE_BITS, MAP_BITS = 16, 27
#: Bits of the hash by which a part asks for phrases, and answers that a task packs at once.
HASH_BITS, PACKED = 40, 1_000_000
#: What a name looks like, and how an e-mail address is found.
NAME = r"^[A-Za-z][A-Za-z .'-]{1,80}\z"
EMAIL = r"(?iu)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"


def _tokens(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, tokens(F.col("text")).alias("_tokens")).withColumn("_size", F.size("_tokens"))


def _each(rows: DataFrame, keys: list[str], array: Column | str) -> DataFrame:
    """``keys, x``: one row per entry.

    Plain ``explode`` makes Spark infer a filter on the array's size and push it below the tokens; these would then be
    computed anew for each entry of each array that is built from them. The outer form has no such filter.
    """
    return rows.select(*keys, F.explode_outer(array).alias("x")).filter("x IS NOT NULL")


def ngrams(texts: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """``keys, p, n, span``: all token spans of 1 to ``longest`` tokens."""
    every = F.when(F.col("_size") > 0, F.sequence(F.lit(0), F.col("_size") - 1)).otherwise(F.array().cast("array<int>"))
    sizes = lambda p: F.sequence(F.lit(1), F.least(F.lit(longest), F.col("_size") - p))
    span = lambda p, n: F.struct(p.alias("p"), n.alias("n"), F.array_join(F.slice("_tokens", p + 1, n), " ").alias("span"))
    spans = F.flatten(F.transform(every, lambda p: F.transform(sizes(p), lambda n: span(p, n))))
    return _each(_tokens(texts, keys), keys, spans).select(*keys, "x.p", "x.n", "x.span")


def ngram_counts(texts: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """``keys, n, spans, distinct_spans``: how many token spans of each size a key's texts have, and how many different ones.

    A key of one text is counted in its row, without a row per span. Only texts whose keys repeat (a null key is a key
    like any other) have their spans dealt out and met, each text's different spans once.
    """
    again = settled(texts.groupBy(*keys).agg(F.count("*").alias("_texts")).filter("_texts > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    span = lambda n: F.transform(F.slice("_tokens", 1, F.col("_size") - n + 1), lambda t, i: F.concat_ws(" ", t, *(F.get("_tokens", i + j) for j in range(1, n))))
    different = lambda n: F.array_distinct(span(n) if n > 1 else F.col("_tokens"))

    def per_text(rows: DataFrame, name: str, made) -> DataFrame:
        sizes = F.array(*(F.when(F.col("_size") >= n, F.struct(F.lit(n).alias("n"), (F.col("_size") - n + 1).cast("long").alias("spans"), made(n).alias(name))) for n in range(1, longest + 1)))
        return _each(_tokens(rows, keys), keys, sizes).select(*keys, "x.*")

    alone = per_text(texts.join(again, same, "left_anti"), "distinct_spans", lambda n: F.size(different(n)).cast("long"))
    if again.isEmpty():
        return alone
    met = per_text(texts.join(again, same, "left_semi"), "found", different)
    spans = met.groupBy(*keys, "n").agg(F.sum("spans").alias("spans"))
    found = met.select(*keys, "n", F.explode("found").alias("span")).distinct().groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.col("n").alias("_n")).agg(F.count("*").alias("distinct_spans"))
    both = spans.join(found, same & (F.col("n") == F.col("_n"))).select(*keys, "n", "spans", "distinct_spans")
    return alone.unionByName(both)


def _few_tokens(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``most`` tokens at most, by the lists in ``_tokens``; a longer text is one of its own."""
    ends = np.cumsum(_sizes(batch))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _whole(rows: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays([pa.array([], rows.schema.field(name).type), *rows.column(name).chunks])


def _left(sizes: np.ndarray) -> np.ndarray:
    """Each token's number of tokens up to the end of its text, itself included."""
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())


def _spans(known: trie.Trie, batch: pa.RecordBatch, keys: list[str], resolve: bool) -> pa.RecordBatch:
    """``keys, p, n, span, canonical`` of one batch of ``keys, _tokens``."""
    sizes = _sizes(batch)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    place, n, phrase = known.matches(known.numbers(batch.column("_tokens").flatten()), _left(sizes))
    order = np.lexsort((-n, place))
    if resolve:  # the longest at each place, then a scan from the left
        first = order[np.r_[True, place[order[1:]] != place[order[:-1]]]] if len(order) else order
        order = first[trie.first_to_last(place[first], n[first])]
        order = order[known.canonical.is_valid().to_numpy(zero_copy_only=False)[phrase[order]]]
    place, n, phrase = place[order], n[order], pa.array(phrase[order])
    found = [pa.array(place - starts[row[place]], pa.int32()), pa.array(n, pa.int32()), known.phrases.take(phrase), known.canonical.take(phrase)]
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row[place])) for k in keys), *found], names=[*keys, "p", "n", "span", "canonical"])


def _hashed(known: DataFrame, longest: int) -> DataFrame:
    """``known`` with each phrase's hash ``_h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_h", pa.array(trie.phrase_hashes(batch.column("phrase"), longest).view(np.int64)))

    return settled(known.select("phrase", "canonical").mapInArrow(run, "phrase string, canonical string, _h long"))


def _phrase_map(known: DataFrame, bits: int) -> np.ndarray:
    """A map of 2^``bits`` bits with the places of all hashes; at most a row per 64 bits comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(trie.hash_places(batch.column("_h").to_numpy().view(np.uint64), bits))
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["slot", "bits"])

    found = known.select("_h").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of about ``most`` rows ``_of, phrase, canonical`` at a time, one compressed row for each ``_of``."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by([("_of", "ascending"), ("phrase", "ascending")])
        of, first = np.unique(rows.column("_of").to_numpy(), return_index=True)
        out = []
        for at, end in zip(first, [*first[1:], len(rows)], strict=True):
            sink = pa.BufferOutputStream()
            own = rows.select(["phrase", "canonical"]).slice(at, end - at).combine_chunks()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(own)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(out, pa.binary())], names=["_of", "_phrases"])

    held, size = [], 0
    for batch in batches:
        held, size = [*held, batch], size + len(batch)
        if size >= most:
            yield packed(held)
            held, size = [], 0
    if size:
        yield packed(held)


def _matched(texts: DataFrame, keys: list[str], phrases: DataFrame, resolve: bool, trie_phrases: int | None) -> DataFrame:
    """``keys, p, n, span, canonical`` of all candidates, or of those that a scan takes; ``keys`` may repeat or be null.

    Up to ``trie_phrases`` phrases each text is worked on where it is, without a shuffle.
    """
    columns = StructType([*texts.select(*keys).schema.fields, *StructType.fromDDL("p int, n int, span string, canonical string").fields])
    spark, phrases = texts.sparkSession, settled(phrases)
    size = phrases.agg(F.max("max_tokens").alias("longest"), F.count("*").alias("n")).first()
    if size["longest"] is None:
        return spark.createDataFrame([], columns)
    longest = min(size["longest"], MAX_PHRASE_TOKENS)
    known = phrases.filter("phrase IS NOT NULL").groupBy("phrase").agg(F.max("canonical").alias("canonical"))
    if size["n"] > (trie_phrases or TRIE_PHRASES):
        return _matched_in_parts(texts, keys, known, size["n"], longest, resolve, columns)
    rows = known.toArrow()
    shared = spark.sparkContext.broadcast(trie.build(_whole(rows, "phrase"), _whole(rows, "canonical"), longest))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in _few_tokens(batch, BATCH_TOKENS):
                yield _spans(shared.value, few, keys, resolve)

    return texts.select(*keys, tokens(F.col("text")).alias("_tokens")).mapInArrow(look_up, columns)


def _matched_in_parts(texts: DataFrame, keys: list[str], known: DataFrame, n: int, longest: int, resolve: bool, columns: StructType) -> DataFrame:
    """``_matched`` for a vocabulary of any size: texts are never shuffled, only what each part of them asks for is.

    Texts are written once, in buckets by their part, with hashes of the different spans of each part that a map of fixed
    size allows. Map and hashes only save work: all phrases of a hash come back, and each part's texts, read bucket by
    bucket, meet a trie of the phrases that came.
    """
    spark, bits = texts.sparkSession, min(MAP_BITS, max(6, (n * PHRASE_BITS).bit_length()))
    known = _hashed(known, longest)
    shared, cut = spark.sparkContext.broadcast(_phrase_map(known, bits)), 64 - HASH_BITS
    kept = StructType()
    for field in texts.select(*keys).schema.fields:
        kept.add(field.name, field.dataType)
    kept.add("_part", "long").add("_words", "string").add("_asked", "long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, asked = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64)
        for batch in batches:
            batch = batch.filter(pc.greater(pc.binary_length(batch.column("_words")), 0))
            for few in _few_tokens(batch.append_column("_tokens", pc.split_pattern(batch.column("_words"), " ")), BATCH_TOKENS):
                sizes = _sizes(few)
                hashes = trie.hashes_in_map(few.column("_tokens").flatten(), _left(sizes), longest, shared.value, bits)
                new = np.setdiff1d((hashes >> np.uint64(cut)).astype(np.int64), asked)
                part = lambda rows: pa.array(np.full(rows, number))
                yield pa.RecordBatch.from_arrays([*(few.column(k) for k in keys), part(len(few)), few.column("_words"), pa.nulls(len(few), pa.int64())], names=kept.names)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(new), few.column(k).type) for k in keys), part(len(new)), pa.nulls(len(new), pa.string()), pa.array(new)], names=kept.names)
                size, asked = size + int(sizes.sum()), np.concatenate([asked, new])
                if size >= PART_TOKENS or len(asked) >= PART_PHRASES:
                    number, size, asked = number + 1, 0, asked[:0]

    def look_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        answers = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in found.column("_phrases")]
        own = trie.build(*(pa.concat_arrays([pa.array([], pa.string()), *(_whole(x, c) for x in answers)]) for c in ("phrase", "canonical")), longest)
        batch = pa.RecordBatch.from_arrays([*(_whole(rows, k) for k in keys), pc.split_pattern(_whole(rows, "_words"), " ")], names=[*keys, "_tokens"])
        return pa.Table.from_batches([_spans(own, few, keys, resolve) for few in _few_tokens(batch, BATCH_TOKENS)])

    dealt = texts.select(*keys, F.array_join(tokens(F.col("text")), " ").alias("_words")).mapInArrow(deal, kept)
    name, buckets = f"parts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt.write.bucketBy(buckets, "_part").option("compression", "zstd").option("path", scratch(spark, "parts")).saveAsTable(name)
    parts = spark.table(name)
    asked = parts.filter("_asked IS NOT NULL").select(F.col("_part").alias("_of"), "_asked")
    found = asked.join(known, F.col("_asked") == F.shiftrightunsigned("_h", cut)).select("_of", "phrase", "canonical").mapInArrow(lambda batches: _pack(batches, PACKED), "_of long, _phrases binary")
    rows = parts.filter("_words IS NOT NULL").select(*keys, "_part", "_words")
    return rows.groupBy("_part").cogroup(found.groupBy("_of")).applyInArrow(look_up, columns)


def dictionary_candidates(texts: DataFrame, keys: list[str], phrases: DataFrame, trie_phrases: int | None = None) -> DataFrame:
    """``keys, p, n, span, canonical``: spans of tokens that are phrases or absorbers (null canonical).

    A trie of tokens is walked from every place whose token begins a phrase: the vocabulary's, or if it is large that of
    the phrases that a part of the texts holds. Of a repeated phrase the greatest canonical name counts. A null text has
    no tokens.
    """
    return _matched(texts, keys, phrases, False, trie_phrases)


def leftmost_longest(texts: DataFrame, keys: list[str], phrases: DataFrame, trie_phrases: int | None = None) -> DataFrame:
    """``keys, p, n, span, canonical``: the spans that a scan from the left takes, longest first, absorbed ones dropped."""
    return _matched(texts, keys, phrases, True, trie_phrases)


def matched_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, canonical, phrases``: distinct matched phrases in order of first sight."""
    first = spans.groupBy(*keys, "canonical", "span").agg(F.min("p").alias("p"))
    return first.groupBy(*keys, "canonical").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "span"))), lambda x: x["span"]).alias("phrases"))


def mentioned_set(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, canonical``: each name once."""
    return spans.select(*keys, "canonical").distinct()


def skill_evidence(spans: DataFrame) -> DataFrame:
    """``doc_id, canonical, evidence``: the distinct blocks of each name in block order; needs ``block_pos, block_id``."""
    cited = spans.select("doc_id", "canonical", "block_pos", "block_id").distinct()
    return cited.groupBy("doc_id", "canonical").agg(F.transform(F.sort_array(F.collect_list(F.struct("block_pos", "block_id"))), lambda x: x["block_id"]).alias("evidence"))


def text_lines(texts: Column) -> Column:
    """Stripped non-empty lines of an array of block texts."""
    return F.filter(F.transform(F.flatten(F.transform(texts, lines)), strip), lambda x: x != "")


def contact_email(found: Column) -> Column:
    return missing(F.regexp_extract(F.array_join(found, "\n"), EMAIL, 0))


def contact_name(found: Column) -> Column:
    """The first line if it has two to five words of ASCII letters and name marks, all with a capital first."""
    first = F.get(found, F.lit(0))
    parts = words(first)
    fits = F.size(parts).between(2, 5) & first.rlike(NAME) & F.forall(parts, lambda w: w.rlike("^[A-Z]"))
    return F.when(fits, first)


def contact_location(found: Column) -> Column:
    """What follows the label in the first of twelve lines that has it; only one spelling of the label is taken off."""
    hits = F.filter(F.slice(found, 1, 12), lambda x: F.startswith(fold(x), F.lit("location:")))
    line = F.get(hits, F.lit(0))
    return strip(F.when(F.startswith(line, F.lit("Location:")), F.substring(line, F.lit(10), F.char_length(line))).otherwise(line))


def contact_facts(docs: DataFrame) -> DataFrame:
    """``doc_id, blocks array<struct<id, text>>`` -> ``doc_id, contact``."""
    rows = docs.select("doc_id", text_lines(F.transform("blocks", lambda b: b["text"])).alias("found"))
    found = F.col("found")
    return rows.select("doc_id", F.struct(contact_name(found).alias("name"), contact_email(found).alias("email"), contact_location(found).alias("location")).alias("contact"))


def normalise_facts(docs: DataFrame, evidence: DataFrame, categories: DataFrame) -> DataFrame:
    """``doc_id, contact, skills``: skills sorted by folded name, with category and cited blocks."""
    with_category = evidence.withColumn("key", fold(F.col("canonical"))).join(categories.select("key", "category"), "key", "left")
    skill = F.struct("key", F.struct(F.col("canonical").alias("canonicalName"), "category", F.col("evidence").alias("evidenceBlockIds")).alias("skill"))
    skills = with_category.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(skill), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda x: x["skill"]).alias("skills"))
    none = F.array().cast("array<struct<canonicalName:string,category:string,evidenceBlockIds:array<string>>>")
    return contact_facts(docs).join(skills, "doc_id", "left").withColumn("skills", F.coalesce("skills", none))


def labelled_document(blocks: Column) -> Column:
    """``[id]`` and text of each block that isn't blank, a blank line between."""
    shown = F.filter(blocks, lambda b: F.regexp_replace(b["text"], BLANK, "") != "")
    return F.array_join(F.transform(shown, lambda b: F.concat(F.lit("["), b["id"], F.lit("]\n"), b["text"])), "\n\n")


def quote_verify(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """``citations(doc_id, block_id, quote)`` with ``verified``: the cited block holds the quote."""
    found = blocks.select("doc_id", "block_id", "text")
    return citations.join(found, ["doc_id", "block_id"], "left").withColumn("verified", F.coalesce(F.contains("text", F.col("quote")), F.lit(False))).drop("text")
