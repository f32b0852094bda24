"""Host-level quality rules: document rule failures, shrunk host rates, and the hosts' verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialize, rolling, word_hashes

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: A host fails at more than these times the prior's odds of failing.
MOST_ODDS = 4.0
#: Documents that are worked on together; bounds a task's memory, changes no result.
CHUNK_BYTES = 4 << 20


def repeated_words(words: list[list[bytes]], window: int) -> np.ndarray:
    """Per text the words that lie in windows found twice or more in the same text."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    total = int(sizes.sum())
    if total < window:
        return np.zeros(len(words), dtype=np.int64)
    text_of = np.repeat(np.arange(len(words)), sizes)
    hashes = rolling(word_hashes([x for w in words for x in w]), window)
    inside = text_of[: len(hashes)] == text_of[window - 1 :]
    hashes = hashes + text_of[: len(hashes)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # windows of one text only
    at = np.flatnonzero(inside)
    _, group, count = np.unique(hashes[at], return_inverse=True, return_counts=True)
    starts = at[count[group] > 1]
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(text_of[covered], minlength=len(words))


def text_stats(texts: list[str]) -> dict[str, list[int]]:
    """The rule inputs of each text."""
    words = [t.encode().split() for t in texts]
    out: dict[str, list[int]] = {k: [] for k in STATS}
    for text, w in zip(texts, words, strict=True):
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        out["n_words"].append(len(w))
        out["word_chars"].append(len(text) - sum(map(text.count, SPACES)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    out["n_repeat_words"] = repeated_words(words, WINDOW).tolist()
    return out


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", carry: str | None = None) -> DataFrame:
    """One row per document: id, host, STATS and ``base_failed``; a null text has no words.

    ``carry`` names a struct of ``docs`` that holds the text and is passed through.
    """
    more = [carry] if carry else []
    names = ("doc_id", "host", *more, *STATS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.cumsum(batch.column(2).nbytes // max(1, len(batch)) * np.ones(len(batch)))
            while at < len(batch):
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES)))
                part = batch.slice(at, upto - at)
                texts = pc.struct_field(part.column(2), text_col) if carry else part.column(2)
                stats = text_stats([x or "" for x in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *([part.column(2)] if carry else []), *(pa.array(stats[k], pa.int64()) for k in STATS)], names=names)
                at = upto

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(carry) if carry else F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField(k, T.LongType()) for k in STATS])
    stats = rows.mapInArrow(measure, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", failed)


def host_verdicts(stats: DataFrame, most_odds: float = MOST_ODDS) -> DataFrame:
    """Per host ``n, failed, rate, host_failed``: the failure rate under a beta prior fitted to all hosts by moments.

    The prior's mean is the hosts' mean rate and its strength follows from their variance beyond what draws of that
    size would show, held between 1 and 1000 pseudo-documents. A host fails if its rate is high beyond doubt: the odds
    of failing at its posterior mean less two posterior standard deviations are more than ``most_odds`` times those at
    the prior's mean. The limit thus follows the corpus, at any rate of failures. One host, or hosts without variance,
    give the strongest prior, under which only hosts of some hundred failures can fail.
    """
    hosts = stats.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    hosts = materialize(hosts)
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("inv"))
    m, v = F.col("mean"), F.col("var")
    noise = m * (1 - m) * F.col("inv")
    strength = F.when(v > noise, F.least(F.greatest((m * (1 - m)) / (v - noise) - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)
    prior = prior.select(F.coalesce(m, F.lit(0.0)).alias("mean"), F.coalesce(strength, F.lit(1000.0)).alias("strength"))
    shrunk = hosts.crossJoin(F.broadcast(prior))  # one row
    size = F.col("n") + F.col("strength")
    shrunk = shrunk.withColumn("rate", (F.col("failed") + F.col("mean") * F.col("strength")) / size)
    low = F.col("rate") - 2 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (size + 1))
    return shrunk.select("host", "n", "failed", "rate", (low * (1 - m) > most_odds * m * (1 - low)).alias("host_failed"))


def judged(stats: DataFrame, hosts: DataFrame) -> DataFrame:
    """``stats`` with ``host_rate`` and ``kept``, whatever its other columns."""
    joined = stats.join(hosts, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).drop("host_failed")


def quality_rules(docs: DataFrame, most_odds: float = MOST_ODDS, host_col: str = "source") -> DataFrame:
    """Judge every document: ``doc_id``, STATS, ``base_failed, host_rate, kept``.

    A document is kept if it passes its own rules and its host does not fail (see ``host_verdicts``). A null host has
    no verdict: its documents count by their own rules (``host_rate`` null). Null or empty texts fail. Repeated rows
    count each; other columns are ignored; an empty table gives no rows.
    """
    stats = materialize(document_stats(docs, host_col=host_col))
    hosts = materialize(host_verdicts(stats, most_odds).select("host", F.col("rate").alias("host_rate"), "host_failed"))
    return judged(stats, hosts).select("doc_id", *STATS, "base_failed", "host_rate", "kept")


def drop_low_quality(docs: DataFrame, most_odds: float = MOST_ODDS, host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Each row is judged for itself and carried through, not looked up by its id, so that null and repeated ids don't
    matter. Rows that fail by themselves are only counted for their host.
    """
    row = F.struct(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns))
    carried = materialize(document_stats(docs.withColumn("_citewell_row", row), host_col=host_col, carry="_citewell_row"))
    hosts = materialize(host_verdicts(carried, most_odds).select("host", F.col("rate").alias("host_rate"), "host_failed"))
    return judged(carried.filter("NOT base_failed"), hosts).filter("kept").select("_citewell_row.*")
