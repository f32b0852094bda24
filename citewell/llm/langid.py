"""Language identification by Bayesian fusion of evidence.

The text gives likelihoods under models of its letters and letter trigrams, of any script, in hash buckets; the
declared markup language, the address suffix and the path's first segment give likelihoods estimated by grouped
aggregation; the host gives a prior that is smoothed towards its domain and that towards all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, mix

#: Hash buckets of letters and trigrams: one language's model is 1 MB.
GRAMS = 1 << 18
ADDED = 0.5
#: The n-grams of a text are not independent: their joint log likelihood counts this much, per text at most MOST_NATS.
TEMPER, MOST_NATS = 0.1, 40.0
#: Pseudo-rows that a domain's shares add to a host, and all rows' shares to a domain.
SMOOTHING = 20.0
HIDDEN = re.compile(r"<(?:(script|style)\b|(!--))", re.I)
ENDS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!--": re.compile("-->")}
EVIDENCE = ("declared", "suffix", "segment")


@lru_cache(1)
def _letters() -> np.ndarray:
    """code point -> itself if it is a letter, else 0"""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint64)


def _bucket(a, b, c, single) -> np.ndarray:
    key = (a << np.uint64(42)) | (b << np.uint64(21)) | c
    return (mix(key * np.uint64(2) + np.uint64(single)) >> np.uint64(64 - 18)).astype(np.int64)


def bucket(gram: tuple[int, ...]) -> int:
    """The bucket of a trigram of code points, or, with a fourth entry, of its last letter alone."""
    return int(_bucket(*np.array([gram[:3]], np.uint64).T, len(gram) > 3)[0])


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all trigrams of all texts (each between two non-letters) and then all single letters: the text's number and the bucket."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("  ".join(lower) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.r_[np.zeros(2, np.uint64), _letters()[codes]]
    none = np.zeros(1, np.uint64)
    of = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lower])
    return np.r_[of, of], np.r_[_bucket(letters[:-2], letters[1:-1], letters[2:], 0), _bucket(none, none, letters[2:], 1)]


def fit_text_models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log P(bucket), from all documents with a language; without any: no language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), 200):
                langs = np.array(batch.column("lang").slice(at, 200).to_pylist(), dtype=object)
                texts = batch.column("text").slice(at, 200).to_pylist()
                for lang in set(langs):
                    _, grams = ngrams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                    own = sums.setdefault(lang, np.zeros(GRAMS, dtype=np.int64))
                    own += np.bincount(grams, minlength=GRAMS)
        for lang, own in sorted(sums.items()):
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["lang", "gram", "n"])

    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counts.toArrow().to_pandas()  # at most GRAMS rows a language
    langs = sorted(table["lang"].unique())
    sums = np.full((len(langs), GRAMS), ADDED)
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        sums[i, own["gram"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


def visible_text(html: str) -> str:
    """What stands outside of tags, comments, scripts and styles; what is never closed counts as text. One pass."""
    out, at, ended = [], 0, set()  # ended: of this kind no more end follows
    while (i := html.find("<", at)) >= 0:
        out.append(html[at:i])
        hidden = HIDDEN.match(html, i)
        kind = (hidden[1] or hidden[2]).lower() if hidden else None
        end = -1
        if kind and kind not in ended:
            found = ENDS[kind].search(html, hidden.end())
            end = found.end() if found else -1
            if end < 0:
                ended.add(kind)
        if end < 0 and ">" not in ended:
            end = html.find(">", i) + 1 or -1
            if end < 0:
                ended.add(">")
        out.append(" " if end > 0 else "<")
        at = end if end > 0 else i + 1
    return "".join(out) + html[at:]


def _clean_tag(value):
    """A two- or three-letter primary language tag in lower case, else null."""
    tag = F.lower(F.regexp_extract(value, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(tag != "", tag)


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents have a source as host and neither markup nor address."""
    none = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("host"), F.lit("documents").alias("domain"), none.alias("declared"), none.alias("suffix"), none.alias("segment"), F.col("text").cast("string").alias("body"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages have a host and its domain (last two labels), the html element's language, the last label and the first path segment."""
    host = F.lower(F.regexp_extract("url", r"^[^:]*://([^/?#:]*)", 1))
    host = F.when(host != "", host)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    declared = _clean_tag(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][A-Za-z0-9_-]*)", 1))
    segment = _clean_tag(F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^/?#]*)", 1))
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), host.alias("host"), F.when(domain != "", domain).alias("domain"), declared.alias("declared"), F.when(suffix != "", suffix).alias("suffix"), segment.alias("segment"), F.col("html").cast("string").alias("body"))


def text_evidence(rows: DataFrame, langs: list[str], models: np.ndarray) -> DataFrame:
    """``rows`` with the tempered log likelihoods ``ll`` (per language, the best 0) in place of the body."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    kept = [c for c in rows.columns if c != "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                kinds = part.column("kind").to_pylist()
                texts = [visible_text(b or "") if k == "page" else b or "" for k, b in zip(kinds, part.column("body").to_pylist(), strict=True)]
                of, grams = ngrams(texts)
                sums = np.stack([np.bincount(of, weights=m[grams], minlength=len(texts)) for m in shared.value], axis=1) * TEMPER
                sums = np.maximum(sums - sums.max(axis=1, keepdims=True), -MOST_NATS)
                sums[[not t.strip() for t in texts]] = 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(langs), pa.int32()), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lists], names=[*kept, "ll"])

    schema = ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, ll array<double>")


def identify_languages(rows: DataFrame, langs: list[str], models: np.ndarray) -> DataFrame:
    """Per row ``kind, id, host, lang, posterior, text_lang``.

    Rows without any text have flat likelihoods and follow the other evidence; missing evidence counts as none; rows
    without a host take the domain's or the overall shares. A row's own reading is left out of its host's shares.
    Repeated rows count each. Without training texts in any language all rows have a null language and posterior.
    """
    if not langs:
        null = F.lit(None)
        return rows.select("kind", "id", "host", null.cast("string").alias("lang"), null.cast("double").alias("posterior"), null.cast("string").alias("text_lang"))
    sure = F.array_position("ll", F.lit(0.0)).cast("int")  # the best reading; with no text there is none
    scored = materialize(text_evidence(rows, langs, models).withColumn("best", F.when(F.exists("ll", lambda x: x < 0), sure)))
    n = len(langs)
    shares = [F.count_if(F.col("best") == i + 1).alias(f"n{i}") for i in range(n)]

    def counts(*keys: str) -> DataFrame:
        return materialize(scored.filter(F.col("best").isNotNull()).groupBy(*keys).agg(*shares).select(*keys, F.array(*(F.col(f"n{i}").cast("double") for i in range(n))).alias("of_" + "_".join(keys))))

    overall = [float(x or 0) for x in scored.agg(*shares).first()]
    whole = F.array(*(F.lit((x + 1) / (sum(overall) + n)) for x in overall))
    out = scored.join(counts("domain"), "domain", "left").join(counts("host", "domain").withColumnRenamed("of_host_domain", "of_host"), ["host", "domain"], "left")
    for key in EVIDENCE:
        out = out.join(counts(key), key, "left")
    zero = F.array(*(F.lit(0.0) for _ in langs))
    itself = F.array(*(F.when(F.col("best") == i + 1, 1.0).otherwise(0.0) for i in range(n)))
    less = lambda column: F.zip_with(F.coalesce(column, zero), itself, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("d", less(F.col("of_domain"))).withColumn("h", less(F.col("of_host")))
    smooth = lambda own, prior: F.zip_with(own, prior, lambda a, p: (a + SMOOTHING * p) / (total(own) + SMOOTHING))
    out = out.withColumn("d", smooth(F.col("d"), whole)).withColumn("h", smooth(F.col("h"), F.col("d")))
    log_post = F.zip_with("ll", "h", lambda a, b: a + F.log(b))
    everything = F.array(*(F.lit(x + 1.0) for x in overall))
    for key in EVIDENCE:
        # P(value | language), up to a factor that all languages share; a value never seen says nothing
        own = F.zip_with(less(F.col(f"of_{key}")), everything, lambda a, b: (a + 0.5) / b)
        log_post = F.when(F.col(f"of_{key}").isNull(), log_post).otherwise(F.zip_with(log_post, own, lambda a, b: a + F.log(b)))
        out = out.withColumn("lp", log_post)
        log_post = F.col("lp")
    top = F.array_max("lp")
    best = F.array_position("lp", top).cast("int")
    names = F.array(*(F.lit(x) for x in langs))
    weights = F.transform("lp", lambda x: F.exp(x - top))
    return out.select("kind", "id", "host", F.element_at(names, best).alias("lang"), (1.0 / total(weights)).alias("posterior"), F.when(F.col("best").isNotNull(), F.element_at(names, F.col("best"))).alias("text_lang"))
