"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from citewell.llm import collocations
from citewell.llm.queries import ORACLES, QUERIES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, longest=3, percent=50, top=2000):
    out, langs = [], {}
    for lang, text in rows:
        langs.setdefault(lang or "und", []).append("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    for lang, texts in langs.items():
        f = Counter()
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                words = re.findall(r"[^\x20\x09]+", piece)
                f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        n = sum(v for k, v in f.items() if len(k) == 1)
        wanted = {k: a for k, a in f.items() if len(k) > 1 and a >= least}
        kept = []
        for k, a in wanted.items():
            if any(len(o) > len(k) and any(o[i : i + len(k)] == k for i in range(len(o))) and 100 * b >= percent * a for o, b in wanted.items()):
                continue
            cuts = [(10**6 * a * a // (f[k[:c]] * f[k[c:]]), c, f[k[:c]], f[k[c:]]) for c in range(1, len(k))]
            kept.append((min(cuts), " ".join(k), a))
        kept.sort(key=lambda x: (-x[0][0], -x[2], x[1].encode()))
        out += [(lang, i + 1, p, a, c[2], c[3], n, c[0]) for i, (c, p, a) in enumerate(kept[:top])]
    return sorted(out)


def made(seed, docs):
    rng = random.Random(seed)
    words = ["The", "of", "a", "Ñandú", "ñ", "x#", "\x1c", "straße", "b\x0bb", "co-op"]
    rows = []
    for _ in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ! ", "\r\n", "?"]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text, text, text, "", None])))
    return rows


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_intervals_give_the_counts_of_all_ngrams(longest):
    rng = np.random.default_rng(longest)
    for symbols in (2, 3, 9):
        text = np.r_[0, rng.integers(0, symbols, 400), 0]
        got = {}
        for phrase, count in collocations.enumerate_ngrams(text, symbols, longest):
            assert not set(map(tuple, phrase.tolist())) & set(got)
            got |= dict(zip(map(tuple, phrase.tolist()), count.tolist(), strict=True))
        want = Counter(t for k in range(2, longest + 1) for i in range(len(text) - k + 1) if 0 not in (t := tuple(text[i : i + k].tolist())))
        assert got == dict(want)


def test_a_full_map_loses_nothing(spark):
    rows = made(1, 150)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs, least=3, top=60, map_bits=7).collect())) == plain(rows, 3, top=60)


@pytest.mark.parametrize(("shard_bytes", "longest"), [(40, 3), (10**6, 2), (300, 4)])
def test_made_texts(spark, shard_bytes, longest):
    rows = made(shard_bytes, 250)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, word string").repartition(3)
    got = collocations.collocations(docs, least=4, longest=longest, percent=60, top=40, shard_bytes=shard_bytes)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, 4, longest, 60, 40)


def test_long_text_and_repeated_rows(spark):
    text = "Red fox; red fox! " * 20_000
    got = collocations.collocations(spark.createDataFrame([("en", text), ("en", text)], "lang string, text string"), shard_bytes=1000).collect()
    assert [tuple(r) for r in got] == [("en", 1, "red fox", 80_000, 80_000, 80_000, 160_000, 1_000_000)]


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame([("en", None), (None, ""), ("fr", " .\n")], "lang string, text string")
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0


def test_scores_past_64_bits(spark):
    a, l, r = 123_456_789_012_345, 987_654_321_098_765, 123_456_789_012_347  # noqa: E741
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s")).first()
    assert row.s == 10**6 * a * a // (l * r)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_phrase_collocations']})").fetchall()
    assert sorted(map(tuple, QUERIES["op12_phrase_collocations"](spark, sf).collect())) == sorted(want) and want
