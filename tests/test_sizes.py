"""What keeps a job in proportion to its input: one test per kind of growth."""

import io
import random
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from citewell.functions import text
from citewell.operators import admission, integrity, matching, ranking, search, vocabulary
from citewell.plans import QUERIES, facts
from citewell.sources import documents as source


def test_documents_share_files(spark, tmp_path):
    rows = spark.range(300).coalesce(2).select(F.concat("id", F.lit(".txt")).alias("path"), F.when(F.col("id") > 0, F.repeat(F.lit("é"), F.col("id").cast("int"))).cast("binary").alias("content"))
    source.store_documents(rows, str(tmp_path / "store"))
    assert len(list(Path(tmp_path / "store").glob("*.parquet"))) <= 2
    found = {r.path: (r.length, None if r.content is None else bytes(r.content).decode()) for r in source.scan_store(spark, str(tmp_path / "store")).collect()}
    assert found == {f"{i}.txt": (2 * i, "é" * i) if i else (None, None) for i in range(300)}


def test_a_null_text_is_scanned_as_null(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (-2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.length, r.content_md5 is None) for r in facts.s1_scan_documents(spark, str(tmp_path)).collect()}
    assert got == {1: (4, False), -2: (None, True), 3: (1, False)}


def test_long_needles_meet_few_rows(spark):
    """Every needle's grams lie in few rows, however many rows share its short grams."""
    rows = spark.range(10_000).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("@x")).alias("text"))
    index = search.gram_index(rows, "k", "text")
    needles = spark.range(0, 10_000, 7).select(F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("@")).alias("needle"))
    plan = search.search(index, rows, "k", "text", needles)
    assert sorted(tuple(r) for r in plan.collect()) == sorted((f"{i:08d}@", i) for i in range(0, 10_000, 7))
    grams = needles.select("needle", F.explode(F.array(F.left("needle", F.lit(8)), F.right("needle", F.lit(8)))).alias("gram"))
    assert 10_000 * 11 > grams.join(index, "gram").count() > 0


def test_a_window_lies_in_few_bins(spark):
    events = spark.createDataFrame([(1, 7, "1993-05-01 10:30:00"), (2, 7, "1969-12-31 23:30:00"), (3, 7, None)], "e long, job_id long, t string").withColumn("at", F.to_timestamp("t"))
    windows = spark.range(40_000).select(F.lit(7).cast("long").alias("job_id"), F.col("id").alias("w"), F.timestamp_seconds(F.lit(735_000_000) + F.col("id")).alias("opens"), F.timestamp_seconds(F.lit(735_000_000) + F.col("id") * 2001).alias("closes"))
    joined = admission.interval_join(events, windows, "job_id")
    want = events.crossJoin(windows.drop("job_id")).filter("opens <= at AND at < closes").select("e", "w")
    assert sorted(map(tuple, joined.select("e", "w").collect())) == sorted(map(tuple, want.collect()))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(sequence") == 1  # one stretch of bins a window, on one level


def test_codes_are_looked_up_without_a_broadcast(spark):
    rows = spark.range(100).select(F.col("id").alias("ask_id"), F.concat(F.lit("c"), "id").alias("code"))
    known = spark.range(100).select(F.col("id").alias("invitation_id"), F.sha2(F.concat(F.lit("c"), "id"), 256).alias("token_hash"), F.sha2(F.concat(F.lit("x"), "id"), 256).alias("passcode_hash")).filter("id % 2 = 0")
    found = integrity.invitation_lookup(rows, known)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.ask_id: r.invitation_id for r in found.collect()} == {i: i if i % 2 == 0 else None for i in range(100)}


def test_rows_without_a_report_are_not_gathered(spark):
    rows = spark.range(100).select(F.col("id").alias("processing_id"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("report_id"), F.when(F.col("id") != 5, F.col("id") % 4).alias("submission_id"))
    reports, owners = spark.range(50).select(F.col("id").alias("report_id"), (F.col("id") + 1).alias("user_id")).hint("merge"), spark.range(3).select(F.col("id").alias("submission_id"), F.col("id").alias("org_id"))
    found = ranking.job_status(rows, reports, owners)
    want = {i: f"user:{i + 1}" if i % 3 == 0 and i < 50 else f"org:{i % 4}" if i % 4 < 3 and i != 5 else None for i in range(100)}
    assert {r.processing_id: r.owner for r in found.collect()} == want and found.count() == 100
    assert found._jdf.queryExecution().analyzed().toString().count("Union") == 3  # one for each key, and those without a report in the second


def test_blanks_are_trimmed_without_a_pattern(spark):
    values = ["".join(map(chr, range(0x3001))) + " x", "　a b ", "\x1c\x85", "", None, " ​ "]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in rows.select(text.strip(F.col("v"))).collect()] == [None if v is None else v.strip() for v in values]
    assert all(chr(c).isspace() == (chr(c) in text.BLANKS) for c in range(0x11000))
    assert "regexp" not in rows.select(text.strip(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()


def test_ngrams_are_counted_in_the_row(spark):
    values = [(1, "a b a b c"), (2, "a"), (3, ""), (4, None), (None, "x y x"), (None, "x y z"), (7, "a b"), (7, "a b a b"), (8, "a b c a b c a b c")]
    rows = spark.createDataFrame(values, "doc_id long, text string")
    want = matching.ngrams(rows, ["doc_id"], 3).groupBy("doc_id", "n").agg(F.count("*").alias("spans"), F.countDistinct("span").alias("distinct_spans"))
    order = lambda df: sorted(map(str, df.select("doc_id", "n", "spans", "distinct_spans").collect()))
    assert order(matching.ngram_counts(rows, ["doc_id"], 3)) == order(want)
    alone = matching.ngram_counts(rows.filter("doc_id < 5"), ["doc_id"], 3)
    assert "Exchange hashpartitioning" not in alone._jdf.queryExecution().executedPlan().toString() and alone.count() == 4


def test_archives_share_batches_and_large_ones_do_not(spark, monkeypatch):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(3):
            z.writestr(f"{i}.txt", bytes([65 + i]) * 3_000_000)
    rows = spark.createDataFrame([(str(i), data.getvalue() if i == 7 else b"x") for i in range(500)], "archive_id string, content binary").coalesce(1)
    found = source.archive_entries(rows)
    assert sorted((r.archive_id, r.n) for r in found.groupBy("archive_id").agg(F.count("*").alias("n")).collect()) == sorted((str(i), 3 if i == 7 else 1) for i in range(500))
    assert {r.entry_name: bytes(r.content) for r in found.filter("entry_name IS NOT NULL").collect()} == {f"{i}.txt": bytes([65 + i]) * 3_000_000 for i in range(3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan  # a batch of its own per archive took most of the time


def test_docx_files_are_read_a_few_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["doc_id"])
    assert [len(x) for x in source.few_files([batch])] == [64] * 15 + [40]


def test_a_vocabulary_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    names = spark.range(30).coalesce(1).select(F.concat(F.lit("w"), "id").alias("alias")).mapInArrow(count, "alias string")
    known = vocabulary.phrase_table(names.withColumn("canonical", F.upper("alias")), spark.createDataFrame([], "phrase string"))
    shared = matching.settled(known)
    once, seen.value = seen.value, 0
    found = matching.leftmost_longest(spark.createDataFrame([(1, "w1 w29 x")], "k int, text string"), ["k"], known, trie_phrases=10)
    assert sorted(r.canonical for r in found.collect()) == ["W1", "W29"] and shared.count() == 30
    assert seen.value == once > 0


def test_merges_work_out_their_parts_once(spark):
    plan = QUERIES["p7_corrected_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "parse_json" not in plan.lower()  # matching and validation are read, not repeated
    for name in ("j7_merge_skills", "j9_merge_facts", "p1_readiness_score"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and ("parse_json" not in plan.lower() or name == "j7_merge_skills")


def test_plain_texts_are_folded_without_a_pattern(spark):
    values = ["ABC ß", "ABC", "ﬃx", "É", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in rows.select(text.fold(F.col("v"))).collect()] == ["abc ss", "abc", "ffix", "é", "", None]


def _vocabulary(spark, n, longest=6):
    """``n`` phrases of up to ``longest`` of eight tokens; every third one is an absorber."""
    rng = random.Random(n)
    names = {" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, longest))) for _ in range(n)}
    rows = [(p, None if i % 3 == 0 else p.upper(), longest) for i, p in enumerate(sorted(names))]
    return spark.createDataFrame(rows, "phrase string, canonical string, max_tokens int")


def test_what_a_large_vocabulary_moves_does_not_grow_with_its_tries(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "d e f g h")], "k int, text string")
    plans = [matching.leftmost_longest(texts, ["k"], _vocabulary(spark, n), trie_phrases=4)._jdf.queryExecution().executedPlan().toString() for n in (12, 60)]
    assert plans[0].count("Exchange ") == plans[1].count("Exchange ") and plans[0].count("MapInArrow") == plans[1].count("MapInArrow")
    assert not any("RoundRobinPartitioning" in p for p in plans)  # each trie had all tokens dealt anew
    assert all("Bucketed: true" in p for p in plans)  # texts are read where they were written


def test_parts_of_texts_find_what_one_trie_finds(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2]), i % 7, " ".join(rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    texts = spark.createDataFrame([*rows, (3, None, None), (None, None, "A b--c.D")], "k int, j int, text string").repartition(3)
    known = _vocabulary(spark, 300)
    for job in (matching.leftmost_longest, matching.dictionary_candidates):
        one = sorted(map(repr, job(texts, ["k", "j"], known).collect()))
        # a map with room or a full one; hashes that many phrases share; parts that end by tokens or by what they ask for
        for map_bits, hash_bits, tokens, asked, packed in ((27, 40, 10**6, 10**6, 10**6), (6, 4, 50, 10**6, 7), (12, 40, 10**6, 3, 1)):
            for name, value in (("MAP_BITS", map_bits), ("HASH_BITS", hash_bits), ("PART_TOKENS", tokens), ("PART_PHRASES", asked), ("PACKED", packed), ("BATCH_TOKENS", 40)):
                monkeypatch.setattr(matching, name, value)
            found = job(texts, ["k", "j"], known, trie_phrases=10)
            assert found.columns == ["k", "j", "p", "n", "span", "canonical"] and sorted(map(repr, found.collect())) == one
    assert len(one) > 1000


def test_first_two_tokens_are_those_of_all(spark):
    values = ["c++x y", "--A.b/c  d#", "one", "", None, "a#-b", "ﬁx\n\nSTRASSE ß", "a..b c", "1 2 3", "é a é b"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(text.first_two_tokens(F.col("v")), F.slice(text.tokens(F.col("v")), 1, 2))
    assert [r[0] for r in rows.collect()] == [r[1] if r[1] is None or len(r[1]) == 2 else [] for r in rows.collect()]
