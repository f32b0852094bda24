import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_ranks(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "place" in df.columns


def test_phrases_are_matched_where_the_text_is(spark):
    from citewell.operators import matching
    from citewell.plans import fixtures as fx

    for f in (matching.dictionary_candidates, matching.leftmost_longest):
        plan = f(fx.nested_blocks(spark, SF).select("doc_id", F.col("blocks")[0]["text"].alias("text")), ["doc_id"], fx.phrases(spark))
        plan = plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "Join" not in plan and "hashpartitioning" not in plan and plan.count("regexp_extract_all") == 1


@pytest.mark.parametrize("name", ["m4_leftmost_longest", "m4_large_vocabulary", "e9_evaluate_refined", "j7_merge_skills", "l7_job_summary", "p7_corrected_lines", "v7_vocab_lint", "q2_writable_rows", "l6_search_jobs", "s2_scan_vocab_tech", "s3_scan_vocab_elements", "s4_scan_vocab_titles", "s6_docx_blocks", "s11_archive_entries", "s12_vocab_table_write", "k2_stream_dedupe", "k4_stream_upsert_candidate", "k5_job_state", "k7_stream_admission", "k8_failed_reports", "s1_scan_documents", "s8_read_nested_json", "s9_write_nested_json", "s10_export_csv", "j3_strict_document", "j3_strict_cited", "l1_rank_all", "l5_search_index", "a12_default_weight", "a13_interval_join", "m3_dictionary_candidates", "e2_bitmap_outcomes", "e10_bucketed_insert", "e11_bucketed_results", "r4_bucketed_versions", "e2_meeting_documents", "e4_weighted_score", "e8_evaluate", "j1_strict_facts", "j2_strict_assessments", "flagship_ranked_evaluations"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    want = sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())
    assert want and sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want
