"""The corpus pipeline: stages that each call one operator of ``citewell.llm``.

toxicity -> host quality rules -> near duplicates -> benchmark decontamination -> packing. Every stage works on all rows
that the one before kept and, but for the last, returns the columns of documents. Rows are judged, never ids: a row
without an id is judged like any other, and a repeated id doesn't take other rows along. No stage is expressible in SQL
as a whole (the first is a trained model), so the rows are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citewell.llm import decontam, packing, quality, similarity, toxicity
from citewell.llm.common import bound_batches, materialize, table

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model is fitted on this input's labelled rows.

    A null, empty or wordless text has no toxic word and stays. Any text is scored whole, however long. Repeated rows
    score alike and share their fate. An empty table, or one without labels of both kinds, loses no row.
    """
    bound_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules, or whose host does, go.

    A null or empty text has too few words and goes. A null source is no host and takes nobody along. Long texts are
    measured whole. Repeated rows are judged alike and count each for their host. An empty table stays empty.
    """
    bound_batches(spark)
    return quality.drop_low_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the row with the smallest doc_id stays.

    Rows, not ids, are the nodes: repeated rows are copies of which one stays, different texts of one id are compared
    like any others, and a null id comes after all ids. Null, empty and wordless texts are linked with nothing and
    stay. Of equal ids the one first in the table stays. An empty table stays empty. Rows get their numbers once and
    are written with them, so that no later scan can number them otherwise.
    """
    bound_batches(spark)
    row, first = "_citewell_row", "_citewell_first"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = similarity.similarity_components(rows.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80)
    groups = materialize(found.filter("n_links > 0").select(F.col("doc_id").alias(row), "component_id"))
    known = groups.join(rows.select(row, "doc_id"), row)
    kept = known.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(first))
    dropped = materialize(groups.join(kept, "component_id").filter(F.col(row) != F.col(first)).select(row))
    return rows.join(dropped, row, "left_anti").drop(row)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    A null or empty text contains nothing and stays. Long texts are searched whole. Each row is judged for itself, so
    repeated rows share their fate. An empty table or benchmark loses no row.
    """
    bound_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences.

    A null or empty text is one end token. Long texts are cut into full pieces. Repeated rows are packed each, a null
    id stays null. An empty table gives no pieces.
    """
    bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
