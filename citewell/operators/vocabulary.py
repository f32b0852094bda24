"""Vocabulary build: first-wins names, aliases, checks, and the phrase table that matching joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import collapse, fold, tokens

MAX_PHRASE_TOKENS, MIN_NAME_LENGTH = 6, 2
#: Curated names with category and aliases.
CURATED = (
    ("SQL", "Database query languages", ("t-sql", "pl/sql")),
    ("AWS", "Cloud platforms", ("amazon web services",)),
    ("Azure", "Cloud platforms", ("microsoft azure",)),
    ("Google Cloud Platform", "Cloud platforms", ("gcp", "google cloud")),
    ("Machine Learning", "Data science", ("ml",)),
    ("Deep Learning", "Data science", ()),
    ("Artificial Intelligence", "Data science", ("ai",)),
    ("Snowflake", "Data warehousing", ("snowflake db",)),
    ("dbt", "Data engineering", ()),
    ("PostgreSQL", None, ("postgres",)),
    ("Kubernetes", None, ("k8s",)),
    ("JavaScript", None, ("js",)),
    ("TypeScript", None, ("ts",)),
    ("Python", None, ("py",)),
    ("Apache Kafka", None, ("kafka",)),
    ("IBM Terraform", None, ("terraform",)),
    ("Apache Airflow", None, ("airflow",)),
    ("Communication", "General competencies", ("communication skills",)),
    ("Teamwork", "General competencies", ("team collaboration",)),
    ("Leadership", "General competencies", ("people management",)),
    ("Problem Solving", "General competencies", ("problem-solving",)),
    ("Public Speaking", "General competencies", ()),
)
ABSORBERS = ("Computer Science",)


def curated(spark: SparkSession) -> DataFrame:
    rows = [(i, name, category, list(aliases)) for i, (name, category, aliases) in enumerate(CURATED)]
    return spark.createDataFrame(rows, "row_idx int, name string, category string, aliases array<string>")


def first_wins(named: DataFrame) -> DataFrame:
    """``(source_rank, row_idx, name, category)`` -> one row per folded name, of the earliest source and row.

    Names are collapsed; those under two characters or over six words are left out.
    """
    clean = named.withColumn("name", collapse(F.col("name")))
    clean = clean.filter((F.char_length("name") >= MIN_NAME_LENGTH) & (F.size(F.split("name", " ")) <= MAX_PHRASE_TOKENS))
    first = clean.withColumn("key", fold(F.col("name"))).groupBy("key").agg(F.min_by(F.struct("name", "category"), F.struct("source_rank", "row_idx", "name")).alias("x"))
    return first.select("key", "x.name", "x.category")


def alias_candidates(curated_rows: DataFrame, skills: DataFrame) -> DataFrame:
    """All ``(alias, canonical, rank, idx)``: curated names and aliases first, then each skill under its key."""
    own = curated_rows.select("name", "row_idx", F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    own = own.select(fold(F.col("alias")).alias("alias"), F.col("name").alias("canonical"), F.lit(0).alias("rank"), F.col("row_idx").cast("string").alias("idx"))
    return own.unionByName(skills.select(F.col("key").alias("alias"), F.col("name").alias("canonical"), F.lit(1).alias("rank"), F.col("key").alias("idx")))


def alias_map(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("alias").agg(F.min_by("canonical", F.struct("rank", "idx", "canonical")).alias("canonical"))


def alias_collisions(candidates: DataFrame) -> DataFrame:
    """Aliases with more than one canonical name."""
    found = candidates.groupBy("alias").agg(F.sort_array(F.collect_set("canonical")).alias("canonicals"))
    return found.filter(F.size("canonicals") > 1)


def alias_orphans(aliases: DataFrame, skills: DataFrame) -> DataFrame:
    """Aliases whose canonical name is no skill."""
    return aliases.withColumn("key", fold(F.col("canonical"))).join(skills.select("key"), "key", "left_anti").select("alias", "canonical")


def phrase_table(aliases: DataFrame, absorbers: DataFrame) -> DataFrame:
    """``phrase, canonical, n_tokens, max_tokens``: phrases win over absorbers (null canonical), which don't raise the limit."""
    phrases = aliases.select(fold(F.col("alias")).alias("phrase"), "canonical")
    other = absorbers.select(fold(F.col("phrase")).alias("phrase"), F.lit(None).cast("string").alias("canonical"))
    both = phrases.unionByName(other).groupBy("phrase").agg(F.max("canonical").alias("canonical")).withColumn("n_tokens", F.size(F.split("phrase", " ")))
    longest = both.filter("canonical IS NOT NULL").agg(F.least(F.max("n_tokens"), F.lit(MAX_PHRASE_TOKENS)).alias("max_tokens"))
    return both.crossJoin(F.broadcast(longest))  # one row


def category_lookup(names: DataFrame, skills: DataFrame) -> DataFrame:
    """``names(canonical)`` with the category of its folded name, null if unknown."""
    known = skills.select("key", "category")
    return names.withColumn("key", fold(F.col("canonical"))).join(known, "key", "left").drop("key")


def lint(phrases: DataFrame) -> DataFrame:
    """Phrases that no text can match, since tokenising changes them."""
    return phrases.filter(~_reachable(F.col("phrase"))).select("phrase")


def _reachable(phrase: Column) -> Column:
    return F.array_join(tokens(phrase), " ") == phrase
