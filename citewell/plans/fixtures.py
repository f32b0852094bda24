"""Deterministic inputs that the registered queries derive from the given tables, for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import FOLDS
from ..operators import assessment, matching, vocabulary
from ..sources.documents import spread

#: phrase, canonical name; the last two are absorbers. All occur in the given documents.
VOCABULARY = (
    ("the", "The"), ("of the", "OfThe"), ("the of the", "TheOfThe"), ("de la", "DeLa"), ("the the", "TheThe"), ("is", "Is"),
    ("with", "With"), ("that", "That"), ("und", "Und"), ("ai", "Ai"), ("the is", None), ("and the", None),
)
CATEGORIES = (("The", "articles"), ("OfThe", "articles"), ("Is", "verbs"), ("With", "prepositions"), ("Und", "conjunctions"))
#: Requirement texts: by (job + place) % 5, kinds by place.
TEXTS = ("the of the people with pride", "that is und so", "de la ai", "nothing to name", "is with that the the end")
KINDS = ("required", "preferred", "hard_gate", "ignored")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, c) for p, c in VOCABULARY if c], "alias string, canonical string")


def phrases(spark: SparkSession) -> DataFrame:
    absorbers = spark.createDataFrame([(p,) for p, c in VOCABULARY if not c], "phrase string")
    return vocabulary.phrase_table(aliases(spark), absorbers)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n.lower(), n, c) for n, c in CATEGORIES], "key string, name string, category string")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at line feeds: ``doc_id, block_pos, block_id, text``."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return rows.select("doc_id", (F.col("i") + 1).alias("block_pos"), F.concat(F.lit("p"), F.col("i") + 1, F.lit("-b1")).alias("block_id"), "text")


def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return documents(spark, sf_dir).select("doc_id", F.transform(lines, lambda t, i: F.struct(F.concat(F.lit("p"), i + 1, F.lit("-b1")).alias("id"), t.alias("text"))).alias("blocks"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.leftmost_longest(blocks(spark, sf_dir), ["doc_id", "block_pos", "block_id"], phrases(spark))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four per job: ``job_id, requirement_id, kind, weight, normalized_text``."""
    job, i = F.col("job_id"), F.col("i")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))
    return rows.select("job_id", (job * 4 + i).alias("requirement_id"), pick(KINDS, i).alias("kind"), (1 + (job + i) % 3).alias("weight"), pick(TEXTS, (job + i) % 5).alias("normalized_text"))


def required_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = requirements(spark, sf_dir).select("requirement_id", F.col("normalized_text").alias("text"))
    return matching.mentioned_set(matching.leftmost_longest(texts, ["requirement_id"], phrases(spark)), ["requirement_id"])


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evaluation_id"), "doc_id", (F.col("doc_id") % 25).cast("int").alias("job_id"), created.alias("created_at"))


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assessments and summaries of all submissions."""
    evidence = matching.skill_evidence(spans(spark, sf_dir))
    return assessment.evaluate(submissions(spark, sf_dir), requirements(spark, sf_dir), required_names(spark, sf_dir), evidence)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and outcomes of all submissions, by bitmaps, without evidence."""
    found = spans(spark, sf_dir).select("doc_id", "canonical")
    return assessment.evaluate_bitmaps(submissions(spark, sf_dir), requirements(spark, sf_dir), required_names(spark, sf_dir), found)


# DuckDB


def fold_sql(x: str) -> str:
    for a, b in FOLDS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"lower({x})"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all({fold_sql(x)}, '[a-z0-9]+(?:[.#/-]+[a-z0-9]+|[+#]+)*')"


def values_sql(rows) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


VOCABULARY_SQL = f"vocab(phrase, canonical) AS ({values_sql(VOCABULARY)})"
CATEGORIES_SQL = f"categories(name, category) AS ({values_sql(CATEGORIES)})"
BLOCKS_SQL = "blocks AS (SELECT doc_id, CAST(i AS INT) AS block_pos, 'p' || i || '-b1' AS block_id, x[i] AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))"
REQUIREMENTS_SQL = f"""requirements AS (SELECT job_id, job_id * 4 + i AS requirement_id, ['required', 'preferred', 'hard_gate', 'ignored'][i + 1] AS kind, 1 + (job_id + i) % 3 AS weight,
  [{", ".join(repr(t) for t in TEXTS)}][(job_id + i) % 5 + 1] AS normalized_text FROM (SELECT n_nationkey AS job_id FROM nation), range(4) r(i))"""
SUBMISSIONS_SQL = "submissions AS (SELECT doc_id AS evaluation_id, doc_id, CAST(doc_id % 25 AS INT) AS job_id, make_timestamp((1704067200 + doc_id) * 1000000) AS created_at FROM documents)"


def spans_sql(texts: str, keys: str, name: str) -> str:
    """CTEs that end in ``name(keys, p, n, span, canonical)`` for a relation ``texts`` with ``keys`` and ``text``."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    of_a = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{name}_tok AS (SELECT {keys}, {tokens_sql("text")} AS t FROM {texts}),
{name}_pos AS (SELECT {keys}, t, unnest(range(1, len(t) + 1)) AS p FROM {name}_tok),
{name}_cand AS (SELECT {keys}, CAST(p - 1 AS INT) AS p, CAST(r.n AS INT) AS n, phrase AS span, canonical FROM (SELECT * FROM {name}_pos WHERE t[p] IN (SELECT split_part(phrase, ' ', 1) FROM vocab)), range(1, 4) r(n), vocab
  WHERE p + r.n - 1 <= len(t) AND phrase = array_to_string(t[p:p + r.n - 1], ' ')),
{name}_best AS (SELECT * FROM {name}_cand QUALIFY row_number() OVER (PARTITION BY {keys}, p ORDER BY n DESC) = 1),
{name}_link AS (SELECT {of_a}, a.p, a.n, a.span, a.canonical, b.p AS nx FROM (SELECT *, p + n AS e FROM {name}_best) a ASOF LEFT JOIN {name}_best b ON {same} AND a.e <= b.p),
{name}_first AS (SELECT * FROM {name}_link QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY p) = 1),
{name}_walk AS (SELECT * FROM {name}_first UNION ALL SELECT b.* FROM {name}_walk a JOIN {name}_link b ON {same} AND b.p = a.nx),
{name} AS (SELECT {keys}, p, n, span, canonical FROM {name}_walk WHERE canonical IS NOT NULL)"""


SPANS_SQL = f"WITH RECURSIVE {VOCABULARY_SQL}, {BLOCKS_SQL}, {spans_sql('blocks', 'doc_id, block_pos, block_id', 'spans')}"
EVIDENCE_SQL = "evidence AS (SELECT doc_id, canonical, list(block_id ORDER BY block_pos) AS evidence FROM (SELECT DISTINCT doc_id, canonical, block_pos, block_id FROM spans) GROUP BY ALL)"
ASSESSED_SQL = f"""{SPANS_SQL}, {EVIDENCE_SQL}, {REQUIREMENTS_SQL}, {SUBMISSIONS_SQL},
req_texts AS (SELECT requirement_id, normalized_text AS text FROM requirements), {spans_sql('req_texts', 'requirement_id', 'req_spans')},
required AS (SELECT DISTINCT requirement_id, canonical FROM req_spans),
pairs AS (SELECT evaluation_id, doc_id, job_id, requirement_id, kind, weight, normalized_text FROM submissions JOIN requirements USING (job_id)),
counted AS (SELECT p.*, count(r.canonical) AS n_required, count(e.canonical) AS n_matched,
    coalesce(list(r.canonical ORDER BY r.canonical) FILTER (e.canonical IS NOT NULL), []) AS matched FROM pairs p LEFT JOIN required r USING (requirement_id) LEFT JOIN evidence e ON e.doc_id = p.doc_id AND e.canonical = r.canonical GROUP BY ALL),
assessed AS (SELECT *, CASE WHEN n_required = 0 THEN 'unknown' WHEN n_matched = n_required THEN 'met' WHEN n_matched > 0 THEN 'partial' ELSE 'not_met' END AS outcome,
    CASE WHEN n_required = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM counted)"""


def summary_sql(source: str) -> str:
    return f"""SELECT evaluation_id, any_value(doc_id) AS doc_id, any_value(job_id) AS job_id,
    CAST(round_even(100 * sum(weight * CASE outcome WHEN 'met' THEN 1 WHEN 'partial' THEN 0.5::DOUBLE ELSE 0 END) FILTER (kind NOT IN ('ignored', 'hard_gate') AND outcome <> 'unknown')
      / sum(weight) FILTER (kind NOT IN ('ignored', 'hard_gate') AND outcome <> 'unknown'), 0) AS INT) AS score,
    CAST(coalesce(round_even(100 * count(*) FILTER (kind NOT IN ('ignored', 'hard_gate') AND outcome <> 'unknown') / nullif(count(*) FILTER (kind NOT IN ('ignored', 'hard_gate')), 0), 0), 100) AS INT) AS evidence_coverage,
    CASE WHEN bool_or(kind = 'hard_gate' AND outcome = 'not_met') THEN 'not_eligible' WHEN bool_or(kind = 'hard_gate' AND outcome IN ('partial', 'unknown')) THEN 'needs_review' ELSE 'eligible' END AS eligibility
  FROM {source} GROUP BY evaluation_id"""


EVALUATED_SQL = f"{ASSESSED_SQL}, summary AS ({summary_sql('assessed')}), evaluations AS (SELECT s.*, b.created_at FROM summary s JOIN submissions b USING (evaluation_id))"
