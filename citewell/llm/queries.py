"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, collocations, decontam, langid, lm_score, packing, quality, runs, similarity, simhash, toxicity, urls, warc
from .common import table

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")))
    read = warc.read_records(index, with_payload=False)
    return read.selectExpr("record_id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc_index"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT page_id, payload_bytes, x, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest FROM d),
m AS (SELECT x, max(page_id) AS last_id FROM b GROUP BY x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM b JOIN m USING (x)
"""


@query
def op5_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    extra = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "CASE WHEN id = 0 THEN 'user' ELSE 'assistant' END AS role", f"{said} AS text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_examples(chat.expand_prefix_targets(rows))


ORACLES["op5_chat_prefix_targets"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
        length(regexp_replace(role, '([<\[])(!*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)', '\1!\2\3', 'g')) + 10
        + length(regexp_replace(text, '([<\[])(!*)(\||/?s>|/?INST\]|</?SYS>>|/?SYS>>)', '\1!\2\3', 'g')) + 8 AS chars
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.labelled_urls(spark))


@query
def op3_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")


ORACLES["op3_host_quality"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM p),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM t, range(8) x(j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id) LEFT JOIN dl USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(1 / n) AS inv FROM h),
k AS (SELECT m, CASE WHEN v > m * (1 - m) * inv THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * inv) - 1, 1), 1000) ELSE 1000 END AS k FROM m),
r AS (SELECT source, m, n + k AS n, (f + m * k) / (n + k) AS rate FROM h, k),
q AS (SELECT source, m, rate - 2 * sqrt(rate * (1 - rate) / (n + 1)) AS low FROM r),
v AS (SELECT source, low * (1 - m) > 4 * m * (1 - low) AS host_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM b LEFT JOIN v USING (source)
"""


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity_components(table(spark, sf_dir, "documents"), k=3, percent=90)


ORACLES["op6_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("bm25")


ORACLES["op9_bm25_decontamination"] = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'),
        lambda x: regexp_replace(x, '^[.,;:!?"''()\[\]]+|[.,;:!?"''()\[\]]+$', '', 'g')), lambda x: x <> '') AS w FROM t),
s AS (SELECT kind, id, len(w) AS n, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT kind, id, n, i, array_to_string(w[i:i + 4], ' ') AS g FROM s),
d AS (SELECT DISTINCT id AS doc_id, g FROM g WHERE kind = 0),
b AS (SELECT id AS item_id, n, i, g, i + 4 > 2 * n // 3 AS in_answer FROM g WHERE kind = 1),
z AS (SELECT item_id, count(*) AS n_shingles, count(*) FILTER (NOT in_answer) AS q, count(*) FILTER (in_answer) AS a FROM b GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_matched, count(*) FILTER (NOT in_answer) AS n_question, count(*) FILTER (in_answer) AS n_answer FROM b JOIN d USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_matched, n_question, n_answer FROM h JOIN z USING (item_id)
WHERE 100 * n_matched >= 80 * n_shingles AND 100 * n_question >= 50 * q AND 100 * n_answer >= 50 * a
"""


@query
def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


@query
def op1_bayesian_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    langs, models = langid.fit_text_models(docs)
    found = langid.identify_languages(langid.document_rows(docs).unionByName(langid.page_rows(pages)), langs, models)
    is_page = found["kind"] == "page"
    return found.select(F.when(~is_page, found["id"]).alias("doc_id"), F.when(is_page, found["id"]).alias("page_id"), "lang", "text_lang", "posterior")


@query
def op11_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, unnest(p) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i),
f AS MATERIALIZED (SELECT lang, k, phrase, lang || chr(9) || phrase AS key, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS s FROM f WHERE k >= 2 AND a >= 10),
x AS (SELECT lang, k, phrase, a, j, array_to_string(s[1:j], ' ') AS first, array_to_string(s[j + 1:], ' ') AS rest FROM c, (VALUES (1), (2)) t(j) WHERE j < k),
y AS (SELECT x.lang, x.k, x.phrase, x.a, j, b.a AS l, e.a AS r, (1000000 * x.a::HUGEINT * x.a) // (b.a::HUGEINT * e.a) AS score
      FROM x JOIN f b ON b.key = x.lang || chr(9) || x.first JOIN f e ON e.key = x.lang || chr(9) || x.rest),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(s[o:o + 1], ' ') AS phrase, max(a) AS longer FROM c, (VALUES (1), (2)) t(o) WHERE k = 3 GROUP BY ALL),
q AS (SELECT z.* FROM z LEFT JOIN o ON o.lang = z.lang AND o.phrase = z.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM q)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest_runs(runs.periodic_runs(table(spark, sf_dir, "documents"), runs.planted))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
