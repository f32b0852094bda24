"""Queries: ranking and listings, tenancy and integrity, streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, ranking, search
from ..sources import documents as source
from ..streaming import jobs
from . import fixtures as fx
from .registry import query
from .screening import RANKED_SQL, VERSIONS_SQL, _versions, evaluations


@query(f"{RANKED_SQL} SELECT evaluation_id, job_id, score, place FROM ranked")
def l1_rank_evaluations(spark, sf):
    return ranking.rank_evaluations(evaluations(spark, sf)).select("evaluation_id", "job_id", "score", "place")


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS evaluation_id, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey END AS job_id, CASE WHEN l_partkey % 9 > 0 THEN CAST(l_quantity AS INT) END AS score, l_shipdate AS created_at FROM lineitem)
SELECT evaluation_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY score DESC NULLS LAST, created_at DESC, evaluation_id) AS place FROM e""")
def l1_rank_all(spark, sf):
    """Half of all rows belong to one job."""
    rows = fx.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evaluation_id"), F.when(F.col("l_orderkey") % 2 == 0, 0).otherwise(F.col("l_suppkey")).alias("job_id"), F.when(F.col("l_partkey") % 9 > 0, F.col("l_quantity").cast("int")).alias("score"), F.col("l_shipdate").alias("created_at"))
    return ranking.rank_all(rows, source.scratch(spark, "ranked")).select("evaluation_id", "job_id", "place")


@query(f"{fx.EVALUATED_SQL} SELECT evaluation_id, score, eligibility FROM evaluations WHERE eligibility IN ('eligible', 'needs_review') AND score >= 40")
def l2_filter_evaluations(spark, sf):
    return ranking.filter_evaluations(evaluations(spark, sf), ["eligible", "needs_review"], 40).select("evaluation_id", "score", "eligibility")


@query(f"{RANKED_SQL} SELECT evaluation_id, job_id, place FROM ranked WHERE place <= 5")
def l3_top_k(spark, sf):
    return ranking.top_k(evaluations(spark, sf), 5).select("evaluation_id", "job_id", "place")


@query(f"{RANKED_SQL}, n AS (SELECT evaluation_id, list({{'requirement_id': requirement_id, 'outcome': outcome}} ORDER BY requirement_id) AS assessments FROM assessed GROUP BY evaluation_id) SELECT evaluation_id, job_id, place, assessments FROM ranked JOIN n USING (evaluation_id)")
def l4_evaluation_report(spark, sf):
    assessments, summary = fx.evaluated(spark, sf)
    ranked = ranking.rank_evaluations(summary.join(fx.submissions(spark, sf).select("evaluation_id", "created_at"), "evaluation_id"))
    rows = ranking.evaluation_report(ranked, assessments)
    return rows.select("evaluation_id", "job_id", "place", F.transform("assessments", lambda a: F.struct(a["requirement_id"].alias("requirement_id"), a["outcome"].alias("outcome"))).alias("assessments"))


def _people(spark, sf):
    return fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.concat(F.lower(F.col("c_mktsegment")), F.col("c_custkey"), F.lit("@example.org")).alias("email"), F.col("c_nationkey"), F.col("c_mktsegment"))


@query("SELECT c_custkey AS user_id FROM customer WHERE contains(lower(c_name || ' ' || lower(c_mktsegment) || c_custkey || '@example.org'), 'building1')")
def l5_search_candidates(spark, sf):
    return ranking.search_candidates(_people(spark, sf), " Building1").select("user_id")


PEOPLE_SQL = "people AS (SELECT c_custkey AS user_id, lower(c_name || ' ' || lower(c_mktsegment) || c_custkey || '@example.org') AS t FROM customer)"


@query(f"WITH {PEOPLE_SQL}, needles AS (SELECT DISTINCT n FROM (SELECT lower(substr(n_name, 1, CAST(1 + n_nationkey % 4 AS INT))) AS n FROM nation UNION ALL SELECT c_custkey || '@' FROM customer WHERE c_custkey % 7 = 0)) SELECT n AS needle, user_id FROM needles, people WHERE contains(t, n)")
def l5_search_index(spark, sf):
    """Many needles at once, by an index that is written and read again."""
    path = source.scratch(spark, "index")
    people = _people(spark, sf).select("user_id", F.concat_ws(" ", "name", "email").alias("text"))
    search.write_index(search.gram_index(people, "user_id", "text"), path)
    names = fx.table(spark, sf, "nation").select(F.lower(F.substring("n_name", F.lit(1), (1 + F.col("n_nationkey") % 4).cast("int"))).alias("needle"))
    numbers = fx.table(spark, sf, "customer").filter("c_custkey % 7 = 0").select(F.concat("c_custkey", F.lit("@")).alias("needle"))
    return search.search(search.read_index(spark, path), people, "user_id", "text", names.unionByName(numbers))


@query("SELECT p_partkey AS job_id, p_name AS title FROM part WHERE contains(lower(p_name), 'bolt')")
def l6_search_jobs(spark, sf):
    return ranking.search_jobs(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title")), " Bolt")


@query(f"{fx.EVALUATED_SQL} SELECT n_regionkey AS org_id, job_id, count(*) AS n, count(*) FILTER (eligibility = 'eligible') AS eligible, count(*) FILTER (eligibility = 'needs_review') AS needs_review, max(score) AS top_score FROM evaluations JOIN nation ON n_nationkey = job_id GROUP BY ROLLUP (n_regionkey, job_id)")
def l7_job_summary(spark, sf):
    orgs = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("job_id"), F.col("n_regionkey").alias("org_id"))
    return ranking.job_summary(evaluations(spark, sf).join(orgs, "job_id"))


LATEST_SQL = "latest AS (SELECT job_id, version, confirmed_at IS NOT NULL AS confirmed FROM versions QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY version DESC) = 1)"


@query(f"WITH {VERSIONS_SQL}, {LATEST_SQL} SELECT c_custkey AS job_id, c_nationkey AS org_id, c_name AS title, CAST(c_acctbal AS BIGINT) AS created_at, version, confirmed, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_acctbal AS BIGINT) DESC, c_custkey) AS INT) AS place FROM customer LEFT JOIN latest ON job_id = c_custkey".replace("CAST(c_acctbal AS BIGINT)", "(c_custkey * 7919) % 1000"))
def l8_list_jobs(spark, sf):
    rows = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("org_id"), F.col("c_name").alias("title"), (F.col("c_custkey") * 7919 % 1000).alias("created_at"))
    return ranking.list_jobs(rows, _versions(spark, sf))


def _reports(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("event_id").alias("report_id"), F.col("user_id"), F.col("event_type").alias("status"), F.col("event_id").alias("job_id"), F.bround("value").cast("int").alias("score"), F.col("ts").cast("timestamp").alias("created_at"))


@query("SELECT event_id AS report_id, event_type AS status, CAST(round_even(value, 0) AS INT) AS score, CAST(ts AS TIMESTAMP) AS created_at FROM events WHERE user_id = 7")
def l9_report_history(spark, sf):
    return ranking.report_history(_reports(spark, sf), 7)


@query("SELECT o_orderkey AS processing_id, coalesce('user:' || e.user_id, 'org:' || c.c_nationkey) AS owner FROM orders o LEFT JOIN events e ON o_orderkey % 3 = 0 AND e.event_id = o_orderkey LEFT JOIN customer c ON c.c_custkey = o_custkey")
def l10_job_status(spark, sf):
    processing = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("processing_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("report_id"), F.col("o_custkey").alias("submission_id"))
    owners = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("submission_id"), F.col("c_nationkey").alias("org_id"))
    return ranking.job_status(processing, _reports(spark, sf), owners).select("processing_id", "owner")


@query("SELECT event_id, CAST(least(greatest(floor(value - 20 + 0.5), 0), 100) AS INT) AS minimum FROM events")
def l11_clamp_score_filter(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", ranking.clamp_score_filter(F.col("value") - 20).alias("minimum"))


@query(f"{RANKED_SQL} SELECT c.c_name AS candidate_name, 'completed' AS status, coalesce(CAST(score AS VARCHAR), '') AS score, eligibility, CAST(evidence_coverage AS VARCHAR) AS evidence_coverage FROM ranked LEFT JOIN customer c ON c.c_custkey = doc_id WHERE c.c_name IS NOT NULL")
def s10_export_csv(spark, sf):
    names = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("candidate_name"))
    ranked = ranking.rank_evaluations(evaluations(spark, sf)).join(names, "doc_id").withColumn("status", F.lit("completed"))
    path = source.scratch(spark, "files")
    source.write_csv(ranked, path)
    text = ", ".join(f"{c} string" for c in source.EXPORTED)
    return spark.read.option("header", True).schema(text).csv(path).fillna("")


MEMBERS_SQL = "members AS (SELECT c_custkey AS user_id, n_regionkey AS org_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'recruiter' ELSE 'viewer' END AS role FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _members(spark, sf):
    people = _people(spark, sf).join(fx.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return people.select("user_id", F.col("n_regionkey").alias("org_id"), F.when(F.col("c_mktsegment") == "BUILDING", "owner").when(F.col("c_mktsegment") == "MACHINERY", "recruiter").otherwise("viewer").alias("role"))


def _org_rows(spark, sf):
    return fx.table(spark, sf, "supplier").join(fx.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("org_id"))


@query(f"WITH {MEMBERS_SQL} SELECT s_suppkey, n_regionkey AS org_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (SELECT org_id FROM members WHERE user_id = 11)")
def q1_visible_rows(spark, sf):
    return integrity.visible_rows(_org_rows(spark, sf), _members(spark, sf), 11)


@query(f"WITH {MEMBERS_SQL}, u AS (SELECT min(user_id) AS id FROM members WHERE role = 'recruiter') SELECT s_suppkey, n_regionkey AS org_id, n_regionkey IN (SELECT org_id FROM members WHERE user_id = 27 AND role = 'owner') AS owned FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IN (SELECT org_id FROM members WHERE user_id = 27 AND role IN ('owner', 'recruiter'))")
def q2_writable_rows(spark, sf):
    rows, members = _org_rows(spark, sf), _members(spark, sf)
    owned = integrity.writable_rows(rows, members, 27, owner_only=True).select("s_suppkey", F.lit(True).alias("owned"))
    return integrity.writable_rows(rows, members, 27).join(owned, "s_suppkey", "left").fillna({"owned": False})


@query(f"WITH {MEMBERS_SQL} SELECT m.user_id, org_id, role, c_name AS name, lower(c_mktsegment) || c_custkey || '@example.org' AS email FROM members m JOIN customer ON c_custkey = user_id")
def q3_member_list(spark, sf):
    return integrity.member_list(_members(spark, sf), _people(spark, sf).select("user_id", "name", "email"))


@query("""SELECT 'part name' AS "check", CAST(to_json({'p_name': p_name}) AS VARCHAR) AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'order line', CAST(to_json({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber}) AS VARCHAR), count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'one event of a kind', CAST(to_json({'user_id': user_id, 'event_type': event_type}) AS VARCHAR), count(*) FROM events GROUP BY user_id, event_type HAVING count(*) > 1""")
def q4_unique_violations(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    return integrity.unique_violations([("part name", t("part"), ["p_name"]), ("order line", t("lineitem"), ["l_orderkey", "l_linenumber"]), ("one event of a kind", t("events"), ["user_id", "event_type"])])


@query("""SELECT 'status' AS "check", count(*) FILTER (NOT o_orderstatus IN ('F', 'O')) AS n FROM orders UNION ALL SELECT 'quantity', count(*) FILTER (NOT l_quantity BETWEEN 1 AND 40) FROM lineitem
UNION ALL SELECT 'one owner', count(*) FILTER (NOT ((p_size % 3 = 0) <> (p_partkey % 2 = 0))) FROM part""")
def q5_check_violations(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    one = (F.col("p_size") % 3 == 0) != (F.col("p_partkey") % 2 == 0)
    return integrity.check_violations([("status", t("orders"), F.col("o_orderstatus").isin("F", "O")), ("quantity", t("lineitem"), F.col("l_quantity").between(1, 40)), ("one owner", t("part"), one)])


@query("""SELECT 'label' AS "check", CAST(to_json({'doc_id': doc_id}) AS VARCHAR) AS key FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders) WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'event user', CAST(to_json({'user_id': user_id}) AS VARCHAR) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def q6_fk_violations(spark, sf):
    t = lambda n: fx.table(spark, sf, n)
    return integrity.fk_violations([("label", t("orders").select(F.col("o_custkey").alias("doc_id")), t("labels"), ["doc_id"]), ("event user", t("events"), t("customer").select(F.col("c_custkey").alias("user_id")), ["user_id"])])


@query("SELECT event_id AS report_id, event_type AS status FROM events WHERE user_id = 13")
def q7_owned_report(spark, sf):
    return integrity.owned_report(_reports(spark, sf), 13).select("report_id", "status")


@query("SELECT p_partkey AS ask_id, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey END AS invitation_id FROM part")
def q8_invitation_lookup(spark, sf):
    parts = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    text = F.col("k").cast("string")
    invitations = parts.select(F.col("k").alias("invitation_id"), F.sha2(F.concat(F.lit("tok"), text), 256).alias("token_hash"), F.sha2(F.concat(F.lit("PASS"), text), 256).alias("passcode_hash"))
    code = F.when(F.col("k") % 4 == 3, "none").when(F.col("k") % 2 == 0, F.concat(F.lit("tok"), text)).otherwise(F.concat(F.lit("pass"), text))
    return integrity.invitation_lookup(parts.select(F.col("k").alias("ask_id"), code.alias("code")), invitations)


# Streaming forms: each reads the table as a stream where its result is a table afterwards.


def _streamed(spark, sf, name, each):
    """Run ``each`` over the batches of the table as a stream; return all that they wrote."""
    target = source.scratch(spark, "stream")
    # a pattern, as the table may be one file or a folder
    stream = jobs.file_stream(spark, f"{sf}/[{name[0]}]{name[1:]}.parquet", fx.table(spark, sf, name).schema)
    jobs.stream_facts(stream, each, f"{target}/out", f"{target}/state")
    return spark.read.parquet(f"{target}/out").drop("batch")


@query(f"{fx.SPANS_SQL}, {fx.EVIDENCE_SQL} SELECT doc_id, canonical, evidence FROM evidence")
def k1_stream_facts(spark, sf):
    from ..operators import matching

    phrases = fx.phrases(spark)

    def extract(batch):
        lines = batch.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
        blocks = lines.select("doc_id", (F.col("i") + 1).alias("block_pos"), F.concat(F.lit("p"), F.col("i") + 1, F.lit("-b1")).alias("block_id"), "text")
        return matching.skill_evidence(matching.leftmost_longest(blocks, ["doc_id", "block_pos", "block_id"], phrases))

    return _streamed(spark, sf, "documents", extract)


@query("SELECT user_id, event_type, min((ts, event_id))[2] AS event_id FROM events GROUP BY user_id, event_type")
def k2_stream_dedupe(spark, sf):
    stream = jobs.file_stream(spark, f"{sf}/[e]vents.parquet", fx.table(spark, sf, "events").schema)
    rows = stream.select("user_id", "event_type", "ts", "event_id")
    return jobs.stream_once(rows, ["user_id", "event_type"], ["ts", "event_id"], source.scratch(spark, "once")).select("user_id", "event_type", "event_id")


@query(f"WITH {fx.SUBMISSIONS_SQL} SELECT evaluation_id, job_id, doc_id FROM submissions")
def k3_stream_fanout(spark, sf):
    static = fx.submissions(spark, sf).select("evaluation_id", "job_id", "doc_id")
    return _streamed(spark, sf, "documents", lambda batch: jobs.stream_fanout(batch.select("doc_id"), static))


@query("SELECT c_custkey AS candidate_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE m.s END AS email, m.n AS location FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS s, min(o_orderstatus) AS n FROM orders GROUP BY 1) m ON o_custkey = c_custkey")
def k4_stream_upsert_candidate(spark, sf):
    current = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "old").alias("email"), F.lit(None).cast("string").alias("location"))
    found = lambda batch: batch.select(F.col("o_custkey").alias("candidate_id"), F.lit("new").alias("name"), F.col("o_orderpriority").alias("email"), F.col("o_orderstatus").alias("location"))
    target = source.scratch(spark, "upsert")
    stream = jobs.file_stream(spark, f"{sf}/[o]rders.parquet", fx.table(spark, sf, "orders").schema)
    return jobs.stream_upsert(stream, found, current, target)


STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'ready' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"
STATES_SQL = f"""log AS (SELECT user_id AS job_id, ts, event_id, {STATUS_SQL} AS status, 'error ' || event_id AS error FROM events WHERE event_type <> 'click'),
states AS (SELECT job_id, CASE WHEN arg_max(status, (ts, event_id)) = 'failed' THEN CASE WHEN count(*) FILTER (status = 'failed') >= 3 THEN 'dead' ELSE 'ready' END ELSE arg_max(status, (ts, event_id)) END AS state,
  count(*) FILTER (status = 'failed') AS attempts, arg_max(error, (ts, event_id)) FILTER (status = 'failed') AS last_error,
  CASE WHEN arg_max(status, (ts, event_id)) = 'failed' AND count(*) FILTER (status = 'failed') < 3 THEN CAST(max(ts) AS TIMESTAMP) + to_seconds(CAST(pow(2, count(*) FILTER (status = 'failed')) AS INT)) END AS ready_at FROM log GROUP BY job_id)"""


def _log(rows):
    status = F.when(F.col("event_type") == "signup", "ready").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    return rows.filter("event_type <> 'click'").select(F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status"), F.concat(F.lit("error "), "event_id").alias("error"))


@query(f"WITH {STATES_SQL} SELECT * FROM states")
def k5_job_state(spark, sf):
    target = source.scratch(spark, "states")
    stream = jobs.file_stream(spark, f"{sf}/[e]vents.parquet", fx.table(spark, sf, "events").schema)
    return jobs.stream_states(_log(stream), target)


@query("""SELECT event_id AS job_id, CAST(event_id % 10 AS INT) AS attempt, CAST(ts AS TIMESTAMP) AS failed_at, event_id % 4 > 0 AS retryable, CASE WHEN event_id % 4 > 0 AND event_id % 10 < 9 THEN 'ready' ELSE 'dead' END AS next_state,
CASE WHEN event_id % 4 > 0 AND event_id % 10 < 9 THEN CAST(ts AS TIMESTAMP) + to_seconds(least(300, CAST(pow(2, event_id % 10) AS INT))) END AS ready_at FROM events""")
def k6_retry_plan(spark, sf):
    i = F.col("event_id")
    rows = fx.table(spark, sf, "events").select(i.alias("job_id"), (i % 10).cast("int").alias("attempt"), F.col("ts").cast("timestamp").alias("failed_at"), (i % 4 > 0).alias("retryable"))
    return jobs.retry_plan(rows, max_attempts=9)


INVITED_SQL = """subs AS (SELECT o_orderkey AS submission_id, o_custkey // 3 AS invitation_id, o_custkey % 3 AS user_id, CAST(o_orderdate AS TIMESTAMP) AS "at" FROM orders),
inv AS (SELECT i AS invitation_id, TIMESTAMP '1993-01-01' + to_days(CAST(i % 500 AS INT)) AS opens, TIMESTAMP '1993-01-01' + to_days(CAST(i % 500 + 1200 AS INT)) AS closes,
  CASE WHEN i % 11 = 0 THEN TIMESTAMP '1994-01-01' END AS revoked_at, TIMESTAMP '1993-01-01' + to_days(CAST(i % 500 + 300 + i % 900 AS INT)) AS expires_at, CASE WHEN i % 7 = 0 THEN i % 3 END AS holder
  FROM (SELECT DISTINCT c_custkey // 3 AS i FROM customer WHERE c_custkey // 3 % 13 > 0)),
gate AS (SELECT s.*, CASE WHEN i.invitation_id IS NULL THEN 'invitation is unknown' WHEN NOT (opens <= "at" AND "at" < closes) THEN 'applications are closed' WHEN revoked_at IS NOT NULL THEN 'invitation is revoked'
  WHEN expires_at <= "at" THEN 'invitation is expired' WHEN holder <> user_id THEN 'invitation is redeemed by another user' END AS reason FROM subs s LEFT JOIN inv i USING (invitation_id)),
firsts AS (SELECT invitation_id, min(("at", submission_id, user_id)) AS f FROM gate WHERE reason IS NULL GROUP BY invitation_id)"""


@query(f"""WITH {INVITED_SQL} SELECT submission_id, g.invitation_id, user_id, "at",
CASE WHEN reason IS NOT NULL THEN reason WHEN f[2] = submission_id THEN NULL WHEN f[3] = user_id THEN 'invitation is used' ELSE 'invitation is redeemed by another user' END AS reason FROM gate g LEFT JOIN firsts USING (invitation_id)""")
def k7_stream_admission(spark, sf):
    i = F.col("invitation_id")
    day = lambda n: F.to_timestamp(F.lit("1993-01-01")) + F.make_dt_interval(days=n.cast("int"))
    known = fx.table(spark, sf, "customer").select(F.expr("c_custkey DIV 3").alias("invitation_id")).distinct().filter(i % 13 > 0)
    revoked, holder = F.when(i % 11 == 0, F.to_timestamp(F.lit("1994-01-01"))), F.when(i % 7 == 0, i % 3)
    invitations = known.select("invitation_id", day(i % 500).alias("opens"), day(i % 500 + 1200).alias("closes"), revoked.alias("revoked_at"), day(i % 500 + 300 + i % 900).alias("expires_at"), holder.alias("holder"))
    rows = lambda batch: batch.select(F.col("o_orderkey").alias("submission_id"), F.expr("o_custkey DIV 3").alias("invitation_id"), (F.col("o_custkey") % 3).alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    stream = jobs.file_stream(spark, f"{sf}/[o]rders.parquet", fx.table(spark, sf, "orders").schema)
    return jobs.stream_invited(stream, rows, invitations, source.scratch(spark, "invited"))


@query(f"WITH {STATES_SQL} SELECT c_custkey AS job_id, CASE WHEN state = 'dead' THEN 'failed' ELSE 'processing' END AS status, CASE WHEN state = 'dead' THEN 'The report could not be completed.' END AS error FROM customer LEFT JOIN states ON job_id = c_custkey")
def k8_failed_reports(spark, sf):
    reports = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.lit("processing").alias("status"))
    return jobs.failed_reports(reports, jobs.job_state(_log(fx.table(spark, sf, "events"))))
