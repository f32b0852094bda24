"""Streams that go on after a restart: the keyed table, upserts, job states and admission by invitation."""

import os
import random

import pytest
from pyspark.sql import functions as F

from citewell.streaming import jobs, keyed_table


def plain(df):
    return sorted(map(str, df.collect()))


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_keyed_table_versions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string"
    start = spark.createDataFrame([(i, "old") for i in range(200)], schema)
    keyed_table.create(start, path, "k")
    keyed_table.create(start.limit(0), path, "k")  # it is there already
    want = dict.fromkeys(range(200), "old")
    for version in range(1, 8):
        new = {k: f"v{version}" for k in (version, 1000 + version)}
        changes = spark.createDataFrame(list(new.items()), schema)
        for _ in range(2 if version == 4 else 1):  # a batch that is repeated
            keyed_table.update(path, "k", changes, version, keyed_table.replace("k"), start.schema)
        want |= new
        assert {r.k: r.v for r in keyed_table.read(spark, path, start.schema).collect()} == want
        touched = len(os.listdir(f"{path}/data/version={version}")) - sum(x.startswith((".", "_")) for x in os.listdir(f"{path}/data/version={version}"))
        assert touched <= 2  # the other buckets are not written again
    assert keyed_table.versions(spark, path) == [5, 6, 7]
    needed = {at for v in (5, 6, 7) for at in keyed_table.places(spark, path, v).values()}
    assert {int(x.partition("=")[2]) for x in os.listdir(f"{path}/data") if x.startswith("version=")} == needed
    assert {r.v for r in keyed_table.read(spark, path, start.schema, 6).collect()} == {"old", *(f"v{i}" for i in range(1, 7))}


def test_keyed_table_of_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "k long, v string")
    keyed_table.create(empty, str(tmp_path), "k")
    assert keyed_table.read(spark, str(tmp_path), empty.schema).count() == 0
    keyed_table.update(str(tmp_path), "k", empty, 1, keyed_table.replace("k"), empty.schema)
    keyed_table.update(str(tmp_path), "k", spark.createDataFrame([(None, "x"), (1, "y")], "k long, v string"), 2, keyed_table.replace("k"), empty.schema)
    assert plain(keyed_table.read(spark, str(tmp_path), empty.schema)) == ["Row(k=1, v='y')", "Row(k=None, v='x')"]


def test_upserts_go_on_after_restarts(spark, tmp_path):
    schema = "candidate_id long, name string, email string, location string"
    current = spark.createDataFrame([(i, None, "old" if i % 2 else None, None) for i in range(40)], schema)
    rng = random.Random(3)
    batches = [[(rng.randrange(45), rng.choice([None, f"n{b}"]), rng.choice([None, f"e{b}"]), f"l{b}") for _ in range(12)] for b in range(4)]
    source, target, want = str(tmp_path / "in"), str(tmp_path / "out"), current
    for batch in batches:
        feed(spark, source, batch, schema)
        want = jobs.upsert_contacts(want, spark.createDataFrame(batch, schema))
        for _ in range(2):  # with and without new files
            got = jobs.stream_upsert(jobs.file_stream(spark, source, current.schema), lambda b: b, current, target)
            assert plain(got) == plain(want)


def test_states_go_on_after_restarts(spark, tmp_path):
    rng = random.Random(4)
    events = spark.range(90).select(F.when(F.col("id") < 5, 100 + F.col("id")).otherwise(F.col("id") * 7 % 11).alias("job_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 37 % 50).alias("ts"), F.col("id").alias("event_id"), F.element_at(F.array(*(F.lit(x) for x in ("ready", "processing", "failed", "completed", "failed"))), (F.col("id") % 5 + 1).cast("int")).alias("status"), F.concat(F.lit("e"), "id").alias("error"))
    rows = events.collect()
    rng.shuffle(rows)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for upto in (30, 60, 90):
        feed(spark, source, rows[upto - 30 : upto], events.schema)
        for _ in range(2):
            got = jobs.stream_states(jobs.file_stream(spark, source, events.schema), target)
            assert plain(got) == plain(jobs.job_state(spark.createDataFrame(rows[:upto], events.schema)))
    found = got.collect()
    assert {"dead", "ready"} <= {r.state for r in found} and all(r.ready_at is None for r in found if r.state != "ready")
    assert any(r.ready_at for r in found)


@pytest.fixture
def invitations(spark):
    at = lambda s: f"timestamp_seconds({s})"
    rows = [(1, 0, 100, None, 90, None), (2, 50, 100, None, 90, None), (3, 0, 100, 5, 90, None), (4, 0, 100, None, 20, None), (5, 0, 100, None, 90, 7)]
    return spark.createDataFrame(rows, "invitation_id long, o int, c int, r int, e int, holder long").selectExpr("invitation_id", f"{at('o')} AS opens", f"{at('c')} AS closes", f"{at('r')} AS revoked_at", f"{at('e')} AS expires_at", "holder")


def submitted(spark, rows):
    return spark.createDataFrame(rows, "submission_id long, invitation_id long, user_id long, s int").selectExpr("submission_id", "invitation_id", "user_id", "timestamp_seconds(s) AS at")


def reasons(df):
    return {r.submission_id: r.reason for r in df.collect()}


def test_first_redeemer_wins_over_restarts(spark, tmp_path, invitations):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    first = [(1, 1, 7, 40), (2, 1, 8, 30), (3, 1, 8, 35), (4, 2, 7, 30), (5, 3, 7, 30), (6, 4, 7, 30), (7, 5, 8, 30), (8, 9, 7, 30), (9, None, 7, 30)]
    want = {1: "invitation is redeemed by another user", 2: None, 3: "invitation is used", 4: "applications are closed", 5: "invitation is revoked", 6: "invitation is expired", 7: "invitation is redeemed by another user", 8: "invitation is unknown", 9: "invitation is unknown"}
    run = lambda: jobs.stream_invited(jobs.file_stream(spark, source, submitted(spark, first).schema), lambda b: b, invitations, target)
    submitted(spark, first).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        assert reasons(run()) == want
    second = [(10, 1, 7, 10), (11, 1, 8, 50), (12, 5, 7, 60), (13, 5, 7, 60), (14, 2, 9, 70)]  # earlier, but of a later batch
    submitted(spark, second).coalesce(1).write.mode("append").parquet(source)
    want |= {10: "invitation is redeemed by another user", 11: "invitation is used", 12: None, 13: "invitation is used", 14: None}
    for _ in range(2):
        assert reasons(run()) == want


def test_one_batch_equals_the_rule(spark, invitations):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 2, 4, 5, 6, None]), rng.choice([7, 8, None]), rng.randrange(110)) for i in range(300)]
    none = spark.createDataFrame([], jobs.REDEEMED)
    got = reasons(jobs.gate_submissions(submitted(spark, rows), invitations, none))
    assert len(got) == len(rows)
    admitted = [i for i, r in got.items() if r is None]
    at = {i: (s, i) for i, _, _, s in rows}
    by = {i: inv for i, inv, _, _ in rows}
    assert len({by[i] for i in admitted}) == len(admitted) > 1  # one each
    for i, inv, _, _ in rows:
        if got[i] in ("invitation is used", "invitation is redeemed by another user") and inv != 5:
            assert any(by[j] == inv and at[j] < at[i] for j in admitted)


def test_the_first_record_of_a_key_for_all_time(spark, tmp_path):
    schema = "kind string, k long, at long, v string"
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 4, None]), i, f"v{i}") for i in range(60)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(source)
    run = lambda: {(r.kind, r.k): r.v for r in jobs.stream_once(jobs.file_stream(spark, source, empty.schema), ["kind", "k"], ["at"], target).collect()}
    assert run() == {}
    want, seen = {}, []
    for upto in (3, 30, 60):
        new = rows[len(seen) : upto]
        seen += new
        feed(spark, source, new[::-1], schema)
        for kind, k, _, v in new:
            want.setdefault((kind, k), v)
        for _ in range(2):
            assert run() == want
