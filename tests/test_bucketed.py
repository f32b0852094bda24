import uuid

import pytest
from pyspark.sql import functions as F

from citewell.sources import bucketed


@pytest.fixture
def name(spark):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}_more")


def exchanges(df) -> list[str]:
    """What each exchange of the plan lies over, from its first scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange" in line or "FileScan" in line or "Scan ExistingRDD" in line]


def test_insert_absent_keeps_the_first_and_leaves_the_table_in_place(spark, name):
    schema = "a int, b string, x int"
    bucketed.create(spark.createDataFrame([(1, "p", 1), (2, "q", 2), (None, "n", 3)], schema), name, ["a", "b"], 8)
    assert bucketed.buckets_of(spark, name) == (["a", "b"], 8)
    new = spark.createDataFrame([(1, "p", 9), (3, "r", 5), (3, "r", 4), (2, None, 6)], "a int, b string, x int").withColumn("extra", F.lit(1))
    found = bucketed.absent(spark, name, new)
    lines = exchanges(found)
    assert sum("Exchange" in x for x in lines) == 1 and "Exchange" in lines[0] and "FileScan" in lines[-1], lines
    bucketed.insert_absent(spark, name, new)
    want = [(1, "p", 1), (2, "q", 2), (2, None, 6), (3, "r", 4), (None, "n", 3)]
    rows = lambda: sorted(map(tuple, spark.table(name).collect()), key=repr)
    assert rows() == sorted(want, key=repr)
    bucketed.insert_absent(spark, name, new.filter("b IS NOT NULL"))
    bucketed.insert_absent(spark, name, new.filter("false"))
    assert rows() == sorted(want, key=repr)
    lines = exchanges(bucketed.absent(spark, name, new))
    assert sum("Exchange" in x for x in lines) == 1


def test_results_meet_their_rows_without_an_exchange(spark, name):
    bucketed.create(spark.range(50).withColumn("status", F.lit("processing")), name, ["id"], 8)
    bucketed.create(spark.createDataFrame([], "id long, score int"), f"{name}_more", ["id"], 8)
    bucketed.insert_absent(spark, f"{name}_more", spark.range(0, 50, 5).select("id", F.lit(7).alias("score")))
    both = bucketed.joined(spark, name, f"{name}_more")
    assert not any("Exchange" in x for x in exchanges(both))
    assert both.count() == 50 and both.filter("score = 7").count() == 10
    with pytest.raises(ValueError):
        spark.sql(f"DROP TABLE {name}_more")
        bucketed.create(spark.createDataFrame([], "id long, score int"), f"{name}_more", ["id"], 4)
        bucketed.joined(spark, name, f"{name}_more")


def test_versions_are_appended_once(spark, name):
    bucketed.create(spark.createDataFrame([(1, 1, "a", "t"), (1, 2, "b", "t"), (2, 1, "c", "u")], "job int, version int, title string, kind string"), name, ["job"], 8)
    assert not any("Exchange" in x for x in exchanges(bucketed.latest(spark, name)))
    after = spark.createDataFrame([(1, 2, "z"), (1, 2, "z"), (2, 0, "late"), (3, 0, "new")], "job int, after int, title string")
    for _ in range(2):
        bucketed.append_versions(spark, name, after)
    found = sorted(map(tuple, spark.table(name).collect()), key=repr)
    assert found == sorted([(1, 1, "a", "t"), (1, 2, "b", "t"), (1, 3, "z", "t"), (2, 1, "c", "u"), (3, 1, "new", None)], key=repr)
    assert sorted((r["job"], r["version"]) for r in bucketed.latest(spark, name).collect()) == [(1, 3), (2, 1), (3, 1)]
