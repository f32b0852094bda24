"""Connected components of an edge table, by alternating stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

EDGE = "a long, b long"
#: Edges that one task holds in memory.
TASK_EDGES = 500_000


def _contract(edges: DataFrame) -> DataFrame:
    """Within each task, replace edges by links to the smallest node they reach there; fewer edges, same components."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        links = [(x, root(x)) for x in up]
        links = [x for x in links if x[0] != x[1]]
        for at in range(0, len(links), 50_000):
            part = links[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["a", "b"])

    return edges.mapInArrow(local, EDGE)


def connected_components(edges: DataFrame, task_edges: int = TASK_EDGES, most_rounds: int = 50) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of an edge table ``(a, b)`` of longs.

    Edges with a null or with equal ends are left out; repeated edges don't matter; no edges give no rows. Tasks first
    contract about ``task_edges`` edges each. While more than that are left, each round links the larger neighbours of
    every node to its smallest one (large star), then all smaller neighbours (small star), and contracts again; these
    steps are joins and minima, so that a node with very many edges is never gathered in one place.
    """
    clean = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, before = materialize(clean), None
    size = now.count()
    for _ in range(most_rounds):
        whole = size <= task_edges
        now = materialize(_contract(now.coalesce(-(-max(size, 1) // task_edges))))
        if whole:
            break
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        size, before = state[0], state
        if size <= task_edges:
            continue
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = materialize(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
