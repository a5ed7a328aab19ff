"""Connected components of an edge table: union-find inside partitions, star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentlake.plans.runtime import store

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Smallest id of each node's component; paths are halved on the way."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        stars = [(x, r) for x, r in roots.items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], schema=EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id reachable over edges (a, b), for every node on an edge.

    Edges are undirected; loops, repeated edges and nulls do no harm (an edge
    with a null end is none). Each round contracts batches of edges to stars by
    union-find, then points each node at the smallest neighbour (large star,
    small star). Rounds go on until no edge changes, a number that grows with
    the logarithm of the longest chain. Nothing but two numbers a round reaches
    the driver.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where(F.col("node").isNotNull()).distinct()
    nodes = store(nodes)
    plain = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    now, before = store(plain.mapInArrow(_contract, "a bigint, b bigint").distinct()), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every edge is (larger, smaller)
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b")
        now = store(small.distinct())
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
