"""Connected components of a link table by union-find in tasks and star contraction across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import written


def union_find(links: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each node's root, the smallest node of its group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:  # bounded: a batch is grouped by itself, the rounds below do the rest
        roots = union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        pairs = [(x, r) for x, r in roots.items() if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b: long) the smallest node of its
    group.  Links are contracted to stars inside tasks, then large-star and small-star rounds
    join the stars until nothing changes; no group is collected anywhere."""
    stars = written(links.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "stars")
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "large-stars")
        # small star: a node and its smaller neighbours are linked to the smallest of them
        small = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = small.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        low = small.join(least, F.col("a") == F.col("n")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(low.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "stars")
        # finished when every node has one parent and no parent has one
        parents = after.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        chained = after.join(after.select(F.col("a").alias("p")), F.col("b") == F.col("p"), "left_semi").limit(1).count()
        if not chained and not parents.where("k > 1").limit(1).count():
            break
        stars = after
    roots = after.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
