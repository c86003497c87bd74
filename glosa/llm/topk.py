"""Exact top-k search (operator 6): exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights, floor(scale * x).  A task turns
its candidates into posting lists (dimension -> rows, weights); each term of a
query row scatters its weighted posting into a dense score array, a partition
selection takes the k best, and the tasks' winners are merged per query.  The
score is the exact integer inner product; ties go to the smaller id.

The stated queries meet all candidates in blocks of ``QUERY_BLOCK`` queries: a
block (bounded) goes to every task, the candidates stay where they are, and each
task keeps k winners per query.  A block's winners are written before the next.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; missing trailing components and empty
vectors count as zeros; each row is a candidate of its own, also where rows share an id or
repeat, and each query row has its own winners; with fewer than k candidates all are returned; an empty table gives an empty
result.  Scores are expected to fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosa.llm.common import scratch_path, written

K = 10
SCALE = 1024
QUERY_BLOCK = 4096
FOUND = "query long, query_id long, row long, vec_id long, score long"


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, q): the usable rows; q holds floor(scale * x)."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    usable = x.isNotNull() & F.col(vec_id).isNotNull() & ~F.coalesce(odd, F.lit(False))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), q.alias("q"))


def postings(rows: pa.Array) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """dimension -> (rows, weights) of the non-zero components; all rows as a slice."""
    offsets = np.asarray(rows.offsets)
    values = np.asarray(rows.values)[offsets[0]: offsets[-1]]
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(rows)), sizes)
    dim = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    there = np.flatnonzero(values)
    by_dim = there[np.argsort(dim[there], kind="stable")]
    dims, first = np.unique(dim[by_dim], return_index=True)
    out = {}
    for d, part in zip(dims.tolist(), np.split(by_dim, first[1:])):
        out[d] = (slice(None) if len(part) == len(rows) else row[part], values[part])
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids: partition, then order the rest."""
    if len(scores) > k:
        border = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= border)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def searcher(queries: list[tuple[int, int, list[int]]], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    terms = [(query, qid, [(d, w) for d, w in enumerate(q) if w]) for query, qid, q in queries]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            lists = postings(batch.column(2))
            scores = np.empty(len(ids), np.int64)
            for query, _, row in terms:
                scores[:] = 0
                for d, w in row:
                    if d in lists:
                        at, weights = lists[d]
                        scores[at] += w * weights
                other = np.flatnonzero(rows != query)
                at = other[best(ids[other], scores[other], k)]
                found = ids[at], scores[at], rows[at]
                if query in top:
                    found = tuple(np.concatenate(p) for p in zip(top[query], found))
                    at = best(*found[:2], k)
                    found = tuple(p[at] for p in found)
                top[query] = found
        for query, qid, _ in terms:
            if query in top:
                ids, scores, rows = top[query]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(np.full(len(ids), qid)), pa.array(rows), pa.array(ids), pa.array(scores)],
                                                 ["query", "query_id", "row", "vec_id", "score"])

    return search


def exact_topk(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding",
               k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, vector, scale)
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "q"), "vectors")  # numbered once: the rows are told apart by it
    asked = written(rows.where(is_query).orderBy("row"), "queries")
    place = scratch_path(spark, "winners")
    last = None
    while True:  # blocks in row order
        after = asked if last is None else asked.where(F.col("row") > last)
        block = [(r["row"], r["vec_id"], r["q"]) for r in after.orderBy("row").limit(query_block).collect()]
        found = rows.mapInArrow(searcher(block, k), FOUND)
        found.write.mode("append").parquet(place)
        if len(block) < query_block:
            break
        last = block[-1][0]
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    winners = spark.read.schema(FOUND).parquet(place)
    return winners.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
