"""Span algebra on per-document span arrays.

A span is ``struct<start:int, end:int, label:string, prio:bigint>`` -- token
indices, half-open, plus an input-order key used to break ties.  Every
function here maps array columns to array columns inside one document row,
so none of them shuffles.

* ``select_spans``   O1 greedy interval selection (longest first).
* ``drop_overlapping`` J3/M3/M8 interval anti-join inside a document.
* ``class_matches``  sequence patterns over one class character per token.
* ``explode_spans``  array -> long table at the end of a job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDX_DIGITS = 9  # token index width inside encoded class strings (up to 10^9 tokens)
SPAN_DDL = "array<struct<start:int,end:int,label:string,prio:bigint>>"


def span(start: Column, end: Column, label: str | Column, prio: Column | int = 0) -> Column:
    lab = label if isinstance(label, Column) else F.lit(label)
    pr = prio if isinstance(prio, Column) else F.lit(prio)
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        lab.cast("string").alias("label"),
        pr.cast("long").alias("prio"),
    )


def non_null(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def with_prio(arr: Column, base: int | Column) -> Column:
    """Renumber ``prio`` as ``base + position`` (input order inside ``arr``)."""
    b = base if isinstance(base, Column) else F.lit(base)
    return F.transform(arr, lambda x, i: span(x["start"], x["end"], x["label"], b + i))


def _cmp(a: Column, b: Column) -> Column:
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))


def _length_order(a: Column, b: Column, start_desc: bool) -> Column:
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    by_start = _cmp(b["start"], a["start"]) if start_desc else _cmp(a["start"], b["start"])
    return (
        F.when(la != lb, _cmp(lb, la))
        .when(a["start"] != b["start"], by_start)
        .otherwise(_cmp(a["prio"], b["prio"]))
    )


def _covers(y: Column, p: Column) -> Column:
    return (y["start"] <= p) & (p < y["end"])


def select_spans(arr: Column, rejected_block: bool = True, start_desc: bool = False) -> Column:
    """O1 greedy interval selection; result sorted by start.

    Order: length desc, start asc (``start_desc`` flips it), then ``prio``.
    A span is kept iff neither its first nor its last token is marked.
    ``rejected_block=True``: every span marks its tokens, kept or not -- so
    "kept" is a closed predicate (no earlier span covers my first/last token)
    and needs no fold.  ``rejected_block=False``: only kept spans mark, which
    is a sequential fold (``aggregate``) over the sorted array.
    """
    clean = F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x["end"] > x["start"])))
    if rejected_block:
        def earlier(y: Column, x: Column) -> Column:
            return _length_order(y, x, start_desc) < 0

        # for short arrays inside lambdas; whole documents go through select_spans_df
        kept = F.filter(
            clean,
            lambda x: ~F.exists(
                clean,
                lambda y: earlier(y, x) & (_covers(y, x["start"]) | _covers(y, x["end"] - 1)),
            ),
        )
    else:
        ordered = F.array_sort(clean, lambda a, b: _length_order(a, b, start_desc))
        kept = F.aggregate(
            ordered,
            F.filter(clean, lambda x: F.lit(False)),
            lambda acc, x: F.when(
                F.exists(acc, lambda y: _covers(y, x["start"]) | _covers(y, x["end"] - 1)), acc
            ).otherwise(F.concat(acc, F.array(x))),
        )
    return F.array_sort(kept, lambda a, b: _cmp(a["start"], b["start"]))


def greedy(spans: list[dict], rejected_block: bool, start_desc: bool) -> list[dict]:
    """O1 over one document's spans: marks on a byte per token, so the work follows
    the spans' lengths and not the square of their number."""
    clean = {(x["start"], x["end"], x["label"], x["prio"]) for x in spans if x is not None and x["end"] > x["start"]}
    turn = -1 if start_desc else 1
    marked = bytearray(max((e for _, e, _, _ in clean), default=0))
    kept = []
    for s, e, label, prio in sorted(clean, key=lambda x: (x[0] - x[1], turn * x[0], x[3], x[2] or "")):
        free = not (marked[s] or marked[e - 1])
        if free:
            kept.append({"start": s, "end": e, "label": label, "prio": prio})
        if free or rejected_block:
            marked[s:e] = b"\1" * (e - s)
    return sorted(kept, key=lambda x: x["start"])


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("prio", pa.int64())])
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                   T.StructField("label", T.StringType()), T.StructField("prio", T.LongType())]))


def greedy_choice(items: pa.StructArray, doc: np.ndarray, rejected_block: np.ndarray, start_desc: np.ndarray) -> np.ndarray:
    """``greedy`` over the spans of many documents: which of ``items`` are kept, by document and start.  The orders are
    put by columns for all at once; of equal spans the first blocks the others.  The flags are one per document."""
    start, end, prio = (items.field(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end", "prio"))
    names = items.field("label").fill_null("").dictionary_encode()
    rank = np.argsort(np.argsort(np.array([*names.dictionary.to_pylist(), ""], object)))
    label = rank[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(items) else start
    whole = np.flatnonzero(items.is_valid().to_numpy(zero_copy_only=False) & (end > start))
    place = whole[np.lexsort((label[whole], prio[whole], np.where(start_desc[doc[whole]], -1, 1) * start[whole], (start - end)[whole], doc[whole]))]
    size = np.zeros(len(rejected_block), np.int64)
    np.maximum.at(size, doc[whole], end[whole])
    size, blocks, now, kept = size.tolist(), rejected_block.tolist(), -1, []
    for k, d, s, e in zip(place.tolist(), doc[place].tolist(), start[place].tolist(), end[place].tolist()):
        if d != now:
            now, marked, block = d, bytearray(size[d]), blocks[d]
        free = not (marked[s] or marked[e - 1])
        if free:
            kept.append(k)
        if free or block:
            marked[s:e] = b"\1" * (e - s)
    found = np.array(kept, np.int64)
    return found[np.lexsort((start[found], doc[found]))]


@F.arrow_udf(SPANS)
def greedy_spans(spans: pa.Array, rejected_block: pa.Array, start_desc: pa.Array) -> pa.Array:
    doc = np.repeat(np.arange(len(spans)), pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    items = pc.list_flatten(spans)
    kept = greedy_choice(items, doc, *(x.to_numpy(zero_copy_only=False) for x in (rejected_block, start_desc)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(spans)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items.take(pa.array(kept)).cast(SPAN))


def select_spans_df(df: DataFrame, name: str, out: str, rejected_block: bool = True,
                    start_desc: bool = False) -> DataFrame:
    """``select_spans`` over the array column ``name`` into column ``out`` for any
    number of spans per document."""
    from glosa.functions.text import keep

    return df.withColumn(out, keep(greedy_spans(F.col(name), F.lit(rejected_block), F.lit(start_desc))))


def with_prio_col(name: str, base: int = 0) -> Column:
    """``with_prio`` over the array column ``name`` as one SQL expression."""
    return F.expr(
        f"transform(`{name}`, (x, i) -> named_struct('start', x.start, 'end', x.`end`, 'label', x.label, "
        f"'prio', CAST({int(base)} AS BIGINT) + i))"
    )


def drop_overlapping(existing: Column, winners: Column) -> Column:
    """Keep spans of ``existing`` that overlap no span of ``winners`` (true interval overlap)."""
    return F.filter(
        existing,
        lambda e: ~F.exists(winners, lambda m: (m["start"] < e["end"]) & (m["end"] > e["start"])),
    )


# --------------------------------------------------------------------------
# sequence patterns: one class character per token, indices encoded inline
# --------------------------------------------------------------------------


def encode_pattern(pat: str) -> str:
    """Turn a class pattern (atoms: a letter, ',' or a ``[...]`` class) into a
    regex over the encoded class string, where each token is its class
    character followed by its zero-padded index."""
    out, i, idx = [], 0, rf"\d{{{IDX_DIGITS}}}"
    while i < len(pat):
        c = pat[i]
        if c == "[":
            j = pat.index("]", i)
            out.append("(?:" + pat[i : j + 1] + idx + ")")
            i = j + 1
        elif c == "{":
            j = pat.index("}", i)
            out.append(pat[i : j + 1])
            i = j + 1
        elif c.isalpha() or c == ",":
            out.append("(?:" + c + idx + ")")
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def encode_classes(cls: Column) -> Column:
    """``array<string>`` of one class character per token -> encoded string."""
    return F.array_join(
        F.transform(cls, lambda c, i: F.concat(c, F.lpad(i.cast("string"), IDX_DIGITS, "0"))), ""
    )


def matches_from_encoded(encoded: Column, regex: str, label: str | Column, prio: int = 0, group: int = 0) -> Column:
    """All leftmost-greedy matches of ``regex`` as spans (linear, no prefix sums)."""
    ms = F.regexp_extract_all(encoded, F.lit(regex), group)
    first = lambda m: F.substring(m, 2, IDX_DIGITS).cast("int")
    last = lambda m: F.substring(m, -IDX_DIGITS, IDX_DIGITS).cast("int")
    return F.transform(ms, lambda m: span(first(m), last(m) + 1, label, prio))


def class_matches(cls: Column, pattern: str, label: str | Column, prio: int = 0) -> Column:
    return matches_from_encoded(encode_classes(cls), encode_pattern(pattern), label, prio)


# --------------------------------------------------------------------------
# long form
# --------------------------------------------------------------------------


def explode_spans(df: DataFrame, arr: str, keep: list[str], char_offsets: bool = True) -> DataFrame:
    """One row per span; adds char offsets from the ``tstart``/``toks`` arrays."""
    cols = [F.col(c) for c in keep]
    if char_offsets:
        cols += [F.col("tstart"), F.col("toks")]
    out = df.select(*cols, F.explode(arr).alias("_s")).select(
        *keep,
        F.col("_s.start").alias("start"),
        F.col("_s.end").alias("end"),
        F.col("_s.label").alias("label"),
        *(
            [
                F.get(F.col("tstart"), F.col("_s.start")).alias("start_char"),
                (
                    F.get(F.col("tstart"), F.col("_s.end") - 1)
                    + F.length(F.get(F.col("toks"), F.col("_s.end") - 1))
                ).alias("end_char"),
            ]
            if char_offsets
            else []
        ),
    )
    return out
