"""Suffix-array dedup (operator 1): remove every byte covered by a 400-byte string that also
starts anywhere else in the corpus, the same document included.

A suffix array over all bytes would move hundreds of bytes per byte of text.
Instead each 400-byte window names one anchor inside itself, the 64-byte gram
with the least hash, so equal windows name equal anchors at equal offsets
whatever surrounds them.  Neighbouring windows share an anchor: a document
becomes runs of windows (about one per 170 bytes), each with its anchor's gram
and its extent, the bytes that its windows cover.

1. Runs whose gram occurs once cannot repeat.  They are dropped by a join on grams.
2. Runs with equal extents repeat as a whole; classes of extents by a digest.
3. Classes that share a gram but differ in extent (edges of repeated passages)
   meet in a group of their gram and are sorted there: a sparse suffix array of
   the anchors.  Comparisons are hash-compared: prefix polynomial hashes and
   binary search find the common extension to the right and to the left, and the
   bytes found equal are verified, in a merge sort.  Merging the sorted runs by
   falling common extension yields each class's best partners (see ``shared``).
4. Groups of more than ``GROUP`` classes are not solved in one task: the range of
   window offsets is halved and rows are regrouped by the bytes that all windows
   of the half share, until groups are small (at the end a half is one window).

Defined results: null text is empty; texts under 400 bytes lose nothing; exact
copies and repeated rows repeat each other, so from 400 bytes on they lose all;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import blank, written
from glosa.llm.shingles import _BYTE, mix64, powers

LENGTH = 400
GRAM = 64
BLOCK = 1 << 20  # windows handled at a time in long texts
GROUP = 4096
_U = np.uint64
_PLACE = _U((1 << 21) - 1)
RUNS = "array<struct<lo: int, hi: int, a: int, key: long, e1: long, e2: long>>"


# --- runs of windows ---------------------------------------------------------------------------

def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i]: polynomial hash of the first i bytes, modulo 2^64."""
    up, _ = powers(len(data) + 1)
    return np.concatenate(([_U(0)], np.cumsum(_BYTE[data] * up[: len(data)])))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def digest(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int, int, int]]:
    """(lo, hi, anchor, gram hash, extent digest) of the maximal runs of window starts with one anchor."""
    out = []
    whole = np.frombuffer(data, np.uint8)
    for base in range(0, len(data) - length + 1, BLOCK):
        part = whole[base: base + BLOCK + length - 1]
        h = prefix_hashes(part)
        n = len(part) - gram + 1
        _, down = powers(len(part) + 1)
        grams = mix64((h[gram:] - h[:n]) * down[:n])
        least = sliding_min((grams & ~_PLACE) | np.arange(n, dtype=np.uint64), length - gram + 1)  # ties: the leftmost
        at = (least & _PLACE).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        los = np.concatenate(([0], cut))
        his = np.concatenate((cut - 1, [len(at) - 1]))
        keys = grams[at[los]].view(np.int64).tolist()
        for lo, hi, a, key in zip((los + base).tolist(), (his + base).tolist(), (at[los] + base).tolist(), keys):
            out.append((lo, hi, a, key, *digest(data[lo: hi + length])))
    return out


_RUN = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("a", pa.int32()),
                           ("key", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64())]))


def runs_udf(length: int, gram: int):
    @F.arrow_udf(RUNS)
    def _runs(texts: pa.Array) -> pa.Array:
        offsets, cols = [0], [[] for _ in range(6)]
        for t in texts.to_pylist():
            found = runs(t.encode(), length, gram)
            for c, v in zip(cols, zip(*found)):
                c.extend(v)
            offsets.append(offsets[-1] + len(found))
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RUN.value_type)], fields=list(_RUN.value_type))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return _runs.asNondeterministic()


# --- a group of extents around equal grams -------------------------------------------------------

class Extent:
    """Bytes around an anchor at ``off``, with hashes of every length to its right and left."""

    __slots__ = ("data", "off", "right", "left")

    def __init__(self, data: bytes, off: int):
        h = prefix_hashes(np.frombuffer(data, np.uint8))
        h = h * powers(off + 1)[1][off]  # relative to the anchor: equal bytes, equal differences
        self.data, self.off = data, off
        self.right = array("Q", (h[off:] - h[off]).tobytes())
        self.left = array("Q", (h[off] - h[off::-1]).tobytes())


def _extension(a: array, b: array) -> int:
    """The greatest length at which two rows of prefix hashes agree, by binary search."""
    lo, hi = 0, min(len(a), len(b)) - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[mid] == b[mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def common_right(x: Extent, y: Extent) -> int:
    n = _extension(x.right, y.right)
    if x.data[x.off: x.off + n] != y.data[y.off: y.off + n]:  # a collision: count the bytes
        n = next(i for i in range(n) if x.data[x.off + i] != y.data[y.off + i])
    return n


def common_left(x: Extent, y: Extent) -> int:
    n = _extension(x.left, y.left)
    if x.data[x.off - n: x.off] != y.data[y.off - n: y.off]:
        n = next(i for i in range(n) if x.data[x.off - 1 - i] != y.data[y.off - 1 - i])
    return n


def _by_right(x: Extent, y: Extent) -> int:
    n = common_right(x, y)
    a, b = x.data[x.off + n: x.off + n + 1], y.data[y.off + n: y.off + n + 1]
    return (a > b) - (a < b)  # the end of the bytes sorts first


def _by_left(x: Extent, y: Extent) -> int:
    n = common_left(x, y)
    a, b = x.data[x.off - n - 1: x.off - n] if x.off > n else b"", y.data[y.off - n - 1: y.off - n] if y.off > n else b""
    return (a > b) - (a < b)


def shared(group: list[Extent], length: int) -> list[list[tuple[int, int]]]:
    """For each extent the ranges (least, greatest) of offsets ``anchor - start`` whose window
    also lies in another extent of the group.

    Extents i and j share the windows at offsets length - R .. L (R, L: their common
    extensions).  In the order of the bytes to the right of the anchor, R is the least
    neighbouring extension between them; joining neighbours by falling R, every pair meets
    at its own R.  Of all partners met so, only the nearest in the order of the bytes to the
    left matter, as farther ones share less to the left; for those that joined before, nearer
    ones were met at a greater R.  Adding the smaller side to the larger makes O(n log n) pairs."""
    n = len(group)
    order = sorted(range(n), key=cmp_to_key(lambda i, j: _by_right(group[i], group[j])))
    by_left = sorted(range(n), key=cmp_to_key(lambda i, j: _by_left(group[i], group[j])))
    rank = [0] * n
    for r, i in enumerate(by_left):
        rank[i] = r
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    side = list(range(n))  # place in ``order`` -> its joined run, by union-find
    ranks = [[rank[i]] for i in order]

    def run_of(p: int) -> int:
        while side[p] != p:
            side[p] = side[side[p]]
            p = side[p]
        return p

    right = [common_right(group[order[p]], group[order[p + 1]]) for p in range(n - 1)]
    for p in sorted(range(n - 1), key=lambda p: -right[p]):
        big, small = run_of(p), run_of(p + 1)
        if len(ranks[big]) < len(ranks[small]):
            big, small = small, big
        into = ranks[big]
        for r in ranks[small]:
            at = bisect_left(into, r)
            for q in into[max(at - 1, 0): at + 1]:
                i, j = by_left[r], by_left[q]
                reach = common_left(group[i], group[j])
                if reach + right[p] >= length:
                    out[i].append((length - right[p], reach))
                    out[j].append((length - right[p], reach))
        for r in ranks[small]:
            insort(into, r)
        ranks[small] = []
        side[small] = big
    return out


def solver(length: int):
    schema = [("id_row", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def spans(rows: list) -> list[tuple[int, int, int]]:
            if len(rows) < 2:
                return []
            found = shared([Extent(r[5], r[4]) for r in rows], length)
            return [(r[1], r[3] + r[4] - hi, r[3] + r[4] - lo) for r, f in zip(rows, found) if r[2] for lo, hi in f]

        def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], [n for n, _ in schema])

        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):  # key, id_row, single, lo, off, bytes
                if r[0] != key:
                    out += spans(held)
                    key, held = r[0], []
                if not held or held[-1][1] != r[1]:  # repeated documents bring their runs again
                    held.append(r)
            yield batch_of(out)
        yield batch_of(spans(held))

    return solve


# --- halving the ranges of groups that are too large ------------------------------------------------

def halves_udf(length: int):
    kind = pa.list_(pa.struct([("g1", pa.int32()), ("g2", pa.int32()), ("lo", pa.int32()), ("cnt", pa.int32()), ("off", pa.int32()),
                               ("key", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()), ("data", pa.binary())]))

    def split(key: int, g1: int, g2: int, lo: int, cnt: int, off: int, data: bytes) -> list[dict]:
        out = []
        mid = (g1 + g2) // 2
        for h1, h2 in ((g1, mid), (mid + 1, g2)):
            p, q = max(h1, off - cnt), min(h2, off)  # offsets of the windows in this half
            if h1 > h2 or p > q:
                continue
            part = data[off - q: off - p + length]
            core = data[off - h1: off + length - h2]  # in every window of the half
            new = digest(f"{key}:{h1}:{h2}:".encode() + core)[0]
            e1, e2 = digest(f"{q}:".encode() + part)
            out.append(dict(g1=h1, g2=h2, lo=lo + off - q, cnt=q - p, off=q, key=new, e1=e1, e2=e2, data=part))
        return out

    @F.arrow_udf("array<struct<g1: int, g2: int, lo: int, cnt: int, off: int, key: long, e1: long, e2: long, data: binary>>")
    def _halves(*cols: pa.Array) -> pa.Array:
        return pa.array([split(*r) for r in zip(*(c.to_pylist() for c in cols))], kind)

    return _halves.asNondeterministic()


def refined(hot: DataFrame, length: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Rows of oversized groups -> (rows of groups within bounds, spans found on the way).
    One row per class and half; a class that more than one row holds repeats as a whole."""
    spark = hot.sparkSession
    cols = ["key", "id_row", "single", "lo", "off", "data"]
    done = spark.createDataFrame([], hot.select(*cols).schema)
    spans = spark.createDataFrame([], "id_row long, lo int, hi int")
    halve = halves_udf(length)
    while hot.limit(1).count():
        parts = hot.select("id_row", "single", F.explode(halve("key", "g1", "g2", "lo", "cnt", "off", "data")).alias("p")).select("id_row", "single", "p.*")
        parts = written(parts, "halves")
        classes = parts.groupBy("key", "e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min("id_row").alias("one"))
        classes = written(classes.select(F.col("key").alias("k"), F.col("e1").alias("c1"), F.col("e2").alias("c2"), "n", "one"), "half-classes")
        sizes = classes.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("most")).where("size > 1 or most > 1")
        same = (F.col("key") == F.col("k")) & (F.col("e1") == F.col("c1")) & (F.col("e2") == F.col("c2"))
        rows = parts.join(classes, same).drop("k").join(sizes.select("k", "size"), F.col("key") == F.col("k"))
        rows = written(rows.drop("k", "c1", "c2"), "half-rows")
        spans = spans.unionByName(rows.where("single and n > 1").select("id_row", "lo", (F.col("lo") + F.col("cnt")).cast("int").alias("hi")))
        rows = rows.where("id_row = one and size > 1").withColumn("single", F.col("single") & (F.col("n") == 1))
        rows = rows.dropDuplicates(["key", "e1", "e2"])
        done = done.unionByName(rows.where(F.col("size") <= group).select(*cols))
        hot = rows.where(F.col("size") > group).select(*cols, "cnt", "g1", "g2")
    return done, spans


# --- the operator -------------------------------------------------------------------------------------

def cut(text: str, spans: list[dict], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what remains) for ranges of window starts."""
    data = text.encode()
    parts, at, removed, count, end = [], 0, 0, 0, -1
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if lo > end:
            parts.append(data[at:lo])
            count += 1
            at = lo
        stop = max(end, hi + length)
        removed += stop - max(at, lo)
        at = end = stop
    parts.append(data[at:])
    return removed, count, b"".join(parts)


def cut_udf(length: int):
    @F.arrow_udf("struct<n_removed: long, n_spans: long, kept: binary>")
    def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = [cut(t, s, length) if s else (None, None, None) for t, s in zip(texts.to_pylist(), spans.to_pylist())]
        cols = list(zip(*out)) or [()] * 3
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))],
                                          ["n_removed", "n_spans", "kept"])

    return _cut.asNondeterministic()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary), one row per input row."""
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(blank(text)).alias("h"), blank(text).alias("text"))
    found = source.where(F.octet_length("text") >= length).select("id", "h", F.explode(runs_udf(length, gram)("text")).alias("r"))
    found = written(found.select("id", "h", "r.*"), "runs")
    keys = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k")), "grams")
    found = written(found.join(keys, F.col("key") == F.col("k"), "left_semi"), "repeated-grams")
    classes = found.groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "lo", "hi", "a", "key")).alias("rep"))
    classes = written(classes.withColumn("id_row", F.monotonically_increasing_id()), "classes")
    twice = classes.where("n > 1").select(F.col("e1").alias("c1"), F.col("e2").alias("c2"))
    spans = found.join(twice, (F.col("e1") == F.col("c1")) & (F.col("e2") == F.col("c2")), "left_semi").select("id", "h", "lo", "hi")
    # grams with several extents: one occurrence of each class, with its bytes
    sizes = written(classes.groupBy(F.col("rep.key").alias("k")).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "groups")
    asked = classes.select("id_row", "n", "rep.*").join(sizes, F.col("key") == F.col("k")).withColumn("hot", F.col("size") > group)
    asked = written(asked.select("id", "h", "id_row", (F.col("n") == 1).alias("single"), "key", "lo", "hi", "a", "hot"), "edges")
    by_doc = asked.groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(
        F.collect_list(F.struct("id_row", "single", "key", "lo", "hi", "a", "hot")).alias("runs"))  # runs of one text
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    edges = source.join(by_doc, same).select(F.col("text").cast("binary").alias("data"), F.explode("runs").alias("r")).select(
        "r.*", F.expr(f"substring(data, r.lo + 1, r.hi - r.lo + {length})").alias("data")).select(
        "key", "id_row", "single", "lo", (F.col("a") - F.col("lo")).alias("off"), "data", (F.col("hi") - F.col("lo")).alias("cnt"), "hot")
    cols = ["key", "id_row", "single", "lo", "off", "data"]
    edges, on_the_way = written(edges, "edge-bytes"), None
    cold = edges.where(~F.col("hot")).select(*cols)
    if sizes.where(F.col("size") > group).limit(1).count():
        hot = edges.where("hot").dropDuplicates(["id_row"]).withColumn("g1", F.lit(0)).withColumn("g2", F.lit(length - gram))
        more, on_the_way = refined(written(hot.drop("hot"), "oversized"), length, group)
        cold = cold.unionByName(more)
    cold = cold.repartition("key").sortWithinPartitions("key", "id_row")
    partial = cold.mapInArrow(solver(length), "id_row long, lo int, hi int")
    partial = partial if on_the_way is None else partial.unionByName(on_the_way)
    partial = partial.join(asked.select(F.col("id_row").alias("x"), "id", "h"), F.col("id_row") == F.col("x")).select("id", "h", "lo", "hi")
    spans = spans.unionByName(partial).groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans"))  # of one text: bounded by its length
    spans = written(spans, "spans")
    out = source.join(spans, same, "left")
    out = out.withColumn("c", cut_udf(length)(F.when(F.col("spans").isNotNull(), F.col("text")), F.col("spans")))
    return out.select(F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"),
                      F.coalesce("c.n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("c.n_spans", F.lit(0)).cast("long").alias("n_spans"),
                      F.coalesce("c.kept", F.col("text").cast("binary")).alias("kept"))


def repeats_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    out = remove_repeats(docs, doc_id, text, **how)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
