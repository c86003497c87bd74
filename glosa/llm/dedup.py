"""MinHash near-dedup (operator 7): SuperMinHash, banding, verification, union-find.

Documents with equal sets of five-word shingles form a class; the rest works on
classes.  SuperMinHash signatures of ``BANDS * ROWS`` slots are cut into bands;
classes that share a band share a bucket.  Candidates are confirmed on their
full sets: linked if 100 * intersection >= 75 * union.

No bucket is turned into all its pairs.  The class that meets the most others over
all its buckets is a bucket's centre, so that the text which copies were made from
stands for them.  First each class is held against the greatest centre of its
buckets, which joins groups of copies to stars; then against the other centres of
its buckets, where these lie in different groups; last,
pairs of members of one bucket that still lie in different groups, of which only
those leave the task whose signatures agree on ``LEAST_EQUAL`` slots (at 0.75 the
expectation is 96 of 128, five standard deviations above) and whose sets, cut to
16 bits a shingle, still reach the similarity.  Large buckets are compared in
blocks, block against block.  At similarity 0.75 a pair misses all bands with
probability (1 - 0.75^4)^32 = 5e-6.

Defined results: null and empty texts have an empty set and are linked with
nothing; repeated rows and exact copies are one class, each row gets its
component; an empty table gives an empty result; a null id never names a
component unless all ids of it are null; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import blank, written
from glosa.llm.components import components
from glosa.llm.shingles import mix64, same_share, set_digest, shingle_set, superminhash

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
LEAST_EQUAL = 72
PERCENT = 75
BLOCK = 2048  # members of a bucket that one task holds against each other
STAR = 250  # members held against one copy of a centre
SIGNED = "struct<n: long, digest: binary, bands: array<long>, sketch: binary>"


def _sign(texts: pa.Array) -> pa.Array:
    sets = [shingle_set(t) for t in texts.to_pylist()]
    sig = superminhash(sets, SLOTS)
    with np.errstate(over="ignore"):
        keys = np.zeros((len(sets), BANDS), np.uint64)
        for r in range(ROWS):
            keys = mix64(keys * np.uint64(31) + sig[:, r::ROWS])
        keys = mix64(keys + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    sketch = sig.astype(np.uint8)  # the low byte of each slot
    full = [bool(len(s)) for s in sets]
    return pa.StructArray.from_arrays([
        pa.array([len(s) for s in sets], pa.int64()),
        pa.array([set_digest(s) if k else None for s, k in zip(sets, full)], pa.binary()),
        pa.array([list(r) if k else None for r, k in zip(keys.tolist(), full)], pa.list_(pa.int64())),
        pa.array([s.tobytes() if k else None for s, k in zip(sketch, full)], pa.binary())],
        ["n", "digest", "bands", "sketch"])


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, n, digest, bands, sketch) per row, written; (id, h) finds the text again."""
    sign = F.arrow_udf(_sign, SIGNED).asNondeterministic()
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(blank(text)).alias("h"), sign(blank(text)).alias("s"))
    return written(rows.select("id", "h", "s.*"), "signed")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (a, salt), the row of ``a`` itself (b null) first: keeps the b that are linked."""
    centre, now = None, None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for a, salt, b, text in zip(*(c.to_pylist() for c in batch.columns)):
            if b is None:
                centre, now = shingle_set(text), (a, salt)
                continue
            assert now == (a, salt)
            own = shingle_set(text)
            if PERCENT * (len(own) + len(centre)) > (100 + PERCENT) * min(len(own), len(centre)):
                continue  # sizes too far apart
            common = same_share(own, centre)
            if 100 * common >= PERCENT * (len(own) + len(centre) - common):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links.  A class in many pairs as ``a`` is dealt out
    by salt, ``STAR`` partners to a copy of its text."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("salts"))
    pairs = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b")
    partners = pairs.join(texts, pairs["b"] == texts["cid"]).select("a", "salt", "b", "text")
    centres = pairs.select("a", "salt").distinct().join(texts, F.col("a") == texts["cid"]).select(
        "a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = partners.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return written(rows.mapInArrow(_confirm, "a long, b long"), "links")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(left, right) rows of each (band, x, y): what block x holds against block y."""
    key, held = None, []

    def sides() -> tuple[list, list]:
        left = [r for r in held if r[3] == key[1]]
        return left, left if key[1] == key[2] else [r for r in held if r[3] == key[2]]

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:3] != key:
                if held:
                    yield sides()
                key, held = r[:3], []
            held.append(r)
    if held:
        yield sides()


def _near(left: list, right: list) -> Iterator[tuple[int, np.ndarray]]:
    """For each left row the right rows of other groups whose signatures agree on enough slots
    and whose sizes allow the similarity."""
    sketch = np.frombuffer(b"".join(r[6] for r in right), np.uint8).reshape(-1, SLOTS)
    group = np.array([r[5] for r in right])
    size = np.array([r[7] for r in right])
    for i, r in enumerate(left):
        at = np.flatnonzero((group != r[5]) & (100 * np.minimum(size, r[7]) >= PERCENT * np.maximum(size, r[7])))
        if left is right:
            at = at[at > i]
        if len(at):
            at = at[(sketch[at] == np.frombuffer(r[6], np.uint8)).sum(axis=1) >= LEAST_EQUAL]
        yield i, at


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are near any other: a row for a member, not for a pair."""
    schema = None

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal schema
        for b in batches:
            schema = b.schema
            yield b

    for left, right in _grouped(watched()):
        keep = {}
        for i, at in _near(left, right):
            if len(at):
                keep[left[i][4]] = left[i]
                keep.update((right[j][4], right[j]) for j in at.tolist())
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*keep.values()), schema)], schema=schema)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different groups that may be links by their sets cut to 16 bits: a cut makes
    unequal shingles equal now and then but never the reverse, so no link is lost."""
    for left, right in _grouped(batches):
        found: list[tuple[int, int]] = []
        sets = [np.frombuffer(r[8], np.uint16) for r in right]
        for i, at in _near(left, right):
            if not len(at):
                continue
            mark = np.zeros(1 << 16, bool)
            mark[np.frombuffer(left[i][8], np.uint16)] = True
            near = at.tolist()
            starts = np.cumsum([0] + [len(sets[j]) for j in near[:-1]])
            common = np.add.reduceat(mark[np.concatenate([sets[j] for j in near])].astype(np.int64), starts)
            total = left[i][7] + np.array([right[j][7] for j in near])
            common = np.minimum(common, total // 2)
            found += [(left[i][4], right[near[k]][4]) for k in np.flatnonzero(100 * common >= PERCENT * (total - common))]
        yield _links(found)


def _short_set(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(t).astype(np.uint16).tobytes() for t in texts.to_pylist()], pa.binary())


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    found = [(min(p), max(p)) for p in found]
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])


def label(rows: DataFrame, groups: DataFrame, node: str, out: str) -> DataFrame:
    g = groups.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    return rows.join(g, F.col(node) == F.col("__n"), "left").withColumn(out, F.coalesce("__c", F.col(node))).drop("__n", "__c")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row, plus ``__h`` (which
    with the id finds the row's text again)."""
    rows = signed(docs, doc_id, text)
    classes = written(rows.where("n > 0").groupBy("digest").agg(
        F.min(F.struct("id", "h")).alias("rep"), F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
        .select("digest", "rep", "least", "bands", "sketch", "n", F.monotonically_increasing_id().alias("cid")), "classes")
    members = classes.select("cid", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = written(members.join(buckets, "band"), "members")  # of buckets with company
    degree = members.groupBy(F.col("cid").alias("__cid")).agg(F.sum("k").alias("degree"))
    members = written(members.join(degree, F.col("cid") == F.col("__cid")).select("band", "cid", "degree"), "members")
    centres = members.groupBy(F.col("band").alias("__band")).agg(F.max(F.struct("degree", "cid")).alias("c"))
    stars = members.join(centres, F.col("band") == F.col("__band")).where("cid <> c.cid")
    stars = written(stars.groupBy(F.col("c.cid").alias("a"), F.col("cid").alias("b")).agg(F.first("c.degree").alias("degree")), "candidates")
    # the texts of the classes in question, found again in the documents
    asked = members.select("cid").distinct().join(classes.select("cid", "rep.*"), "cid").select(
        "cid", F.col("id").alias("__id"), F.col("h").alias("__h"))
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(blank(text)).alias("h"), blank(text).alias("text"))
    texts = written(source.join(asked, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h")))
                    .select("cid", "text").dropDuplicates(["cid"]), "texts")
    first = written(stars.groupBy("b").agg(F.max(F.struct("degree", "a")).alias("c")).select("c.a", "b"), "first-pairs")
    links = confirmed(first, texts)
    groups = written(components(links), "groups")
    apart = label(label(stars, groups, "a", "ca"), groups, "b", "cb").where("ca <> cb").select("a", "b")
    apart = written(apart.join(first.withColumnsRenamed({"a": "fa", "b": "fb"}), (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")), "left_anti"), "apart")
    tried = apart
    links = links.unionByName(confirmed(apart, texts))
    groups = written(components(links), "groups")
    # buckets that still hold several groups: their members, in blocks
    held = label(members.select("band", "cid"), groups, "cid", "group")
    mixed = held.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    blocks = F.ceil(F.col("k") / BLOCK)
    held = held.join(mixed.select("band", blocks.alias("blocks")), "band").withColumn("mine", F.pmod(F.xxhash64("cid"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    held = held.withColumn("other", other).select(
        "band", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "cid", "group")
    cols = ["band", "x", "y", "mine", "cid", "group", "sketch", "n"]
    held = held.join(classes.select("cid", "sketch", "n"), "cid").select(*cols)
    held = held.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    held = written(held.mapInArrow(_involved, held.schema), "involved")
    short = F.arrow_udf(_short_set, "binary").asNondeterministic()
    short = texts.join(held.select("cid").distinct(), "cid").select("cid", short("text").alias("short"))
    held = held.join(short, "cid").select(*cols, "short").repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    across = held.mapInArrow(_across, "a long, b long").distinct()
    known = tried.unionByName(first)
    across = written(across.join(known.withColumnsRenamed({"a": "ka", "b": "kb"}), (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left_anti"), "across")
    links = links.unionByName(confirmed(across, texts))
    groups = written(components(links), "groups")
    named = written(label(classes.select("digest", "cid", F.col("least").alias("id")), groups, "cid", "group"), "class-groups")
    names = written(named.groupBy("group").agg(F.min("id").alias("component_id")), "group-names")  # so that the join can split a large group
    named = written(named.select("digest", "group").join(names, "group").select(F.col("digest").alias("__d"), "component_id"), "named")
    out = rows.join(named, F.col("digest") == F.col("__d"), "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), F.col("h").alias("__h"))


def dedup_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return near_duplicates(docs, doc_id, text).drop("__h")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one with the smallest id, once."""
    kept = near_duplicates(docs, doc_id, text).where("kept").select(F.col("doc_id").alias("__kid"), F.col("__h").alias("__kh")).distinct()
    rows = docs.withColumn("__rh", F.xxhash64(blank(text)))
    rows = rows.join(kept, F.col(doc_id).eqNullSafe(F.col("__kid")) & (F.col("__rh") == F.col("__kh")), "left_semi")
    return rows.dropDuplicates([doc_id, "__rh"]).drop("__rh").select(docs.columns)
