"""Mixing sources to target weights (operator 10): Efraimidis-Spirakis sampling.

Targets: sources in code-point order (null last) take the weights in turn and
share all sizes; a target stops at ``max_epochs`` times its source's size and
the excess is shared again by weight until none is above.  A source's target is
filled by whole epochs of all its documents first; the remainder goes to whole
documents in the order of exponential keys E / w (w: the document's quality
weight), by prefix sums up to the budget, the document at the border being taken
if that comes nearer the budget.

Order within a source is not one sorted task: keys fall into ``BINS`` ranges, the
ranges' sizes are prefix-summed per source, and only the rows of the one range
that holds a source's border are sorted.  All rows then compare with the border.

Keys are a digest of id and seed, so reruns agree; ties go to the smaller id,
then the smaller size (null first).  Defined results: null or empty text has size 0 and takes
nothing; null is a source of its own; repeated rows (same id, source and size)
share a place in the order and are taken alike; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosa.llm.common import WORD, blank, broadcast_if_small, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BINS = 1024
SEED = "mix-1"


def n_words(text: str | Column) -> Column:
    return F.regexp_count(blank(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Shared out by rounds: each caps the sources whose share reaches their stop; one
    row (left over, weights left) reaches the driver per round."""
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1  # one row per source, not per document
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights)).cast("int") + 1)
    state = written(sizes.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(max_epochs))), "sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    capped = F.lit(False)
    share = 0.0
    while True:
        left = state.agg(F.sum(F.when(capped, F.col("stop")).otherwise(0.0)).alias("stopped"),
                         F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weights")).first()
        if not left["weights"]:
            break
        share = (total - left["stopped"]) / left["weights"]
        over = F.col("weight") * F.lit(share) > F.col("stop")
        if not state.where(over & ~capped).limit(1).count():
            break
        capped = capped | over  # shares only rise: a capped source stays capped
        state = state.withColumn("capped", capped)
        capped = F.col("capped")
        state = written(state.select("source", "source_size", "weight", "stop", "capped"), "sources")
    return state.select("source", "source_size", F.when(capped, F.col("stop")).otherwise(F.col("weight") * F.lit(share)).alias("target"))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / w, u in (0, 1) from a digest of seed and id: the smallest keys are a
    sample without replacement by weight."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)
    return -F.ln(u) / weight


def keyed(docs: DataFrame, doc_id: str, source: str, size: Column, weight: Column | None, seed: str) -> DataFrame:
    """``docs`` plus ``__source``, ``__size``, ``__order`` (key, id, size) and ``__bin``."""
    key = exponential_key(F.col(doc_id), F.lit(1.0) if weight is None else weight, seed)
    bin_of = F.least(F.floor((1 - F.exp(-F.col("__key"))) * BINS), F.lit(BINS - 1)).cast("int")  # spreads keys over 0..BINS-1
    return docs.withColumns({"__source": F.col(source), "__size": size, "__key": key}).withColumns(
        {"__order": F.struct(F.col("__key").alias("key"), F.col(doc_id).alias("id"), F.col("__size").alias("size")), "__bin": bin_of}).drop("__key")


def plan(sized: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """One row per source: (__s, source_size, target, epochs, border_bin, border).  Beyond its
    epochs a source gives its documents up to ``border`` in key order: those of the ranges
    before ``border_bin`` (known from the ranges' sizes alone) and some of that range."""
    bins = written(sized.groupBy("__source", "__bin").agg(F.sum("__size").alias("bin_size")), "mix-bins")
    aims = targets(bins.groupBy(F.col("__source").alias("source")).agg(F.sum("bin_size").alias("source_size")), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = written(aims.withColumn("epochs", epochs).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "__s"), "mix-targets")
    same = F.col("__source").eqNullSafe(F.col("__s"))
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = bins.withColumn("before", before).join(broadcast_if_small(aims), same).where(F.col("before") <= F.col("budget"))
    border = written(border.groupBy("__s", "budget").agg(F.max(F.struct(F.col("__bin").alias("bin"), "before")).alias("b")).select(
        "__s", "budget", "b.bin", "b.before"), "mix-border-bins")
    near = sized.join(broadcast_if_small(border), same & (F.col("__bin") == F.col("bin"))).groupBy("__s", "budget", "before", "__order").agg(
        F.sum("__size").alias("size"))  # rows of equal id and size stand or fall together
    so_far = F.col("before") + F.coalesce(F.sum("size").over(
        Window.partitionBy("__s").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = near.withColumn("so_far", so_far).where((F.col("so_far") + F.col("size") / 2 <= F.col("budget")) & (F.col("budget") > 0)).groupBy(
        F.col("__s").alias("__c")).agg(F.max("__order").alias("border"))
    return written(aims.join(border.select(F.col("__s").alias("__b"), F.col("bin").alias("border_bin")), F.col("__s").eqNullSafe(F.col("__b")), "left")
                   .join(cut, F.col("__s").eqNullSafe(F.col("__c")), "left")
                   .select("__s", "source_size", "target", "epochs", "budget", "border_bin", "border"), "mix-plan")


def copies(sized: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """``sized`` plus its source's plan and ``__copies``."""
    extra = (F.col("budget") > 0) & ((F.col("__bin") < F.col("border_bin")) | (
        (F.col("__bin") == F.col("border_bin")) & F.col("border").isNotNull() & (F.col("__order") <= F.col("border"))))
    table = plan(sized.select("__source", "__bin", "__size", "__order"), weights, max_epochs)
    return sized.join(broadcast_if_small(table), F.col("__source").eqNullSafe(F.col("__s"))).withColumn(
        "__copies", F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
        size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row; ``weight``: the
    quality weight as an expression over ``docs`` (positive; default 1); ``size``: likewise,
    where the words have been counted before."""
    size = n_words(text) if size is None else size
    sized = keyed(docs, doc_id, source, size, weight, seed).select(
        F.col(doc_id).alias("doc_id"), "__source", "__size", "__order", "__bin")
    sized = written(sized, "mix-sizes")  # narrow: no texts
    return copies(sized, weights, max_epochs).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"))


def mixed_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
               weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its document is taken.  Texts are not
    shuffled: the rows meet their source's plan (one row per source), not each other."""
    sized = keyed(docs, doc_id, source, n_words(text), weight, seed)
    rows = copies(sized, weights, max_epochs).where((F.col("__copies") > 0) & (F.col("__size") > 0))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def label_weight(quality: Column) -> Column:
    """Quality weight of a 0/1 label; 1 without one."""
    return F.when(quality == 1, 2.0).when(quality == 0, 0.5).otherwise(1.0)


def text_weight(text: str | Column) -> Column:
    """Quality weight from the text alone: markup signs at more than a twentieth of the words
    halve it; a text that ends a sentence doubles it."""
    signs = F.regexp_count(blank(text), F.lit(r"[#*$%&|<>]"))
    ended = F.regexp_like(blank(text), F.lit(r"[.!?]\s*$"))
    return F.when(signs * 20 > n_words(text), 0.5).when(ended, 2.0).otherwise(1.0)


def with_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` plus ``__quality``, the highest label of the id (null without one)."""
    best = labels.groupBy(F.col("doc_id").alias("__labelled")).agg(F.max("quality").alias("__quality"))
    return docs.join(best, docs[doc_id] == F.col("__labelled"), "left").drop("__labelled")
