"""Run the annotation plan over small in-memory documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glosa.functions.text import token_offsets
from glosa.operators.spans import span
from glosa.plans.annotate import annotate_rows


def annotate_texts(spark, texts, base=None, stages=("ruler", "matcher", "custom"), tag="todas"):
    """-> list (per text) of ``Doc`` (text, tokens, offsets, set of (start, end, label))."""
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base_col = None
    if base:
        base_rows = [(i, s, e, lab) for i, spans in base.items() for s, e, lab in spans]
        b = spark.createDataFrame(base_rows, "doc_id long, s int, e int, label string")
        agg = b.groupBy("doc_id").agg(F.collect_list(span(F.col("s"), F.col("e"), F.col("label"))).alias("base"))
        df = df.join(agg, "doc_id", "left").withColumn(
            "base", F.coalesce("base", F.filter(F.array(span(F.lit(0), F.lit(0), "x")), lambda x: F.lit(False))))
        base_col = "base"
    rows_df = annotate_rows(df, base_col=base_col, tag=tag, stages=stages).withColumn("tstart", token_offsets())
    out = rows_df.select("doc_id", "toks", "tstart", "ents").collect()
    by = {r.doc_id: Doc(texts[r.doc_id], list(r.toks), list(r.tstart), {(e.start, e.end, e.label) for e in r.ents})
          for r in out}
    return [by[i] for i in range(len(texts))]


class Doc:
    def __init__(self, text, toks, tstart, ents):
        self.text, self.toks, self.tstart, self.ents = text, toks, tstart, ents

    def span_text(self, s, e):
        return self.text[self.tstart[s]: self.tstart[e - 1] + len(self.toks[e - 1])]
