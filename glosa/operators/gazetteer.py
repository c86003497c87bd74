"""A user's gazetteer as a table (J5, R10): phrases found in documents by joins.

A gazetteer has rows (phrase, label); it may be as long as a table may be.  Phrases are cut into tokens as
documents are (F3) and compared in lower case.

1. Document tokens meet the gazetteer's first tokens; each first token knows how many tokens its phrases have,
   so a token without phrases leaves no candidate and others leave one per length, not one per phrase.
2. Candidates, as whole token runs, meet the phrases by equality: a frequent first token with a
   million phrases costs no more than one with ten.

Both joins are plain equi-joins: a small gazetteer is broadcast after its rows are counted, a large one is shuffled
and its hot tokens are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.functions.text import GAP_TOKEN_REGEX, keep

BROADCAST_ROWS = 100_000
JOINT = "\u0001"


def lower_tokens(text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(GAP_TOKEN_REGEX), 2), F.lower)


def compiled(gazetteer: DataFrame, phrase: str = "phrase", label: str = "label") -> DataFrame:
    """(key, first, size, label): distinct phrases as lower-case token runs; empty phrases match nothing."""
    rows = gazetteer.select(lower_tokens(phrase).alias("w"), F.col(label).alias("label")).where(F.size("w") > 0)
    return rows.select(F.array_join("w", JOINT).alias("key"), F.get("w", F.lit(0)).alias("first"), F.size("w").alias("size"), "label").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def find_phrases(docs: DataFrame, gazetteer: DataFrame, phrase: str = "phrase", label: str = "label", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, tok_start, tok_end, label): every occurrence of every phrase in ``docs`` (doc_id, text), overlaps
    included; O1 (``spans.select_spans_df``) chooses among them.  The gazetteer is checkpointed, so it is cut into tokens once."""
    from glosa.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    phrases = compiled(gazetteer, phrase, label).checkpoint()
    longest = phrases.agg(F.max("size")).first()[0] or 0
    firsts = phrases.groupBy(F.col("first").alias("_first")).agg(F.collect_set("size").alias("_sizes"))  # at most ``longest`` sizes
    rows = docs.select("doc_id", keep(lower_tokens("text")).alias("w"))
    at = rows.select("doc_id", F.posexplode(F.transform("w", lambda t, i: F.struct(t.alias("t"), F.slice("w", i + 1, longest).alias("run")))).alias("i", "x"))
    at = at.select("doc_id", "i", F.col("x.t").alias("t"), F.col("x.run").alias("run"))
    at = at.join(_small(firsts, broadcast_rows), F.col("t") == F.col("_first"))
    at = at.select("doc_id", "i", "run", F.explode("_sizes").alias("size")).where(F.size("run") >= F.col("size"))
    at = at.select("doc_id", "i", "size", F.array_join(F.slice("run", 1, F.col("size")), JOINT).alias("run"))
    names = phrases.select(F.col("key").alias("_key"), "label")
    found = at.join(_small(names, broadcast_rows), F.col("run") == F.col("_key"))
    return found.select("doc_id", F.col("i").cast("int").alias("tok_start"), (F.col("i") + F.col("size")).cast("int").alias("tok_end"), "label")
