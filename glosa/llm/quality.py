"""Quality rules (operator 9): document rules, then host-level verdicts.

Each document is measured and tested by itself, rule by rule (``RULES``); failures are summed by host
(any column, ``source`` for documents) and rule; each host's failure rate by a rule is shrunk
towards that rule's mean by a beta prior of its own, fitted to all hosts by moments; hosts whose
shrunk rate is above ``max_rate`` by any rule are rejected, and the host verdicts are
joined back to the documents.  A document stays if it passes all rules and its host is not rejected.  A host with few documents thus needs many more
failures than its share before its good documents go with it.

Defined results: null or empty text has no words (``base_failed``: fewer than
``min_words``); null is a host of its own; repeated rows count as often as they
occur; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosa.llm.common import blank, broadcast_if_small, written

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_RATE = 0.5  # of a host's shrunk failure rate
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
MEASURES = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long>"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a ``width``-word window occurring at least twice.  Windows are
    numbered exactly, by numbering pairs of shorter windows; no hashes."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    single = np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))
    size, ids = 1, single
    while size < width:
        step = min(size, width - size)
        pairs = ids[: len(ids) - step] * len(words) + ids[step:]
        _, ids = np.unique(pairs, return_inverse=True)
        size += step
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode()
    words = data.split()
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(data.count(c) for c in SPACES), sum(data.count(c) for c in SYMBOLS),
            dup, repeated_words(words))


def measures(text: str | Column) -> Column:
    """Struct column of the five measures of a text column (Arrow batches)."""

    @F.arrow_udf(MEASURES)
    def _measures(texts: pa.Array) -> pa.Array:
        cols = list(zip(*map(measure, texts.to_pylist()))) or [()] * 5
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.int64()) for c in cols],
            ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return _measures.asNondeterministic()(blank(text))  # not to be run again by pushed filters


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"])


#: Each rule by itself; a document that fails one goes.  "base" comes first and is reported.
RULES: dict[str, Callable[[Column], Column]] = {
    "base": base_failed,
    "symbols": lambda m: 10 * m["n_symbols"] > m["word_chars"],  # over a tenth of what stands in words
    "dup_lines": lambda m: 10 * m["n_dup_lines"] > m["n_words"],  # a repeated line for less than ten words
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
}


def _strength(k: int, n: float, fails: float, n2: float, f2: float) -> tuple[float, float]:
    """(mean, a + b) of a rule's prior: the moments of a beta-binomial, both weighted by the hosts' sizes.  Mean m = all
    failures / all documents; what the squared distances of the hosts' rates from m, each
    times n, exceed binomial noise by gives the correlation rho within a host, and 1 / rho - 1
    the strength a + b (between 1 and 1e6; hosts that do not differ get the strongest prior,
    and where no two documents can tell, one host or one document each, the weakest)."""
    m = fails / n
    pairs = n - n2 / n - (k - 1)
    if not (0 < m < 1 and pairs > 0.1):  # at least 1/3 when it is not 0
        return m, 1.0
    rho = ((f2 - m * fails) / (m * (1 - m)) - (k - 1)) / pairs
    return m, min(max(1 / max(rho, 1e-12) - 1, 1.0), 1e6)


def host_verdicts(tested: DataFrame, host: str = "source", failed: str | list[str] = "base_failed",
                  max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, fails, rate, rejected): one row per host; for a list of ``failed`` columns, one per rule, ``fails`` and
    ``rate`` are structs of the rules' figures.  Each rule has a prior of its own, and a host that is above ``max_rate``
    by any rule is rejected."""
    names = [failed] if isinstance(failed, str) else failed
    hosts = tested.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"f{i}") for i, r in enumerate(names)])
    hosts = written(hosts, "hosts")
    n = F.col("n").cast("double")
    own = [F.col(f"f{i}").cast("double") for i in range(len(names))]
    row = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), *[F.sum(f).alias(f"f{i}") for i, f in enumerate(own)],
                    *[F.sum(f * f / n).alias(f"s{i}") for i, f in enumerate(own)]).first()  # three numbers, two more per rule
    priors = [_strength(row["k"], row["n"], row[f"f{i}"], row["n2"], row[f"s{i}"]) if row["k"] else (0.0, 1.0) for i in range(len(names))]
    rates = [(f + F.lit(m * strength)) / (n + F.lit(strength)) for f, (m, strength) in zip(own, priors)]
    rejected = reduce(Column.__or__, [rate > max_rate for rate in rates])
    if isinstance(failed, str):
        return hosts.select("host", "n", F.col("f0").alias("fails"), rates[0].alias("rate"), rejected.alias("rejected"))
    return hosts.select("host", "n", F.struct(*[F.col(f"f{i}").alias(r) for i, r in enumerate(names)]).alias("fails"),
                        F.struct(*[rate.alias(r) for r, rate in zip(names, rates)]).alias("rate"), rejected.alias("rejected"))


def _flags(m: Column) -> list[Column]:
    return [rule(m).alias(f"__{name}") for name, rule in RULES.items()]


FLAGS = [f"__{name}" for name in RULES]


def _passed() -> Column:
    return ~reduce(Column.__or__, [F.col(f) for f in FLAGS])


def bad_hosts(tested: DataFrame, host: str, max_rate: float) -> DataFrame:
    """(__bad_host, __bad): the rejected hosts of rows with a flag per rule."""
    return written(host_verdicts(tested, host, FLAGS, max_rate).where("rejected").select(
        F.col("host").alias("__bad_host"), F.lit(True).alias("__bad")), "bad-hosts")


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                   max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, the five measures, base_failed, kept), one row per input row."""
    tested = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("__host"), measures(text).alias("__m")).select(
        "doc_id", "__host", "__m.*", *_flags(F.col("__m")))
    tested = written(tested, "quality")  # narrow: no texts
    out = tested.join(broadcast_if_small(bad_hosts(tested, "__host", max_rate)), F.col("__host").eqNullSafe(F.col("__bad_host")), "left")
    out = out.withColumn("base_failed", F.col("__base")).withColumn("kept", _passed() & F.col("__bad").isNull())
    return out.drop("__host", "__bad_host", "__bad", *FLAGS)


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged.  The measures are taken twice (for the
    hosts, then for the rows) rather than moving or storing the texts."""
    def tested(df: DataFrame) -> DataFrame:
        return df.withColumn("__m", measures(text)).select(*df.columns, *_flags(F.col("__m")))

    bad = bad_hosts(tested(docs.select(text, host)), host, max_rate)
    out = tested(docs).where(_passed()).join(broadcast_if_small(bad), F.col(host).eqNullSafe(F.col("__bad_host")), "left_anti")
    return out.select(docs.columns)
