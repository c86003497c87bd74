"""Operator 10 against a plain sort and water-filling."""

import random

import pytest
from brute import mixed
from pyspark.sql import functions as F

from glosa.llm import mixing


def corpus(seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "tiny", "Z", "hot", "empty"]
    rows = []
    for i in range(400):
        s = "hot" if rng.random() < 0.4 else rng.choice(sources[:6])
        n = rng.randint(0, 60) if s != "tiny" else rng.randint(0, 3)
        rows.append((i, s, n))
    return rows + [(400, "empty", 0), (401, "hot", 4000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_version(spark, documents, seed):
    rows = corpus(seed)
    quality = {i: random.Random(i).choice([0, 1]) for i, _, _ in rows if i % 3 == 0}
    docs = documents([("w " * n if n else (None if i % 2 else " \n"), s) for i, s, n in rows]).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "target")
    labels = spark.createDataFrame([(i, q) for i, q in quality.items()] + [(9999, 1)], "doc_id long, quality int")
    out = mixing.mix(mixing.with_labels(docs, labels), weight=mixing.label_weight(F.col("__quality")))
    got = {r["doc_id"]: r for r in out.collect()}
    weight = {None: 1.0, 0: 0.5, 1: 2.0}
    want = mixed([(i, s, n, weight[quality.get(i)]) for i, s, n in rows])
    taken, target = {}, {}
    for (i, s, n), (source_size, aim, copies) in zip(rows, want):
        r = got[i]
        assert (r["size"], r["source_size"], r["taken"]) == (n, source_size, n * copies), (i, s)
        assert r["target"] == pytest.approx(aim) and r["taken"] <= 3 * n
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = (aim, max(n, target.get(s, (0, 0))[1]))
    for s, (aim, longest) in target.items():
        assert abs(taken[s] - aim) <= longest / 2
    assert sum(a for a, _ in target.values()) == pytest.approx(sum(n for _, _, n in rows))


def test_rows_of_the_mix(spark, documents):
    docs = documents([("one two three four.", "a"), ("x y", "b"), (None, "b"), ("p q r s t u v w #", None)] * 2)
    plan = {r["doc_id"]: r for r in mixing.mix(docs, weight=mixing.text_weight("text")).collect()}
    out = mixing.mixed_rows(docs, weight=mixing.text_weight("text"))
    assert out.columns == docs.columns
    copies = {}
    for r in out.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert copies == {i: r["taken"] // r["size"] for i, r in plan.items() if r["taken"]}


def test_repeated_rows_and_empty_table(spark, documents):
    docs = documents([("a b c", "s"), ("d e", "s"), ("f", "t")])
    rows = mixing.mix(docs.unionByName(docs)).collect()
    assert len(rows) == 6 and len({(r["doc_id"], r["taken"]) for r in rows}) == 3
    assert mixing.mix(documents([])).collect() == [] == mixing.mixed_rows(documents([])).collect()
    assert all(r["taken"] == 0 for r in mixing.mix(documents([None, ""])).collect())


def test_weights_favour_good_documents(spark, documents):
    docs = documents([("w " * 10, "a" if i % 2 else "b") for i in range(2000)])
    good = F.col("doc_id") % 4 < 2
    out = mixing.mix(docs, weight=F.when(good, 4.0).otherwise(1.0)).where("source_size > 0")
    share = {r["g"]: r["t"] for r in out.groupBy(good.alias("g")).agg(F.sum("taken").alias("t")).collect()}
    assert share[True] > share[False]
