"""Operator 7 against all pairs."""

import random

import numpy as np
import pytest
from brute import components, shingles

from glosa.llm import dedup
from glosa.llm.components import components as grouped
from glosa.llm.shingles import shingle_set, superminhash


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):  # groups: chains of small edits, whose ends may be far apart
        text = [rng.choice(words) for _ in range(rng.randint(4, 90))]
        for _ in range(rng.randint(1, 6)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
    base = [rng.choice(words) for _ in range(60)]
    for _ in range(60):  # one large group around a text that is itself not in the table, and neighbours below the threshold
        text = list(base)
        for _ in range(rng.randint(1, 4)):
            text[rng.randrange(60)] = rng.choice(words)
        out.append(" ".join(text))
    out += [None, "", " \n\t", "A b", "a\x0bB", "a b c d", "a b c d e", "A b c\n d  E", out[0], out[0].upper(), "é " * 30, "  x"]
    return out


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 7)])
def test_against_all_pairs(spark, documents, monkeypatch, seed, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "STAR", 5)
    texts = corpus(seed)
    docs = documents(texts).withColumnRenamed("lang", "component_id").withColumnRenamed("source", "h")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in dedup.dedup_report(docs).collect()}
    want = {i: (n, c, c == i) for i, (n, c) in enumerate(components(list(enumerate(texts))))}
    assert got == want
    left = dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [i for i, w in want.items() if w[2]]


def test_repeated_rows_and_empty_table(spark, documents):
    docs = documents(["a b c d e f", "x y z"])
    rows = dedup.dedup_report(docs.unionByName(docs)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == [(0, 0, True)] * 2 + [(1, 1, True)] * 2
    assert dedup.drop_near_duplicates(docs.unionByName(docs)).count() == 2  # a repeated row stays once
    assert dedup.dedup_report(documents([])).collect() == [] == dedup.drop_near_duplicates(documents([])).collect()


def test_shingles_are_the_same_sets():
    texts = [t for t in corpus(3) if t] + ["long" * 400 + " a b c d e", "x" * 3000]
    a, b = [shingle_set(t) for t in texts], [shingles(t) for t in texts]
    assert [len(x) for x in a] == [len(x) for x in b]
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(np.intersect1d(a[i], a[j])) == len(b[i] & b[j])


def test_superminhash_estimates_and_stops_early():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2 ** 63, 4000, dtype=np.uint64)
    errors = []
    for k in range(60):
        common, own = pool[rng.permutation(4000)[:150]], rng.permutation(4000)
        x, y = np.unique(np.concatenate([common, pool[own[:25]]])), np.unique(np.concatenate([common, pool[own[25:50]]]))
        s = superminhash([x, y, x], 128, chunk=100)
        assert (s[0] == s[2]).all() and (s < (128 << 56)).all()
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        errors.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.042  # plain MinHash: 0.042
    one = superminhash([np.array([7], np.uint64), np.empty(0, np.uint64)], 128)
    assert sorted((one[0] >> np.uint64(56)).tolist()) == list(range(128))  # one element ranks every slot once


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in grouped(df).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert grouped(df.where("a < 0")).collect() == []


def test_null_ids(spark):
    """A null id names a component only where no row of it has one."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "x")
    lone = " ".join(f"v{i}" for i in range(40))
    rows = [(None, text), (5, text), (9, near), (None, near), (None, lone), (None, lone), (3, ""), (None, None), (7, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, dedup.dedup_report(docs).collect()), key=repr)
    want = sorted([(None, 56, 5, False), (5, 56, 5, True), (9, 56, 5, False), (None, 56, 5, False), (None, 36, None, True), (None, 36, None, True),
                   (3, 0, 3, True), (None, 0, None, True), (7, 1, 7, True)], key=repr)
    assert got == want
