"""Operator 8: all segmentations of small texts, exact round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glosa.llm import pieces

VOCABULARY = pieces.read_vocabulary()


def toy(cut=True):
    parts = ["a", "b", "ab", "ba", "aba", " a", " ab", " ", "  ", "bb", "abb"]
    return pieces.Vocabulary(tuple((p, 256 + i, -round(1e6 * (1 + i * 0.37))) for i, p in enumerate(parts)), tuple(range(256)), 256 + len(parts), cut)


def all_paths(seg, text):
    into = seg.lattice(" " + text)

    def to(node):
        if node == 0:
            return [(0, ())]
        return [(s + sc, ids + e) for i, e, sc in into[node] for s, ids in to(i)]

    return sorted(to(len(text) + 1), key=lambda p: -p[0])


def listed(seg, text):
    ids, score, best = seg.encode(text)
    out = []
    for loss, changes in best:
        new = list(ids)
        for at, n, repl in sorted(changes, reverse=True):
            new[at:at + n] = repl
        out.append((score - loss, tuple(new)))
    return out


@pytest.mark.parametrize("cut", [True, False])
def test_n_best_against_all_paths(cut):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("ab c\n") for _ in range(rng.randint(1, 9)))
        seg = pieces.Segmenter(toy(cut), 6)
        want, got = all_paths(seg, text), listed(seg, text)
        assert [s for s, _ in got] == [s for s, _ in want[:6]]
        assert len({p for _, p in got}) == len(got) and {p for _, p in got} <= {p for _, p in want}
        assert all(seg.decode(p) == text for _, p in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁abé\t\0"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_round_trip(text):
    seg = pieces.segmenter(VOCABULARY, 3)
    got = listed(seg, text)
    assert all(seg.decode(ids) == text for _, ids in got)
    assert [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
    assert len({ids for _, ids in got}) == len(got)


def test_chunks_equal_the_whole_lattice():
    import dataclasses
    whole = pieces.Segmenter(dataclasses.replace(VOCABULARY, cut=False), 4)
    apart = pieces.Segmenter(VOCABULARY, 4)
    for text in ("Anblewh sttible  athawh\nthonre was", "den über\n\n   x ▁", "a" * 50, " " * 40 + "z"):
        assert [s for s, _ in listed(whole, text)] == [s for s, _ in listed(apart, text)]


def test_query(spark, documents):
    texts = ["Hello world", "", None, "x" * 30_000, "Hello world", "tab\there ▁ \U0001f600"]
    docs = documents(texts).withColumnRenamed("lang", "ids")  # a clashing name
    rows = pieces.encoded(docs).orderBy("doc_id").collect()
    assert [r["exact"] for r in rows] == [True] * 6
    assert [r["n_pieces"] for r in rows][1:3] == [0, 0] and rows[0]["ids"] == rows[4]["ids"]
    back = pieces.decoded(pieces.encoded(docs)).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == [t or "" for t in texts]
    assert pieces.encoded(documents([])).collect() == []
