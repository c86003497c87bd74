"""Operator 1 against a brute-force count of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from glosa.llm import suffix


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        n_spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases(seed, n_docs=30, size=150):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abé ") for _ in range(k))
    passages = [word(rng.randint(10, 60)) for _ in range(6)]
    docs = []
    for _ in range(n_docs):
        parts = [rng.choice(passages) if rng.random() < 0.4 else word(rng.randint(1, 40)) for _ in range(rng.randint(1, 8))]
        docs.append("".join(parts)[:size])
    return docs + [docs[0], docs[1], "", None, "a" * 90, "ab" * 50, "x"]


@pytest.mark.parametrize("seed,group,block", [(1, 1024, 1 << 20), (2, 2, 1 << 20), (3, 3, 32)])
def test_against_all_windows(spark, documents, monkeypatch, seed, group, block):
    texts = cases(seed)
    monkeypatch.setattr(suffix, "BLOCK", block)  # the workers fork after this in local mode or read the module's own value
    got = {r[0]: tuple(r)[1:] for r in suffix.repeats_report(documents(texts), length=20, gram=6, group=group).collect()}
    assert got == dict(enumerate(brute(texts, 20)))


def test_runs_cover_all_windows_and_agree(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.choice(b"ab") for _ in range(500))
    for block in (1 << 20, 64):
        monkeypatch.setattr(suffix, "BLOCK", block)
        found = suffix.runs(data, 40, 8)
        starts = [s for lo, hi, *_ in found for s in range(lo, hi + 1)]
        assert starts == list(range(len(data) - 39))
        at = {}
        for lo, hi, a, key, *_ in found:
            for s in range(lo, hi + 1):
                assert s <= a <= s + 32
                assert at.setdefault(data[s:s + 40], (a - s, key)) == (a - s, key)  # equal windows, equal anchors


def test_shared_is_exact():
    rng = random.Random(7)
    for _ in range(30):
        core = b"ANCHOR"
        group = []
        for _ in range(rng.randint(2, 12)):
            left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14)))
            right = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14)))
            group.append(suffix.Extent(left + core + right, len(left)))
        length = 12
        found = suffix.shared(group, length)
        for i, x in enumerate(group):
            def windows(e):
                return {(o, e.data[e.off - o: e.off - o + length]) for o in range(0, e.off + 1)
                        if e.off - o + length <= len(e.data) and length - o >= len(core)}
            others = set().union(*(windows(e) for j, e in enumerate(group) if j != i))
            want = {o for o, w in windows(x) if (o, w) in others}
            got = {o for lo, hi in found[i] for o in range(max(lo, 0), hi + 1)}
            assert {o for o in got if length - o >= len(core)} == want


def test_long_text_real_parameters(spark, documents):
    rng = random.Random(3)
    para = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) + para[:k] + "".join(rng.choice("xyz") for _ in range(700)) for k in (399, 400, 900, 650)]
    got = {r[0]: tuple(r)[1:] for r in suffix.repeats_report(documents(texts)).collect()}
    assert got == dict(enumerate(brute(texts, 400)))


def test_empty_table(spark, documents):
    assert suffix.repeats_report(documents([])).collect() == []
