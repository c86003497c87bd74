"""Operator 11 against counts of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from glosa.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, a string"  # names that clash with result columns


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, longest, top):
    count, total, first = Counter(), Counter(), {}
    for doc, text, lang in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for ws in pieces(text):
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    g = lang, tuple(ws[i:i + k])
                    count[g] += 1
                    if doc is not None:
                        first[g] = min(first.get(g, doc), doc)
    often = {g: a for g, a in count.items() if a >= least and len(g[1]) > 1}
    out = []
    for (lang, p), a in often.items():
        inside = any(la == lang and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for (la, q), b in often.items())
        if not inside:
            score, k = min((1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]], first.get((lang, p))))
    res, at = [], Counter()
    for lang, score, a, p, left, right, doc in sorted(out):
        at[lang] += 1
        if at[lang] <= top:
            res.append((lang, at[lang], p.decode(), -a, left, right, total[lang], -score, doc))
    return sorted(res)


def corpus():
    rng = random.Random(4)
    words = ["a", "b", "É", "ß-x", "no", "New", "york", "c" * 90_000, "'", "日本"]
    seps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!", "\x0b"]
    rows = []
    for i in range(260):
        text = "".join(rng.choice(words if rng.random() < 0.02 else words[:-3]) + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        rows.append((i if rng.random() < 0.9 else None, text, rng.choice(["en", "de", None, "und", ""])))
    long = " ".join(rng.choice(words[:5]) for _ in range(30_000))
    rows += [(900, long, "en"), (901, None, "en"), (902, "", "fr"), (903, "  . ,", "it"), (904, "New York, new york", "de")] + rows[:30]
    return rows


@pytest.mark.parametrize("bits,window,block", [(64, 1 << 18, 4 << 20), (7, 1 << 18, 4 << 20), (64, 50, 3000)])
def test_against_all_counts(spark, bits, window, block, monkeypatch):
    """Also with fingerprints of seven bits, which nearly all collide, and with small windows and blocks."""
    rows = corpus()
    want = brute(rows, 12, 5, 40)
    assert len(want) > 60
    df = spark.createDataFrame([(d, t, la, 1, "x", "y") for d, t, la in rows], SCHEMA).repartition(4)
    made = phrases.counter, phrases.speller

    def small(f):  # the settings inside the workers
        def call(*args):
            inner = f(*args)

            def run(batches):
                phrases.WINDOW, phrases.BLOCK_BYTES, phrases.HELD = window, block, window
                return inner(batches)

            return run

        return call

    monkeypatch.setattr(phrases, "counter", small(made[0]))
    monkeypatch.setattr(phrases, "speller", small(made[1]))
    got = phrases.mine_phrases(df, least=12, top=40, fingerprint_bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_scores_past_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", 0, None, 7 * big, None), ("en", 1, "a", big + 1, 1), ("en", 1, "b", big + 3, 1), ("en", 2, "a b", big, 1)], phrases.PHRASES)
    (row,) = phrases.collocations(counts).collect()
    assert row["score"] == 1000 * big * 7 * big // ((big + 1) * (big + 3)) and row["l"] == big + 1


def test_empty_table(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hashes_go_over_steps():
    values = np.random.default_rng(1).integers(0, 256, phrases._POWER_STEP + 900).astype(np.uint8)
    near = phrases._POWER_STEP
    start = np.array([0, near - 500, near, near + 100])
    end = np.array([300, near - 500 + 700, near + 300, near + 900])
    base = phrases._BASES[0]
    want = [sum(int(v) * pow(base, i, 1 << 64) for i, v in enumerate(values[s:e])) % (1 << 64) for s, e in zip(start, end)]
    assert phrases.span_hashes(values, start, end, base).tolist() == want


def test_clashing_word_hashes():
    import pyarrow as pa

    block = phrases.Block(["en"], pa.array(["ab abcdefgh abcdefghi abcdefghj ab abcdefghi " + "x" * 100 + "y " + "x" * 100 + "z " + "x" * 100 + "y"]))
    at = np.arange(len(block.word))
    want = [0, 1, 2, 3, 0, 2, 4, 5, 4]

    def alike(numbers):
        return [[a == b for b in numbers] for a in numbers]

    assert alike(block.numbers(at).tolist()) == alike(want)
    block.word[:] = 7
    assert alike(block.numbers(at).tolist()) == alike(want)
