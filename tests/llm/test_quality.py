"""Operator 9 against a plain count, and the host verdicts."""

import random
import re
from collections import Counter

from glosa.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def texts():
    rng = random.Random(4)
    out = [" ".join(rng.choice(["a", "bé", "c#", "\n", "\u00a0x", "d\x0be"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return out + [None, "", " \n ", "one two three four five " * 3, "x\ny\nx\n\n\nx", "w " * 30_000, " ".join(map(str, range(5000)))]


def test_measures(spark, documents):
    t = texts()
    rows = quality.quality_report(documents(t + t[:3])).collect()
    want = [brute(x) for x in t + t[:3]]
    got = {r["doc_id"]: tuple(r)[1:7] for r in rows}
    assert got == dict(enumerate(want))


def test_host_verdicts(spark, documents):
    good = "ten different words in a row make one good document here"
    rows = [(good, "clean")] * 60 + [("bad", "clean")] * 2 + [("bad", "spam")] * 80 + [(good, "spam")] * 2 + [(good, None), ("bad", "tiny"), (good, "tiny")]
    docs = documents(rows).withColumnRenamed("lang", "kept").withColumnRenamed("n_chars", "base_failed")
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs).collect()}
    want = {i: t == good and s != "spam" for i, (t, s) in enumerate(rows)}
    want[len(rows) - 1] = verdict[len(rows) - 1]  # a host of two: whichever side the prior puts it
    assert verdict == want
    left = quality.quality_filter(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, k in verdict.items() if k}
    hosts = {r["host"]: r for r in quality.host_verdicts(documents(rows).selectExpr("source", "length(text) < 9 base_failed")).collect()}
    assert hosts["tiny"]["rate"] != 0.5 and hosts["spam"]["rejected"] and not hosts[None]["rejected"]


def test_rules_by_themselves(spark, documents):
    """Each rule rejects documents, and hosts, by figures of its own."""
    rng = random.Random(8)

    def good():
        return " ".join(rng.choice(["ten", "words", "that", "are", "in", "order", "here", "now"]) + str(rng.randint(0, 999)) for _ in range(20))

    symbols, lines, short = good() + " ### *** $$$ %%% &&&", "a line\n" * 3 + "and so on " + " ".join(map(str, range(10, 20))), " ".join("abcdefghij" "klmnopqrs")
    rows = [(good(), "plain") for _ in range(40)] + [(x, "plain") for x in (symbols, lines, short)]
    rows += [(good(), "signs") for _ in range(10)] + [(good() + " ### *** $$$ %%% &&&", "signs") for _ in range(40)]
    docs = documents(rows)
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_report(docs).collect()}
    assert [verdict[i] for i in range(43)] == [(False, True)] * 40 + [(False, False)] * 3
    assert {verdict[i] for i in range(43, len(rows))} == {(False, False)}  # the host goes with its good documents
    assert {r["doc_id"] for r in quality.quality_filter(docs).collect()} == set(range(40))


def test_empty_table(spark, documents):
    assert quality.quality_report(documents([])).collect() == []
    assert quality.quality_filter(documents([])).collect() == []


def test_one_hot_host_among_many_small_ones(spark):
    def verdicts(n, hot):  # the first n * hot of n rows are one host's, nine in ten failing; the others' one in ten
        edge = int(n * hot)
        tested = spark.range(n).selectExpr(f"if(id < {edge}, 'hot', concat('h', id)) source",
                                           f"if(id < {edge}, id % 10 < 9, id % 10 = 0) base_failed")
        rows = quality.host_verdicts(tested).groupBy("host", "n", "fails", "rejected").count().collect()
        return {(r["host"] if r["host"] == "hot" else "small", r["fails"] == r["n"], r["rejected"]) for r in rows}

    want = {("hot", False, True), ("small", True, True), ("small", False, False)}
    for hot in (1 / 3, 0.8):  # 0.8: over half of all documents fail
        assert verdicts(900, hot) == verdicts(90_000, hot) == want
    one_each = spark.range(100).selectExpr("id source", "id < 80 base_failed")
    assert {(r["fails"], r["rejected"]) for r in quality.host_verdicts(one_each).collect()} == {(1, True), (0, False)}
