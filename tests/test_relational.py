"""Relational operators against brute-force Python on small fixtures."""

import random

from pyspark.sql import functions as F

from glosa.operators import dataset, history, score
from glosa.operators.spans import select_spans, select_spans_df


def _w1_brute(spans):
    # spans: list of (start, end_inclusive, label) in input order
    order = sorted(range(len(spans)), key=lambda k: -(spans[k][1] - spans[k][0]))
    seen, out = set(), []
    for k in order:
        s, e, lab = spans[k]
        if s not in seen and e - 1 not in seen:
            seen.update(range(s, e))
            out.append((s, e + 1, lab))
    return out


def test_overlap_resolution_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for doc in range(40):
        n = rnd.randint(0, 12)
        for _ in range(n):
            s = rnd.randint(0, 30)
            rows.append((doc, s, s + rnd.randint(0, 6), rnd.choice(["PER", "LOC", "DIRECCIÓN"])))
    rows = sorted(set(rows))
    df = spark.createDataFrame(rows, "doc_id long, ann_start int, ann_end int, label string")
    got = sorted(tuple(r) for r in dataset.resolve_overlaps_long(df).collect())
    want = []
    for doc in range(40):
        spans = [(s, e, lab) for d, s, e, lab in rows if d == doc]  # input order = (start, end, label)
        want += [(doc,) + x for x in _w1_brute(spans)]
    assert got == sorted(want)


def _o1_brute(spans, rejected_block):
    order = sorted(range(len(spans)), key=lambda k: (-(spans[k][1] - spans[k][0]), spans[k][0], k))
    seen, out = set(), []
    for k in order:
        s, e, lab = spans[k]
        if s not in seen and e - 1 not in seen:
            out.append((s, e, lab))
            seen.update(range(s, e))
        elif rejected_block:
            seen.update(range(s, e))
    return sorted(out)


def test_greedy_selection_both_modes(spark):
    rnd = random.Random(5)
    docs = []
    for d in range(30):
        docs.append([(s, s + rnd.randint(1, 5), rnd.choice("AB")) for s in (rnd.randint(0, 25) for _ in range(rnd.randint(0, 10)))])
    docs.append([(0, 6, "A"), (3, 8, "B"), (7, 9, "C")])
    rows = [(d, [(s, e, lab, k) for k, (s, e, lab) in enumerate(sp)]) for d, sp in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id int, c array<struct<start:int,end:int,label:string,prio:bigint>>")
    for block in (True, False):
        for out in (df.select("doc_id", select_spans(F.col("c"), rejected_block=block).alias("k")),
                    select_spans_df(df, "c", "k", rejected_block=block)):
            got = {r.doc_id: sorted((x.start, x.end, x.label) for x in r.k) for r in out.collect()}
            for d, sp in enumerate(docs):
                assert got[d] == _o1_brute(sp, block), (block, sp)
    last = df.where("doc_id = 30").select(select_spans(F.col("c"), True).alias("k")).first().k
    assert [(x.start, x.end) for x in last] == [(0, 6)]


def test_scores(spark):
    gold = spark.createDataFrame([(1, 0, 2, "PER"), (1, 3, 4, "LOC"), (2, 0, 1, "PER")], "doc_id long, tok_start int, tok_end int, label string")
    pred = spark.createDataFrame([(1, 0, 2, "PER"), (1, 5, 6, "LOC")], "doc_id long, tok_start int, tok_end int, label string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    s = {r.doc_id: r for r in score.doc_scores(gold, pred, docs).collect()}
    assert (s[1].tp, s[1].fp, s[1].fn) == (1, 1, 1)
    assert abs(s[1].ents_f - 50.0) < 1e-9 and s[2].ents_f == 0 and s[3].ents_p == 0
    m = score.macro_scores(score.doc_scores(gold, pred, docs)).first()
    assert abs(m.f_score - 50.0 / 3) < 1e-9
    pl = {r.label: r.f_score for r in score.per_label_scores(gold, pred, docs).collect()}
    assert abs(pl["PER"] - 100.0 / 3) < 1e-9 and pl["LOC"] == 0.0


def test_history_callbacks(spark):
    vals = [10.0, 50.0, 45.0, 85.0, 85.5, 85.6, 85.7, 85.7, 86.0, 84.0]
    h = spark.createDataFrame([(0, e + 1, v) for e, v in enumerate(vals)], "session int, epoch int, val_f_score double")
    saved = [r.epoch for r in history.save_events(h, threshold=80.0).where("saved").orderBy("epoch").collect()]
    assert saved == [4, 5, 6, 7, 9]
    # brute-force plateau with the reference's loop
    lr, step, k, diff, ev = 0.05, 0.001, 3, 1.0, []
    for t in range(1, len(vals) + 1):
        if t > k and lr > step:
            d = [vals[j] - vals[j - 1] for j in range(1, t)][-k:]
            if sum(d) / len(d) < diff and not d[-1] > 0:
                lr -= step
                ev.append(t)
    got = [r.epoch for r in history.plateau_events(h, 0.05, step, k, diff).where("plateau").orderBy("epoch").collect()]
    assert got == ev
    want = None
    for t in range(1, len(vals) + 1):
        if t > 3:
            d = [vals[j] - vals[j - 1] for j in range(1, t)][-3:]
            if sum(d) < 2.0 and not d[-1] > 0:
                want = t
                break
    stop = history.early_stop(h, epochs=3, diff=2.0).first()
    assert stop is not None and stop.stop_epoch == want == 8
