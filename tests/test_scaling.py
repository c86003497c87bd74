"""What lets the annotation and audit queries grow: how often texts are matched, what is shuffled, sent and held."""

import random
import re
from datetime import date
from itertools import groupby

import pyarrow as pa
from pyspark.sql import functions as F

from glosa.functions import text as T
from glosa.operators import audit, dataset, intervals, ruler, sequence
from glosa.plans import fixtures, queries as Q
from glosa.streaming.annotate_stream import rows_per_batch

TEXTS = [
    "El 3 de mayo, a@b.com y http://x.org/a?b=1 (fin.documento) informe.doc.", "  \n\n a \r\n\tb  ", "Av. Pág. p.5 EE.UU. J-01-00001234-1/2020-0.-",
    "-de uno-dos_tres 12 12, 1.5 12/34 174bis ½ ٣4 é́ 😀x.pdf", ".. . .a a. a.b@c.d +1 -1 :: x: https: ", "", None,
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fast_token_regex_and_offsets_match_the_plain_ones(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    plain = [F.regexp_extract_all(text, F.lit(T.GAP_TOKEN_REGEX), g).alias(f"g{g}") for g in (1, 2)]
    rows = T.token_frame(df).select("toks", "tstart", *plain).collect()
    for r in rows:
        at, starts = 0, []
        for gap, tok in zip(r.g1, r.g2):
            starts.append(at + len(gap))
            at = starts[-1] + len(tok)
        assert (r.toks, r.tstart) == (r.g2, starts)


def test_number_classes_are_made_once(spark):
    assert str(sequence.num_candidates()).count("lpad") == 1


def test_dates_join_their_letters_once_per_start(spark):
    assert str(ruler.date_matches("c")).count("slice(") == 1


def test_long_tables_are_not_broadcast_unseen(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 6), (None, 0, 0, 2)], "doc_id long, i int, tstart int, tend int")
    ann = spark.createDataFrame([(1, 0, 6, "A")], "doc_id long, char_start int, char_end int, label string")
    tagged = intervals.biluo_rows(tokens, ann)
    assert "Broadcast" not in plan(tagged)
    spans = intervals.decode_rows(tagged, "tag")
    assert "Broadcast" not in plan(spans)
    assert [tuple(r) for r in spans.collect()] == [(1, 0, 2, "A")]


def orders(spark, tmp_path):
    rows = [(k, date(2020, 1 + k % 12, 1 + k % 28)) for k in range(40)] + [(None, date(2020, 1, 1))]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_rulings_are_dealt_before_their_text_is_made(spark, tmp_path):
    sf = orders(spark, tmp_path)
    for df in (Q.rulings_with_base(spark, sf), Q._audited(spark, sf)):
        p = df._jdf.queryExecution().optimizedPlan().toString()
        assert p.index("Buenos Aires") < p.index("RepartitionByExpression")
        assert "Buenos Aires" not in p[p.index("RepartitionByExpression"):]
    made, given = Q.spread_rulings(spark, sf), Q.rulings(spark, sf)
    assert sorted(made.collect(), key=str) == sorted(given.collect(), key=str)


def test_audit_takes_one_python_step(spark, tmp_path):
    found = audit.misaligned_annotations(Q._audited(spark, orders(spark, tmp_path)))
    assert plan(found).count("ArrowEvalPython") == 1


def test_stream_batches_hold_few_rows_and_give_the_setting_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with rows_per_batch(spark, 256):
        assert spark.conf.get(name) == "256"
    assert spark.conf.get(name) == before


def test_annotations_are_made_without_self_joins_and_are_the_same_rows(spark, tmp_path):
    rows = [(k % 25, date(2020, 1 + k % 12, 1 + k % 28)) for k in range(40)] + [(None, date(2020, 1, 1)), (7, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    made = fixtures.derived(spark, str(tmp_path), "ann")
    assert "Join" not in plan(made)
    fixtures.derived(spark, str(tmp_path), "rulings")
    assert sorted(made.collect(), key=str) == sorted(spark.sql(fixtures.ANN_SQL).collect(), key=str)


def test_batches_are_tagged_and_checked_as_single_documents_are():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab é😀 .,  -\xa0" + "\n" * (k % 4 == 0)) for _ in range(rnd.randrange(30))) for k in range(400)] + [None]
    toks = [re.findall(r"[ \n]?\n[ \n]?|\w+|[^\w\s]|\xa0", t or "") for t in texts]
    anns = [[{"char_start": rnd.choice([None, *range(-2, 33)]), "char_end": rnd.randrange(-2, 33), "label": rnd.choice(["P", "Q"]), "ord": k}
             for k in range(rnd.randrange(5))] for _ in texts]
    kind = pa.list_(pa.struct([("char_start", pa.int32()), ("char_end", pa.int32()), ("label", pa.string()), ("ord", pa.int32())]))
    arrays = pa.array(texts, pa.string()), pa.array(toks, pa.list_(pa.string())), pa.array(anns, kind)
    batch = audit.Tagged(*arrays)
    runs, checked = audit.misaligned_runs(batch, arrays[1]), audit.checked(*arrays).to_pylist()
    assert len(runs) > 50
    for d, (text, words, own) in enumerate(zip(texts, toks, anns)):
        starts = T.starts_of(text or "", words)
        tags = audit.biluo(starts, [s + len(w) for s, w in zip(starts, words)], [a for a in own if a["char_start"] is not None])
        assert [batch.tags[c] for c in batch.codes[batch.rows[d]: batch.rows[d + 1]]] == tags
        assert checked[d]["runs"] == runs.get(d, []) == ["".join(w for _, w in g).replace(" ", "") for bad, g in groupby(zip(tags, words), lambda x: x[0] == "-") if bad]
        assert checked[d]["found"] == audit.annotation_texts(text, checked[d]["runs"] or None, own)


def test_spans_alone_in_their_cluster_are_kept_without_a_walk(spark):
    rows = [(1, 0, 3, "A"), (1, 2, 5, "A"), (1, 9, 9, "B"), (2, 4, None, "A"), (3, None, 2, "A"), (None, 1, 2, "C"), (4, 7, 3, "A")]
    df = spark.createDataFrame(rows, "doc_id long, ann_start int, ann_end int, label string")
    items = dataset._cluster_groups(df, "doc_id", "ann_start", "ann_end", "label", ["ann_start", "ann_end", "label"])
    both = items.select(dataset.resolve_clusters(F.col("_items")).alias("new"), dataset.resolve_overlaps(F.col("_items")).alias("old")).collect()
    assert len(both) >= 6 and all(r.new == r.old for r in both)
    handed = items.select(F.sum(F.size("_items")).alias("all"), F.sum(F.when(F.size("_items") > 1, F.size("_items"))).alias("walked")).first()
    assert handed["all"] == 7 and handed["walked"] == 2
    assert "size(_items" in plan(items.select(dataset.resolve_clusters(F.col("_items"))))
