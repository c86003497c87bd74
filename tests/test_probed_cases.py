"""Cases where one greedy scan, a shared guard or a missing boundary once gave a wrong answer."""

from pyspark.sql import functions as F

from glosa.operators import audit, score
from glosa.sources.annotated import read_annotated
from helpers import annotate_texts


def spans(doc, label):
    return sorted(doc.span_text(s, e) for s, e, lab in doc.ents if lab.startswith(label))


def test_date_range_offers_every_match(spark):
    d, = annotate_texts(spark, ["del 3 de mayo al 4 de junio de 2020"], stages=("ruler",))
    assert spans(d, "FECHA") == ["3 de mayo al", "4 de junio de 2020"]


def test_long_number_chain(spark):
    d, e = annotate_texts(spark, ["uno y dos y tres y cuatro y cinco", "uno y dos y tres y cuatro"], stages=("matcher",))
    assert spans(d, "NUM") == ["uno y dos y tres y cuatro"]  # the rejected match that ends the chain still marks it
    assert spans(e, "NUM") == ["uno y dos y tres y cuatro"]


def test_age_at_the_start_of_a_document(spark):
    d, = annotate_texts(spark, ["Tiene 1.000 años de edad."])
    assert (1, 2, "EDAD") in d.ents


def test_no_file_name_inside_a_word(spark):
    d, e = annotate_texts(spark, ["fin.documento", "fin.doc ñ"])
    assert "documento" in d.toks and not spans(d, "NOMBRE_ARCHIVO")
    assert spans(e, "NOMBRE_ARCHIVO") == ["fin.doc"]


def test_long_shape_is_kept(spark):
    from glosa.functions.text import shape

    row = spark.createDataFrame([("a" * 120, "9" * 120)], "a string, b string").select(
        shape(F.col("a")), shape(F.col("b"), compat=False)).first()
    assert tuple(row) == ("xxxx", "d" * 120)


def test_label_only_in_gold_scores_zero(spark):
    cols = "doc_id long, tok_start int, tok_end int, label string"
    gold = spark.createDataFrame([(1, 0, 1, "EDAD"), (1, 2, 3, "PER")], cols)
    pred = spark.createDataFrame([(1, 2, 3, "PER")], cols)
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r.label: round(r.f_score, 6) for r in score.per_label_scores(gold, pred, docs).collect()}
    assert got == {"EDAD": 0.0, "PER": 50.0}


def _audited(spark, rows):
    from glosa.functions.text import token_frame

    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    ann = spark.createDataFrame([(i, s, e, lab) for i, (_, a) in enumerate(rows) for s, e, lab in a],
                                "doc_id long, char_start int, char_end int, label string")
    return audit.attach_annotations(token_frame(docs), ann)


def test_cleanup_share_and_empty_denominators(spark):
    two_in_one_run = ("abcd efgh ijkl", [(0, 2, "A"), (2, 3, "B"), (5, 9, "C")])
    r = audit.misalignment_summary(_audited(spark, [two_in_one_run]), after_removal=True).first()
    assert (r.misaligned_runs, r.flagged_annotations, r.total_lost, r.removed_pct) == (1, 2, 1, 200.0)
    all_lost = ("abcd", [(0, 2, "A")])
    r = audit.misalignment_summary(_audited(spark, [all_lost]), after_removal=True).first()
    assert (r.total_lost, r.removed_pct) == (1, 100.0)
    none = _audited(spark, [("abcd", [(0, 4, "A")])]).where("doc_id < 0")
    r = audit.misalignment_summary(none).first()
    assert (r.n_docs, r.misaligned_docs, r.misaligned_pct, r.runs_pct) == (0, 0, 0.0, 0.0)


def test_equal_texts_stay_two_documents(spark, tmp_path):
    line = '{"content": "igual", "annotation": []}\n'
    (tmp_path / "a.json").write_text(line * 2)
    assert read_annotated(spark, str(tmp_path)).select("doc_id").distinct().count() == 2


def test_batches_in_closed_form(spark):
    from glosa.operators import dataset

    assert dataset.compounding_ramp(6.0, 12.0, 1.5) == ([6, 9], 12)
    assert dataset.compounding_ramp(4.0, 4.0, 1.0) == ([], 4) and dataset.compounding_ramp(8.0, 16.0, 0.5) == ([8, 4, 2, 1], 1)
    df = spark.range(0, 1000).withColumnRenamed("id", "doc_id")
    out = dataset.assign_batches(df, (6.0, 12.0, 1.5), seed=3)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert sorted(r.rk for r in rows) == list(range(1, 1001))
    sizes = [sum(r.batch == b for r in rows) for b in range(max(r.batch for r in rows) + 1)]
    assert sizes[:3] == [6, 9, 12] and set(sizes[2:-1]) == {12}


def test_many_spans_in_one_document(spark):
    """Selection follows the spans' lengths, not the square of their number."""
    import time

    from glosa.operators.spans import select_spans_df

    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct(
        i.alias("start"), (i + 1 + i % 3).alias("end"), F.lit("A").alias("label"), i.cast("long").alias("prio"))).alias("c"))
    began = time.time()
    n = select_spans_df(df, "c", "k").select(F.size("k")).first()[0]
    assert n > 30_000 and time.time() - began < 30


def test_plates_of_two_tokens_only_without_compat(spark):
    from glosa.plans.annotate import annotate

    docs = spark.createDataFrame([(1, "patente AAA 410 y 410 bbb o AAA-410")], "doc_id long, text string")

    def plates(compat):
        out = annotate(docs, compat=compat, stages=("ruler",)).where("label = 'PATENTE_DOMINIO'").collect()
        return sorted((r.tok_start, r.tok_end) for r in out)

    assert plates(True) == [(7, 8)] and plates(False) == [(1, 3), (4, 6), (7, 8)]


def test_file_extensions_are_the_listed_ones(spark):
    from glosa.functions import vocab

    texts = [f"ver nota.{e} ya" for e in vocab.FILE_EXTENSIONS]
    for d, e in zip(annotate_texts(spark, texts, stages=("ruler",)), vocab.FILE_EXTENSIONS):
        assert (1, 2, "NOMBRE_ARCHIVO") in d.ents, e
