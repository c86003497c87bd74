"""Driver contract of __spark_entry__."""

import __spark_entry__ as E


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert {"annotate_rulings", "tokens", "doc_scores", "overlap_resolution", "plateau"} <= set(q)
    # the only rows-only query outside the training-data operators
    assert {k for k in set(q) - set(o) if not k.startswith("op") and k != "pipeline"} == {"training_history"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "tok_start", "tok_end", "label", "char_start", "char_end"]
    rows = df.collect()
    assert rows and all(r.tok_start < r.tok_end for r in rows)


def test_annotation_plan_has_no_exchange(spark):
    """The annotation plan is one narrow stage: no shuffle between scan and output
    (input already split into at least as many partitions as cores)."""
    from pyspark.sql import functions as F

    from glosa.plans.annotate import annotate

    n = spark.sparkContext.defaultParallelism * 2
    docs = spark.range(0, 4 * n, 1, n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Buenos Aires, 9 de julio de 2020, causa nº "), F.col("id").cast("string")).alias("text"))
    out = annotate(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert out.where("label = 'FECHA_RESOLUCION'").count() == 4 * n
