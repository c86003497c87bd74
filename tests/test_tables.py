"""Pattern tables, phrase tables, sampling at size, run search and the rewrite protocol."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from glosa.functions.text import token_frame
from glosa.operators import audit, dataset, gazetteer, patterns
from glosa.operators.spans import select_spans_df
from glosa.plans.annotate import annotate
from glosa.sources import annotated as S


# --- pattern tables ------------------------------------------------------------------------


def found(spark, rows, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tf = token_frame(docs, offsets=False).withColumn("m", patterns.pattern_matches(patterns.compile_patterns(rows)))
    out = select_spans_df(tf, "m", "s").select("doc_id", F.inline("s")).collect()
    return sorted((r.doc_id, r.start, r.end, r.label) for r in out)


def test_conditions_and_quantifiers(spark):
    def rows(*atoms, name="p"):
        return [(name, "X", k, *a) for k, a in enumerate(atoms)]

    texts = ["el juez Ana firmó 12 de mayo", "uno , dos , tres", "Ley 23737 y LEY AB-1", "a@b.com https://x.com/", "x x x x", "no , sí"]
    assert found(spark, rows(("LOWER", "=", ["ley"], ""), ("SHAPE", "=", ["dddd"], "")), texts) == [(2, 0, 2, "X")]
    assert found(spark, rows(("ORTH", "IN", ["Ley", "LEY"], ""), ("ORTH", "REGEX", ["^[A-Z]+-[0-9]$"], "")), texts) == [(2, 3, 5, "X")]
    assert found(spark, rows(("LENGTH", ">=", ["4"], ""), ("LENGTH", "<=", ["3"], "")), texts) == [(0, 1, 3, "X"), (0, 3, 5, "X"), (2, 1, 3, "X")]
    assert found(spark, rows(("IS_PUNCT", "=", ["true"], "!"), ("IS_PUNCT", "=", ["true"], "")), texts) == [(1, 0, 2, "X"), (1, 2, 4, "X"), (5, 0, 2, "X")]
    assert found(spark, rows(("LIKE_EMAIL", "=", ["true"], ""), ("LIKE_URL", "=", ["true"], "")), texts) == [(3, 0, 2, "X")]
    assert found(spark, rows(("ORTH", "=", ["x"], "{3}")), texts) == [(4, 0, 3, "X")]
    assert found(spark, rows(("ORTH", "=", ["x"], "+")), texts) == [(4, 0, 4, "X")]
    # two conditions on one token; an optional token; any token
    both = [("p", "X", 0, "IS_ALPHA", "=", ["true"], ""), ("p", "X", 0, "LOWER", "NOT_IN", ["el", "de", "juez", "firmó", "mayo"], ""), ("p", "X", 1, "ORTH", "=", ["firmó"], "?"), ("p", "X", 2, "LIKE_NUM", "=", ["true"], "")]
    assert found(spark, both, texts[:1]) == [(0, 2, 5, "X")]
    assert found(spark, rows(("ORTH", "=", ["no"], ""), ("ANY", "=", [], "*")), texts) == [(5, 0, 3, "X")]
    assert found(spark, rows(("ORTH", "=", ["x"], "?"), ("ORTH", "=", ["zz"], "?")), ["a b", None, ""]) == []  # an empty match is none


def test_wrong_tables():
    for rows in ([("p", "X", 0, "COLOUR", "=", ["red"], "")], [("p", "X", 0, "ORTH", "~", ["a"], "")], [("p", "X", 0, "ORTH", "=", ["a"], "??")],
                 [("p", "X", 0, "IS_DIGIT", "=", ["perhaps"], "")], [("p", "X", 0, "ORTH", "=", ["a"], ""), ("p", "Y", 1, "ORTH", "=", ["a"], "")],
                 [("p", "X", k, "ORTH", "=", [str(k)], "") for k in range(9)]):
        with pytest.raises(ValueError):
            patterns.compile_patterns(rows)


def test_annotate_with_a_pattern_table(spark):
    table = spark.createDataFrame([("stars", "PAR", 0, "ORTH", "=", ["x"], "{2}")], patterns.PATTERN_DDL)
    docs = spark.createDataFrame([(1, "pidió dos copias x x")], "doc_id long, text string")
    assert {(r.tok_start, r.tok_end, r.label) for r in annotate(docs, patterns=table).collect()} == {(1, 2, "NUM"), (3, 5, "PAR")}


# --- phrase tables -------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_phrases_against_plain_search(spark, broadcast_rows):
    rng = random.Random(2)
    words = ["Banco", "de", "la", "Nación", "macro", "banco", "x", "La"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    phrases = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice("AB")) for _ in range(60)] + [("", "A"), (None, "A"), ("ausente total", "A")]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, phrase string").repartition(4)
    table = spark.createDataFrame(phrases + phrases[:10], "phrase string, label string")
    got = sorted(tuple(r) for r in gazetteer.find_phrases(docs, table, broadcast_rows=broadcast_rows).collect())
    want = set()
    for d, t in enumerate(texts):
        toks = (t or "").lower().split()
        for p, lab in phrases:
            run = (p or "").lower().split()
            want |= {(d, i, i + len(run), lab) for i in range(len(toks) - len(run) + 1) if run and toks[i:i + len(run)] == run}
    assert got == sorted(want) and len(got) > 100
    assert gazetteer.find_phrases(docs, table.where("label = 'none'")).count() == 0


def test_many_phrases_with_one_first_token(spark):
    """200,000 phrases that begin alike: candidates follow the tokens and lengths, not the phrases."""
    n = 200_000
    table = spark.range(n).select(F.concat(F.lit("de la calle"), F.lit(" n"), "id").alias("phrase"), F.lit("DIR").alias("label"))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("vive de la calle n"), F.col("id") * 150, F.lit(" y de la otra")).alias("text"))
    out = gazetteer.find_phrases(docs, table, broadcast_rows=1000)
    assert out.count() == sum(i * 150 < n for i in range(2000))


# --- sampling ------------------------------------------------------------------------------


def test_sample_is_the_first_in_hash_order(spark):
    rows = [(i * 7919,) for i in range(3000)] + [(5,)] * 40 + [(None,)] * 3
    df = spark.createDataFrame(rows, "doc_id long").repartition(6)
    order = sorted(rows, key=lambda r: (r[0] is not None, 0 if r[0] is None else (r[0] * dataset.HASH_MUL + 3) % dataset.HASH_MOD, r[0] or 0))
    for n, bins in ((0, 16), (1, 16), (2, 4096), (100, 1), (1500, 16), (3042, 16), (3043, 16), (9999, 16)):
        got = [r.doc_id for r in dataset.sample_n(df, n, seed=3, bins=bins).collect()]
        assert sorted(got, key=repr) == sorted((r[0] for r in order[:n]), key=repr), (n, bins)


def test_half_of_a_table_is_in_no_single_task(spark):
    df = spark.range(200_000).select(F.col("id").alias("doc_id"))
    half = dataset.sample_n(df, 100_000)
    parts = [r["n"] for r in half.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(parts) == 100_000 and max(parts) < 30_000


# --- run search ----------------------------------------------------------------------------


def test_substrings_against_search():
    rng = random.Random(7)
    for _ in range(60):
        text = "".join(rng.choice("ab\0c") for _ in range(rng.randint(0, 60)))
        index = audit.Substrings(text)
        for _ in range(80):
            s = "".join(rng.choice("ab\0c") for _ in range(rng.randint(0, 6)))
            assert (s in index) == (s in text), (s, text)


def test_many_annotations_in_one_misaligned_document():
    """1e5 annotations against runs of a million characters: seconds."""
    rng = random.Random(9)
    runs = ["".join(rng.choice("abcdefgh") for _ in range(50)) for _ in range(20_000)]
    text = " ".join(runs)
    anns = [{"char_start": s, "char_end": s + 12} for s in (rng.randrange(len(text) - 20) for _ in range(100_000))]
    begun = time.time()
    out = audit.annotation_texts(text, runs, anns)
    assert time.time() - begun < 60
    joint = "\0".join(runs)
    assert all(o["flag"] == (o["ann_text"].replace(" ", "") in joint) for o in out[:300])
    assert audit.annotation_texts(text, None, anns[:2])[0]["flag"] is False
    assert audit.annotation_texts("ab", ["a"], [{"char_start": None, "char_end": 2}, {"char_start": -3, "char_end": 1}, {"char_start": 2, "char_end": 1}]) == [
        {"ann_text": None, "flag": None}, {"ann_text": "a", "flag": True}, {"ann_text": "", "flag": True}]


# --- backup, then rewrite ------------------------------------------------------------------


def training_data(spark, path):
    rows = [("1", "Ana Gil vive acá.", [(0, 7, "PER")]), ("2", "Eva Paz firmó hoy.", [(1, 7, "PER"), (14, 17, "FECHA")]), ("3", None, None)]
    S.write_training(spark.createDataFrame(rows, S.TRAINING_SCHEMA), path)


def entities(spark, path):
    return {r.doc_id: None if r.entities is None else [tuple(e) for e in r.entities] for r in spark.read.schema(S.TRAINING_SCHEMA).json(path).collect()}


def test_cleanup_in_place_keeps_a_copy(spark, tmp_path):
    path = str(tmp_path / "training")
    training_data(spark, path)
    out = S.clean_training(spark, path, report_path=str(tmp_path / "report"))
    assert entities(spark, path) == {"1": [(0, 7, "PER")], "2": [(14, 17, "FECHA")], "3": []}
    assert out["copy"] == path + S.COPY_SUFFIX and entities(spark, out["copy"])["2"] == [(1, 7, "PER"), (14, 17, "FECHA")]
    assert (out["misaligned_docs"], out["flagged_annotations"], out["total_lost"]) == (1, 1, 1)
    report = [json.loads(x) for f in (tmp_path / "report").glob("part-*") for x in f.read_text().splitlines()]
    assert [r["doc_id"] for r in report] == ["2"] and report[0]["annotations"][0]["annotated_text"] == "va Paz"
    again = S.clean_training(spark, path)  # another cleanup doesn't touch the first copy
    assert again["copy"] == path + S.COPY_SUFFIX + "-2" and entities(spark, path)["2"] == [(14, 17, "FECHA")]


def test_a_rewrite_that_broke_off_is_taken_up(spark, tmp_path):
    path = str(tmp_path / "training")
    training_data(spark, path)
    old = entities(spark, path)

    def fewer(rows):
        return rows.where("doc_id <> '3'")

    def fails(rows):
        return rows.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))

    job = S.Rewrite(spark, path, "_old")
    with pytest.raises(Exception, match="lost"):
        job.run(fails)
    assert job.current() == path and entities(spark, path) == old and not job.whole()
    job.stage(fewer(spark.read.schema(S.TRAINING_SCHEMA).json(path)), "json")  # broken off before the first rename
    assert job.current() == path and entities(spark, path) == old
    assert job.fs.rename(job._at(path), job._at(path + "_old"))  # and once more between the two
    assert job.current() == job.staged and entities(spark, job.current()) == {k: v for k, v in old.items() if k != "3"}
    assert entities(spark, path + "_old") == old
    assert S.Rewrite(spark, path, "_old").run(fails) == path + "_old"  # nothing is made anew: the staged data is whole
    assert entities(spark, path) == {k: v for k, v in old.items() if k != "3"} and entities(spark, path + "_old") == old
    assert not list(tmp_path.glob("training.staged*")) and not re.search("_backup", str(list((tmp_path / "training").iterdir())))
