"""Rules that run over batches of documents: words are tested once each, as the columns test them."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from glosa.functions import text as T, words
from glosa.operators import intervals, patterns, ruler, spans
from glosa.plans import queries as Q, table_queries
from test_scaling import orders, plan

WORDS = [
    "a@b.com", "ñ@b.co", "x@y", "http://x.y", "https://a\u0085b", "www.a", "www.abc", "foo.com:80", "foo.com/", "a.uy", "12.345.678", "410", "AAA410", "ABC123456",
    "20-32481145-7", "é.pdf", "x².doc", "١٢٣", "½", "Ⅷ", "ǅ12", "(", "–", "12/34", "+5", "~3,5", "Uno", "MIL,", "12/", "/3", "999999999", "\x01", "é́", "ªb", "\n",
]


def test_words_have_the_attributes_of_the_columns(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "t string")
    hd = F.col("t").rlike(r"\d")
    own = {"shape": (T.shape(F.col("t")), words.shape), "uncut": (T.shape(F.col("t"), False), lambda t: words.shape(t, False)),
           "lnum": (F.when(hd, T.like_num(F.col("t"))).otherwise(T._word_like_num(F.lower("t"))), words.like_num),
           "dig": (T.is_digit(F.col("t")), words.is_digit), "alp": (T.is_alpha(F.col("t")), words.is_alpha), "pun": (T.is_punct(F.col("t")), words.is_punct),
           "email": (T.like_email(F.col("t")), words.like_email), "url": (T.like_url(F.col("t")), words.like_url)}
    for r in df.select("t", *[c.alias(k) for k, (c, _) in own.items()]).collect():
        for k, (_, f) in own.items():
            assert f(r.t) == r[k], (r.t, k)


def test_the_ruler_is_one_step_over_words(spark):
    df = spark.createDataFrame([(1, "ley 23737, marca alfa romeo, CBU: 0140323501111111500292 del banco macro")], "doc_id long, text string")
    found = ruler.ruler_matches(T.token_frame(df), out="m").select("doc_id", "m")
    p = plan(found)
    assert p.count("ArrowEvalPython") == 1 and "RLIKE" not in p
    assert {(m.start, m.end, m.label) for m in found.first().m} == {(0, 2, "LEY"), (3, 6, "MARCA_AUTOMÓVIL"), (7, 10, "CBU"), (11, 13, "BANCO")}


def test_dates_of_batches_are_those_of_the_class_columns(spark):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["de", "a", "los", "días", "del", "mes", "mayo", "año", "3", "en", "x", "uno"]) for _ in range(rnd.randrange(15))) for _ in range(300)]
    tf = T.token_frame(spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string"), offsets=False)
    tf = tf.withColumn("_c", T.keep(ruler.date_classes())).withColumn("old", T.keep(ruler.date_matches("_c")))
    rows = ruler.ruler_matches(tf, "español", out="new").select("old", F.filter("new", lambda m: m["label"] == "FECHA").alias("new")).collect()
    assert sum(len(r.new) for r in rows) > 100 and all(r.old == r.new for r in rows)


def test_tags_share_their_tokens(spark, tmp_path):
    sf = orders(spark, tmp_path)
    found = table_queries.q_ruler_matches_tags(spark, sf)
    assert plan(found).count("regexp_extract_all(") == 1
    tf = T.token_frame(Q.spread_rulings(spark, sf))
    alone = {(*r, t) for t in table_queries.TAGS for r in Q._long(ruler.ruler_matches(tf, tag=t, out="m"), "m").collect()}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(alone, key=str)


def test_spans_of_batches_are_chosen_as_a_documents_are():
    rnd = random.Random(4)
    docs = [[rnd.choice([None, *[{"start": s, "end": s + n, "label": rnd.choice([None, "A", "B"]), "prio": rnd.randrange(3)} for s in range(6) for n in range(5)]])
             for _ in range(rnd.randrange(9))] for _ in range(400)]
    for block in (True, False):
        for desc in (True, False):
            flags = [pa.array([x] * len(docs)).to_numpy(zero_copy_only=False) for x in (block, desc)]
            items = pa.array([x for d in docs for x in d], spans.SPAN)
            doc = pa.array([k for k, d in enumerate(docs) for _ in d], pa.int64()).to_numpy()
            kept = spans.greedy_choice(items, doc, *flags)
            by = [[] for _ in docs]
            for d, x in zip(doc[kept], items.take(pa.array(kept)).to_pylist()):
                by[d].append(x)
            assert by == [spans.greedy(d, block, desc) for d in docs]


def test_patterns_of_batches_match_as_the_columns_do(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice([*WORDS[:-1], "marca", "de", "y", ",", "Fiat"]) for _ in range(rnd.randrange(12))) for _ in range(150)]
    rows = [("a", "A", 0, "ANY", "", [], "*"), ("b", "B", 0, "IS_PUNCT", "=", ["true"], "!"), ("b", "B", 1, "LENGTH", ">=", ["3"], "{2,3}"),
            ("c", "C", 0, "LIKE_NUM", "=", ["true"], "?"), ("c", "C", 1, "LOWER", "NOT_IN", ["de", "y"], "+"), ("d", "D", 0, "SHAPE", "IN", ["xxxx", "ddd"], "{0,2}"),
            ("d", "D", 1, "ORTH", "=", ["de"], ""), ("e", "E", 0, "LOWER", "REGEX", [r"^\p{L}a"], "+"), ("f", "F", 0, "LIKE_URL", "=", ["false"], "{2}")]
    compiled = patterns.compile_patterns(rows)
    tf = T.token_frame(spark.createDataFrame(list(enumerate([*texts, ""])), "doc_id long, text string"), offsets=False)
    both = tf.select(F.array_sort(F.concat(*[p.matches() for p in compiled])).alias("old"), F.array_sort(patterns.pattern_matches(compiled)).alias("new")).collect()
    assert sum(len(r.new) for r in both) > 500 and all(r.old == r.new for r in both)


def test_long_tables_share_their_exchanges(spark):
    tokens = spark.createDataFrame([(1, i, 5 * i, 5 * i + 4) for i in range(120)] + [(1, 7, 35, 39), (None, 0, 0, 2)], "doc_id long, i int, tstart int, tend int").repartition(2, "i")
    ann = spark.createDataFrame([(1, 250, 259, "A"), (1, 35, 44, "B"), (1, 101, 104, "C"), (1, 509, 509, "D"), (1, 511, 511, "E"), (2, 0, 4, "A"), (None, 0, 2, "A")],
                                "doc_id long, char_start int, char_end int, label string").repartition(2, "label")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tagged = intervals.biluo_rows(tokens, ann)
        spans = intervals.decode_rows(tagged, "tag")
        lines = plan(spans).split("\n")
        assert sum("+- Exchange hashpartitioning(_doc#" in x and "_b#" in x for x in lines) == 1
        assert sum("Exchange hashpartitioning(_key#" in x and "REPARTITION" in x and "Reused" not in x for x in lines) == 1
        got = sorted((r.doc_id or 0, r.i, r.tag) for r in tagged.where("tag <> 'O'").collect())
        assert got == [(1, 7, "B-B"), (1, 7, "B-B"), (1, 8, "L-B"), (1, 20, "-"), (1, 50, "B-A"), (1, 51, "L-A"), (1, 102, "-")]
        assert (1, 50, 52, "A") in [tuple(r) for r in spans.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
