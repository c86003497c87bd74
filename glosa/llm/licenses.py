"""License scans (operator 4): sparse TF-IDF cosine to templates, then directory inheritance.

Units are the header lines of each file (lines with a licence word, anywhere in the
text) and, for licence files, the whole text.  Units and templates become sparse
TF-IDF rows; document frequencies count all distinct units of the corpus and all
templates.  A unit takes the template of the greatest cosine if that is at least
``LEAST``.  A unit below it is cut into pieces, weighted alike: its sentences with a
licence word, and around each licence word a window for each template, cut as the
template lies around its own first one, so that a notice inside a long line is met
word for word.  SPDX identifiers count as templates of their own words (cosine 1):
``SPDX-License-Identifier: X`` gives X, known names as the templates write them, the
endings -only, -or-later and + and exceptions (WITH) left out, and every identifier
of an AND or OR expression.  A file takes its best unit.  A licence file (LICENSE, LICENCE, COPYING,
UNLICENSE, NOTICE, with any ending) speaks for its directory; a file without a
licence of its own inherits from the nearest directory above it that has one.

Distinct units are compared once however many files repeat them, and ancestors
are looked up once per directory, so a notice or directory that a third of all
files share costs no more than a rare one until the last join, which carries one
short row per file.  Only DataFrame functions.

Defined results: null text has no units; a null path is in no directory; of
several licence files in one directory the greatest cosine decides, then the
name of the licence; repeated rows are each answered; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosa.llm.common import blank, broadcast_if_small, written

LEAST = 0.6
#: Usual notices and the opening words of licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
MARK = r"(?i)licen[sc]e|copyright|spdx|public domain|permission is hereby|redistribution and use"
LICENCE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicense|notice)(?:[.-].*)?$"
WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
ANCHOR = r"licen[sc]e|copyright|spdx|public|permission|redistribution"  # words that begin a match of MARK
SENTENCE_END = r"(?<=[.!?;])\s+"
SPDX_ID = r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*\+?"
SPDX = rf"(?i:spdx-license-identifier):[ \t(\"'`]*({SPDX_ID}(?:[ \t()]+(?:AND|OR|WITH)[ \t()]+{SPDX_ID})*)"
SPDX_NONE = ("none", "noassertion")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def word_counts(rows: DataFrame, found: Column, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode(found).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf"))


def weighted(units: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uid, word, w), (template, license, word, w, norm) and (word, idf): TF-IDF rows.  Rows carry
    the number of their unit, not its text."""
    unit_words = written(word_counts(units, words(F.col("unit")), "uid"), "unit-words")
    template_words = word_counts(templates, words(F.col("template")), "template", "license")
    n = units.count() + templates.count()
    seen = unit_words.select("word").unionByName(template_words.select("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = written(seen.select(F.col("word").alias("__w"), (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf")), "idf")
    t = with_weights(template_words, idf, "template", "license")
    norms = t.groupBy(F.col("template").alias("__t")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    t = t.join(norms, F.col("template") == F.col("__t")).select("template", "license", F.col("word").alias("t_word"), F.col("w").alias("t_w"), "t_norm")
    return with_weights(unit_words, idf, "uid"), written(t, "template-weights"), idf


def with_weights(counts: DataFrame, idf: DataFrame, *keys: str) -> DataFrame:
    return counts.join(idf, F.col("word") == F.col("__w")).select(*keys, "word", (F.col("tf") * F.col("idf")).alias("w"))


def nearest_template(u: DataFrame, t: DataFrame, least: float) -> DataFrame:
    """(uid, license, cosine) of the weighted units that reach ``least``."""
    norms = u.groupBy(F.col("uid").alias("__u")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = u.join(broadcast_if_small(t), F.col("word") == F.col("t_word")).groupBy("uid", "template", "license", "t_norm").agg(
        F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 4)
    near = dots.join(norms, F.col("uid") == F.col("__u")).select("uid", "license", cosine.alias("cosine")).where(F.col("cosine") >= least)
    return best_of(near, "uid")


def window_shapes() -> list[tuple[int, int]]:
    """Words before and after the first licence word, for each template."""
    shapes = set()
    for _, text in TEMPLATES:
        found = re.findall(WORDS, text.lower())
        first = next(i for i, w in enumerate(found) if re.search(ANCHOR, w))
        shapes.add((first, len(found) - first - 1))
    return sorted(shapes)


def unit_pieces(units: DataFrame) -> DataFrame:
    """(uid, piece): sentences and windows of the units, as words with a space between."""
    at = F.transform(words(F.col("unit")), lambda w, i: F.when(F.regexp_like(w, F.lit(ANCHOR)), i + 1))
    marked = F.filter(F.split("unit", SENTENCE_END), lambda x: F.regexp_like(x, F.lit(MARK)))
    rows = written(units.select("uid", words(F.col("unit")).alias("words"), F.filter(at, lambda i: i.isNotNull()).alias("at"),
                                F.transform(marked, lambda x: F.array_join(words(x), " ")).alias("sentences")), "unit-positions")
    n = F.size("words")

    def windows(before: int, after: int) -> Column:
        inside = F.filter("at", lambda i: (i > before) & (i + after <= n))
        return F.transform(inside, lambda i: F.array_join(F.slice("words", i - before, F.lit(before + after + 1)), " "))

    every = F.concat("sentences", *[windows(*s) for s in window_shapes()])
    return rows.select("uid", F.explode(F.array_distinct(every)).alias("piece")).where("piece <> ''")


def declared(units: DataFrame) -> DataFrame:
    """(uid, license, cosine) of the SPDX identifiers in the units."""
    known = F.create_map(*[F.lit(x) for name in sorted({name for name, _ in TEMPLATES}) for x in (name.lower(), name)])
    stated = units.select("uid", F.explode(F.regexp_extract_all("unit", F.lit(SPDX), F.lit(1))).alias("said"))
    alone = F.regexp_replace("said", rf"[ \t()]+WITH[ \t()]+{SPDX_ID}", "")
    ids = stated.select("uid", F.explode(F.split(alone, r"[ \t()]+(?:AND|OR)[ \t()]+")).alias("id"))
    ids = ids.select("uid", F.regexp_replace("id", r"(?i)(?:-only|-or-later|\+)$", "").alias("id")).where(~F.lower("id").isin(*SPDX_NONE))
    return ids.select("uid", F.coalesce(known[F.lower("id")], F.col("id")).alias("license"), F.lit(1.0).alias("cosine"))


def matched(units: DataFrame, spark: SparkSession, least: float) -> DataFrame:
    """(uid, license, cosine) of the distinct units (uid, unit) that match a template, as a whole
    or by a piece, or that state an SPDX identifier."""
    templates = spark.createDataFrame([(text, name) for name, text in TEMPLATES], "template string, license string")
    u, t, idf = weighted(units, templates)
    whole = written(nearest_template(written(u, "unit-weights"), t, least).unionByName(declared(units)), "whole-units")
    rest = units.join(whole.select(F.col("uid").alias("__uid")).distinct(), F.col("uid") == F.col("__uid"), "left_anti")
    each = written(unit_pieces(rest).withColumn("key", F.sha2("piece", 256)), "unit-pieces")
    pieces = each.groupBy("key").agg(F.first("piece").alias("piece")).withColumn("uid", F.monotonically_increasing_id())
    pieces = written(pieces, "pieces")
    p = written(with_weights(word_counts(pieces, F.split("piece", " "), "uid"), idf, "uid"), "piece-weights")
    near = nearest_template(p, t, least).join(pieces.select(F.col("uid").alias("__uid"), F.col("key").alias("__key")), F.col("uid") == F.col("__uid"))
    inside = each.join(near.select("__key", "license", "cosine"), F.col("key") == F.col("__key")).select("uid", "license", "cosine")
    return best_of(whole.unionByName(inside), "uid")


def best_of(near: DataFrame, key: str) -> DataFrame:
    return near.groupBy(key).agg(best_license().alias("b")).select(key, "b.license", (-F.col("b.less")).alias("cosine"))


def best_license() -> Column:
    """The greatest cosine, then the first name."""
    return F.min(F.struct((-F.col("cosine")).alias("less"), "license"))


def directory(path: Column) -> Column:
    """The part before the last slash; empty for the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, the top (empty) last."""
    parts = F.split(folder, "/")
    ups = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(ups, F.array(F.lit(""))))


def license_scan(files: DataFrame, file_id: str = "doc_id", path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, path, license, cosine, origin, from_dir), one row per input row.  ``origin``:
    header, file, inherited, or null without a licence."""
    spark = files.sparkSession
    name = F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"(?s)([^/]*)$", 1)
    is_licence = F.regexp_like(name, F.lit(LICENCE_FILE))
    lines = F.filter(F.split(blank(text), "\n"), lambda x: F.regexp_like(x, F.lit(MARK)))
    units = F.array_distinct(F.concat(lines, F.when(is_licence, F.array(blank(text))).otherwise(F.array().cast("array<string>"))))
    rows = files.select(F.col(file_id).alias("doc_id"), F.col(path).alias("path"), is_licence.alias("is_licence"), units.alias("units"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "license-units")  # header lines only, no texts but licence files'
    each = rows.select("row", F.explode("units").alias("unit")).withColumn("key", F.sha2("unit", 256))
    units = written(each.groupBy("key").agg(F.first("unit").alias("unit")).withColumn("uid", F.monotonically_increasing_id()), "units")
    found = matched(units, spark, least).join(units.select(F.col("uid").alias("__uid"), F.col("key").alias("__key")), F.col("uid") == F.col("__uid"))
    found = written(found.select("__key", "license", "cosine"), "unit-licenses")
    own = each.select("row", "key").join(found, F.col("key") == F.col("__key")).groupBy("row").agg(best_license().alias("own"))
    rows = rows.drop("units").join(own.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"), "left").select(
        "doc_id", "path", "is_licence", directory(F.col("path")).alias("folder"), F.col("own.license").alias("license"), (-F.col("own.less")).alias("cosine"))
    rows = written(rows, "own-licenses")
    speaks = rows.where("is_licence and license is not null and folder is not null").groupBy(F.col("folder").alias("above")).agg(best_license().alias("b"))
    folders = rows.where("license is null and folder is not null").select("folder").distinct()
    nearest = folders.select("folder", F.posexplode(ancestors(F.col("folder"))).alias("steps", "up")).join(speaks, F.col("up") == F.col("above")).groupBy(
        F.col("folder").alias("__folder")).agg(F.min(F.struct("steps", "up", F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"))).alias("near"))
    out = rows.join(nearest, F.col("license").isNull() & (F.col("folder") == F.col("__folder")), "left")
    origin = F.when(F.col("license").isNotNull(), F.when(F.col("is_licence"), "file").otherwise("header")).when(F.col("near").isNotNull(), "inherited")
    return out.select("doc_id", "path", F.coalesce("license", "near.license").alias("license"), F.coalesce("cosine", "near.cosine").alias("cosine"),
                      origin.alias("origin"), F.when(F.col("license").isNull(), F.col("near.up")).alias("from_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files of a tree: source, language, a folder per hundred ids.  The table
    has no paths; a document that opens with a notice stands for its folder's licence file."""
    opens = F.regexp_like(blank("text"), F.lit(r"^(?:Licensed under|Released under|This work is licensed under) "))
    name = F.when(opens, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"))
    return docs.withColumn("path", F.concat(folder, F.lit("/"), name))
