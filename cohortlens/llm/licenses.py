"""Operator 7: license scans by diagonal voting, in DataFrame operations only.

Every text's rolling word 3-grams are hashed and joined to the 3-grams of the templates; a hit votes for the diagonal
(place in the text minus place in the template) and is verified word by word after the join. A phrase stands where all its
3-grams vote for one diagonal. For a whole notice, neighbouring diagonals are merged, as words may be added or missing, and
the share of the template's places that vote in a span of them is its coverage. Only a gram's own words travel with it. A
closing gram keeps documents without hits, with their word counts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

GRAM = 3
#: Diagonals at most this far apart are merged; a notice is found from this coverage on.
DRIFT, COVERAGE = 4, 0.6
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Openings of public license notices, and their labels.
NOTICES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "cc-by-nc-notice": "This work is licensed under the Creative Commons Attribution-NonCommercial International License",
}
_LAST = "\x00end"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.translate(str.maketrans(UPPER, LOWER))) if w]


def templates(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(template, label, base, grams, tpos, w0, w1, w2, h): each template's 3-grams; a few hundred rows. Template -1 is the closing gram."""
    rows = [(-1, None, False, 0, 0, _LAST, None, None)]
    for k, (text, label, base) in enumerate([(t, x, True) for t, x in phrases.items()] + [(t, x, False) for x, t in notices.items()]):
        w = template_words(text)
        if len(w) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text!r}")
        rows += [(k, label, base, len(w) - GRAM + 1, i, *w[i : i + GRAM]) for i in range(len(w) - GRAM + 1)]
    out = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, tpos int, w0 string, w1 string, w2 string")
    return out.withColumn("h", F.xxhash64("w0", "w1", "w2"))


def hits(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The verified hits of all rolling 3-grams, and each row's closing gram: row, id, n_words, template, label, base, grams, tpos, pos."""
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        words(F.col(text_col).cast("string")).alias("words")).withColumn("n_words", F.size("words"))

    def gram(a, b, c):
        return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"))

    none = F.lit(None).cast("string")
    rolling = F.transform(F.slice("words", 1, F.greatest(F.size("words") - (GRAM - 1), F.lit(0))), lambda w, i: gram(w, F.get("words", i + 1), F.get("words", i + 2)))
    grams = src.select("row", "id", "n_words", F.posexplode(F.concat(rolling, F.array(gram(F.lit(_LAST), none, none)))).alias("pos", "g"))
    grams = grams.select("row", "id", "n_words", "pos", "g.h", "g.a", "g.b", "g.c")
    same = (F.col("template") == -1) | ((F.col("a") == F.col("w0")) & (F.col("b") == F.col("w1")) & (F.col("c") == F.col("w2")))
    return grams.join(F.broadcast(found), "h").filter(same).select("row", "id", "n_words", "template", "label", "base", "grams", "tpos", "pos")  # found: a few hundred rows


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Phrases count wherever all their words stand consecutively; first_word and last_word are their smallest and largest
    start, null without any. labels adds the notices that are covered to COVERAGE or more. score: 1 with a phrase, else the
    best coverage. Null and empty texts have no words, labels '' and score 0; repeated rows are each counted on their own.

    A chain of merged diagonals may be far longer than a notice where the text repeats the template's phrases. It is looked
    at through spans twice as long as the template, each half over the last, and a place of the template counts once in each.
    """
    fixed = ["row", "id", "n_words", "template", "label", "base", "grams"]  # what row and template determine
    diagonal = hits(docs, templates(docs.sparkSession, phrases, notices), id_col, text_col).groupBy(*fixed, (F.col("pos") - F.col("tpos")).alias("diagonal"))
    diagonal = diagonal.agg(F.count("*").alias("votes"), F.min("pos").alias("low"), F.collect_set(F.when(~F.col("base"), F.col("tpos"))).alias("places"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > DRIFT, F.lit(True))
    island = diagonal.withColumn("apart", apart).withColumn("island", F.max(F.when(F.col("apart"), F.col("diagonal"))).over(line))
    step = F.floor((F.col("diagonal") - F.col("island")) / F.greatest(F.col("grams"), F.lit(1)))
    island = island.withColumn("step", step).withColumn("span", F.explode(F.when(F.col("step") > 0, F.array(F.col("step") - 1, F.col("step"))).otherwise(F.array("step"))))
    spans = island.groupBy(*fixed, "island", "span").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    phrase = F.col("base") & (F.col("votes") == F.col("grams"))
    covered = F.when(F.col("base"), phrase.cast("double")).when(F.col("template") < 0, 0.0).otherwise(F.col("places") / F.greatest(F.col("grams"), F.lit(1)))
    spans = spans.withColumn("cover", covered)
    found = F.col("cover") >= COVERAGE
    join = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    return spans.groupBy("row", "id").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(phrase).alias("n_base"),
        F.min(F.when(phrase, F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(phrase, F.col("low"))).cast("long").alias("last_word"),
        join(phrase).alias("base_labels"),
        join(found).alias("labels"),
        F.max("cover").alias("score"),
    ).drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
