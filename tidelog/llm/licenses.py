"""License scans by diagonal voting.

All rolling pairs of words of all documents are joined to the places where they stand in the license templates. A
match votes for the offset (the diagonal) at which the template would start in the document. A template whose pairs all vote for one
diagonal stands there word for word; for longer templates, neighbouring diagonals are merged, so that some words may be
changed, added or left out, and the merged span is verified by the share of the template that it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Between words: ASCII other than lower-case letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

# Openings, notices and a whole text of well-known licenses, by the label they give.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
        "event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software"
    ),
    "mit-notice": "released under the mit license",
}

#: Diagonals this close may belong to one copy of a template.
DRIFT = 2
#: Share of a template's pairs that a span must cover.
COVER = 0.8


def templates(spark: SparkSession, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``pair, template, label, exact, place, pairs``: each rolling pair of words of each template, of two words or more."""
    rows, number = [], 0
    for exact, phrases in ((True, base), (False, notices)):
        for label, text in phrases.items():
            w = text.split()
            if len(w) < 2:
                raise ValueError(f"a template has two words or more: {text!r}")
            rows += [(f"{w[i]} {w[i + 1]}", number, label, exact, i, len(w) - 1) for i in range(len(w) - 1)]
            number += 1
    return spark.createDataFrame(rows, "pair string, template int, label string, exact boolean, place int, pairs int")


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``, a row for each row of ``docs``.

    ``spans`` are the verified places, as ``(label, first word, last word, share covered)``. ``score`` is 1 with a base phrase, else the best
    share covered. Pairs are joined by their text, so that no two different pairs ever meet. Templates may be of any length.

    Defined cases: null and empty texts have no words; null ids are kept; rows repeated exactly are each kept (documents
    alike in id and text are scanned as one and written out again); places may overlap and count each;
    an empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), GAP), lambda w: w != "")
    d = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.length("text").alias("text_len"), words.alias("w"))
    d = d.select("doc_id", "text_key", "text_len", F.size("w").cast("long").alias("n_words"), "w")
    # all rolling pairs; place -1 stands for the document itself, so that none is lost
    d = d.select("doc_id", "text_key", "text_len", "n_words", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("n_words") - 2, F.lit(-1)).cast("int"))).alias("at"))
    d = d.select("doc_id", "text_key", "text_len", "n_words", "at", F.when(F.col("at") >= 0, F.concat_ws(" ", F.get("w", F.col("at")), F.get("w", F.col("at") + 1))).alias("pair"))
    hit = d.join(F.broadcast(templates(spark, base, notices)), "pair", "left").where(F.col("template").isNotNull() | (F.col("at") == -1))
    who = ["doc_id", "text_key", "text_len", "n_words"]
    votes = hit.groupBy(*who, "template", "label", "exact", "pairs", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("seen"), F.count("*").alias("rows"))
    # neighbouring diagonals of a template, in order of the diagonal: the places seen on any, and the most on one
    about = Window.partitionBy(*who, "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    votes = votes.withColumn("merged", F.size(F.array_distinct(F.flatten(F.collect_list("seen").over(about))))).withColumn("most", F.max(F.size("seen")).over(about))
    cover = F.col("merged") / F.col("pairs")
    span = lambda last, share: F.struct("label", F.greatest("diagonal", F.lit(0)).cast("long").alias("first"), last.cast("long").alias("last"), share.alias("cover"))
    whole = F.col("exact") & (F.size("seen") == F.col("pairs"))
    close = ~F.col("exact") & (cover >= COVER) & (F.size("seen") >= F.col("most"))
    end = F.col("diagonal") + F.col("pairs")
    per = votes.groupBy(*who).agg(
        F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("copies"),
        F.array_sort(F.collect_list(F.when(whole, span(end, F.lit(1.0))))).alias("b"),
        F.array_sort(F.collect_list(F.when(close, span(F.least(end, F.col("n_words") - 1), cover)))).alias("m"),
        F.coalesce(F.max(F.when(~F.col("exact"), cover)), F.lit(0.0)).alias("best"),
    )
    named = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x.label))), ",")
    at = F.transform("b", lambda x: x["first"])
    out = per.select("doc_id", "n_words", "copies", F.size("b").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), named(F.col("b")).alias("base_labels"), F.concat("b", "m").alias("spans"), "best")
    out = out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", named(F.col("spans")).alias("labels"),
                      F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("best")).alias("score"), "spans")
