"""License scan by diagonal voting, in DataFrame functions only.

Texts are cut into words; every rolling k-gram of words is hashed and joined to the
positions where license templates have the same k-gram.  Each hit votes for the diagonal
(document position minus template position); neighbouring diagonals of a template are
merged into one span, whose votes are the distinct template positions that it hit.  A span
with enough votes is verified: each word of the template is compared with the document's words
on the span's diagonals, and the share of equal ones is its score.  Short phrases are templates
whose every k-gram must be hit on one diagonal, so a place of a phrase is exact.

Null or empty text: no words, no labels, score 0.  Repeated rows (same id and text) each
get the same row; rows that share an id only are told apart by their text.  Texts are read
whole, however long; a diagonal holds at most as many votes as the template has positions.
Of equal scores the result is the same.  An empty table gives an empty result, and extra
columns are left out.  Templates are a fixed table of this module, so broadcasting it is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, only

K = 3
#: A long template's span needs this share of its k-grams as votes, and of its words when verified.
COVER = 0.6
#: Spans up to so many bytes are broadcast to the texts that verify them; more are joined by document.
BROADCAST_BYTES = 32 << 20
#: Diagonals this close belong to one span (words inserted or left out).
NEAR = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The complement of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Passages of public licences and licence notices, and their labels.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache-2"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike", "cc-by-sa"),
    ("this work is licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost"),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "zlib"),
]


def template_grams(spark, k: int = K) -> DataFrame:
    """template, label, base, n_grams, at, gram: every k-gram of every phrase and template."""
    rows = [(i, text, label, i < len(PHRASES)) for i, (text, label) in enumerate(PHRASES + TEMPLATES)]
    t = spark.createDataFrame(rows, "template int, text string, label string, base boolean")
    t = t.withColumn("w", F.split("text", " ")).withColumn("n_grams", F.size("w") - k + 1)
    return t.select("template", "label", "base", "n_grams", F.posexplode(_grams("w", k)).alias("at", "gram"))


def _grams(words: str, k: int):
    """Hashes of all runs of k words of an array column."""
    w = F.col(words)
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))


def words(text):
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BREAK), "")


def template_words(spark) -> DataFrame:
    """template, tw: the words of every template."""
    t = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(PHRASES + TEMPLATES)], "template int, text string")
    return t.select("template", F.split("text", " ").alias("tw"))


def voted(docs: DataFrame, k: int = K, cover: float = COVER, near: int = NEAR) -> DataFrame:
    """Every place of a phrase, and every span of neighbouring diagonals with enough votes: doc_id, text_key, template, label, base, first, last, votes (a share) and diagonals."""
    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w")).where(F.size("w") >= k)
    hits = d.select("doc_id", "text_key", F.posexplode(_grams("w", k)).alias("pos", "gram"))
    hits = hits.join(F.broadcast(template_grams(docs.sparkSession, k)), "gram")
    key = ["doc_id", "text_key", "template", "label", "base", "n_grams"]
    diagonals = hits.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    # A phrase's diagonals are spans of their own; a template's are merged with their neighbours.
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(order) > near)
    spans = diagonals.withColumn("new", apart.cast("int")).withColumn("span", F.coalesce(F.sum("new").over(order), F.lit(0)))
    # Diagonals that hit the same template position give it one vote together.
    spans = spans.groupBy(*key, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"), F.array_sort(F.collect_set("diagonal")).alias("diagonals"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.col("n") / F.col("n_grams")
    fits = F.when(F.col("base"), F.col("n") == F.col("n_grams")).otherwise(share >= cover)
    return spans.where(fits).select("doc_id", "text_key", "template", "label", "base", "first", (F.col("last") + k - 1).alias("last"), share.alias("votes"), "diagonals")


def spans(docs: DataFrame, k: int = K, cover: float = COVER, near: int = NEAR, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_key, label, base, first, last, score: every place of a phrase and every verified template span."""
    v = cut(voted(docs, k, cover, near))
    out = ["doc_id", "text_key", "label", "base", "first", "last", "score"]
    phrases = v.where("base").withColumn("score", F.lit(1.0)).select(*out)
    t = v.where("not base").join(F.broadcast(template_words(docs.sparkSession)), "template").withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    size = t.agg(F.sum(100 + 4 * F.size("diagonals") + F.octet_length(F.array_join("tw", " ")))).first()[0] or 0
    t = F.broadcast(t) if size <= broadcast_bytes else t
    d = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = d.join(t, d["doc_id"].eqNullSafe(t["_id"]) & (d["text_key"] == t["_key"])).select("doc_id", "text_key", "label", "base", "first", "last", "tw", "diagonals", words(F.col("text")).alias("w"))
    same = F.transform("tw", lambda x, j: F.exists("diagonals", lambda g: (j + g >= 0) & F.get("w", (j + g).cast("int")).eqNullSafe(x)).cast("int"))
    score = F.aggregate(same, F.lit(0), lambda a, x: a + x) / F.size("tw")
    found = found.withColumn("score", score).where(F.col("score") >= cover).select(*out).distinct()
    return phrases.unionByName(found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: n_words, base places, labels and the best score."""
    d = only(docs, "doc_id", "text")
    found = spans(d).groupBy("doc_id", "text_key").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    d = d.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    d = d.join(found, d["doc_id"].eqNullSafe(found["_id"]) & (d["text_key"] == found["_key"]), "left")
    return d.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
