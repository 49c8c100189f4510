"""License scans by diagonal voting (DataFrame functions only).

All rolling word k-grams of a text are joined to the k-grams of the templates; a gram at word p of the text
and word t of the template votes for the diagonal p - t. Phrases need all their grams on one diagonal. Longer
templates merge neighbouring diagonals, which small insertions and deletions split; the merged span is then
verified: enough of its words must be the template's, and enough of the template's words must stand in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardstone.llm.common import shared_table, words_of

PHRASE_GRAM, TEXT_GRAM = 2, 4
DRIFT = 4  # diagonals apart that still belong to one copy of a template
SHARE = 0.5  # of a template's words that a copy needs, and of a copy's words that the template needs

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Opening words of public license texts and usual notices, as their publishers word them
TEXTS = {
    "mit-notice": "released under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-3.0-notice": "licensed under the gnu general public license version 3",
    "cc-by-notice": "licensed under a creative commons attribution 4 0 international license",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0-text": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    "gpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-text": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "agpl-text": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "epl-2.0-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "cc0-notice": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-text": "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "bsd-2-clause-text": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3-clause-text": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}


def template_grams(spark: SparkSession, phrases: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """(label, phrase, grams, k, t, gram): the word k-grams of every template; a row per template word, so of fixed size."""
    rows = []
    for phrase, k, given in ((True, PHRASE_GRAM, phrases), (False, TEXT_GRAM, texts)):
        for label, text in given.items():
            w = text.split()
            rows += [(label, phrase, len(w) - k + 1, k, t, " ".join(w[t : t + k]), " ".join(w[t : t + 2])) for t in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "label string, phrase boolean, grams int, k int, t int, gram string, head string")


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, text_hash, label, phrase, grams, k, pos, t): every place where a text has a template's gram, once."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "word"))
    rows = rows.withColumn("hash", F.xxhash64("word", F.get("words", F.col("pos") + 1)))
    heads = grams.select(F.xxhash64(F.split("head", " ")[0], F.split("head", " ")[1]).alias("hash")).distinct()
    near = rows.join(F.broadcast(heads), "hash")  # all rolling grams against the templates' leading word pairs
    sizes = F.explode(F.array(F.lit(PHRASE_GRAM), F.lit(TEXT_GRAM)))
    near = near.select("doc_id", "text_hash", "pos", F.slice("words", F.col("pos") + 1, TEXT_GRAM).alias("ahead")).select("doc_id", "text_hash", "pos", "ahead", sizes.alias("k"))
    near = near.where(F.size("ahead") >= F.col("k")).withColumn("gram", F.array_join(F.slice("ahead", F.lit(1), F.col("k")), " "))
    return near.join(F.broadcast(grams.drop("head")), ["k", "gram"]).select("doc_id", "text_hash", "label", "phrase", "grams", "k", "pos", "t").distinct()


def copies(hit: DataFrame) -> DataFrame:
    """(doc_id, text_hash, label, start, end, share) of the verified copies among the votes for longer templates.

    Votes on neighbouring diagonals make one candidate. Its span runs from its first voting word to the end of
    its last voting gram; the words inside that grams cover must be at least SHARE of the span, and the
    template's words that they cover at least SHARE of the template. share is the smaller of the two.
    """
    line = hit.groupBy("doc_id", "text_hash", "label", "diagonal").agg(F.collect_list(F.struct("pos", "t")).alias("votes"), F.first("grams").alias("grams"), F.first("k").alias("k"))
    own = Window.partitionBy("doc_id", "text_hash", "label").orderBy("diagonal")
    line = line.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > DRIFT, F.lit(True)).cast("int")).withColumn("copy", F.sum("new").over(own))
    copy = line.groupBy("doc_id", "text_hash", "label", "copy").agg(F.flatten(F.collect_list("votes")).alias("votes"), F.first("grams").alias("grams"), F.first("k").alias("k"))
    places = lambda name: F.array_sort(F.array_distinct(F.transform("votes", lambda v: v[name])))
    copy = copy.select("doc_id", "text_hash", "label", "grams", "k", places("pos").alias("p"), places("t").alias("ts"))

    def covered(at: str) -> Column:
        """Words under the k-grams that begin at the sorted places."""
        zero = F.struct(F.lit(0).alias("words"), F.lit(-1).alias("upto"))
        return F.aggregate(at, zero, lambda a, x: F.struct((a.words + x + F.col("k") - F.greatest(x, a.upto)).alias("words"), (x + F.col("k")).alias("upto")))["words"]

    start, end = F.get("p", F.lit(0)), F.element_at("p", -1) + F.col("k")
    share = F.least(covered("p") / (end - start), covered("ts") / (F.col("grams") + F.col("k") - 1))
    return copy.select("doc_id", "text_hash", "label", start.cast("long").alias("start"), end.cast("long").alias("end"), share.alias("share")).where(F.col("share") >= SHARE)


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, copies) of every row of docs.

    n_base counts the places of the phrases (first_word and last_word their smallest and largest start, null
    without any); labels adds the templates found; score is the largest verified share of a template, 1 for a
    phrase, 0 for nothing; copies lists the templates' verified spans as structs of start, end (words, end
    exclusive), label and share, sorted. A null text is empty. Rows that repeat get their own text's results;
    other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hit = shared_table(votes(docs, template_grams(docs.sparkSession, phrases, texts)), "votes").withColumn("diagonal", F.col("pos") - F.col("t"))
    place = hit.where("phrase").groupBy("doc_id", "text_hash", "label", "diagonal").agg(F.count("*").alias("n"), F.first("grams").alias("grams")).where("n = grams")
    base = place.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base"))

    copy = copies(hit.where("not phrase"))
    more = copy.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.collect_list(F.struct("start", "end", "label", "share")).alias("copies"))

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    for side in (base, more):
        side = side.withColumnsRenamed({"doc_id": "of", "text_hash": "of_hash"})
        rows = rows.join(side, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left").drop("of", "of_hash")
    none = F.array().cast("array<string>")
    found = F.coalesce("base", none)
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(found), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(found, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size(found) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.array_sort(F.coalesce("copies", F.array().cast("array<struct<start:bigint,end:bigint,label:string,share:double>>"))).alias("copies"),
    )
