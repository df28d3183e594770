"""License scans by diagonal voting: word k-grams meet template positions, offsets vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.llm.common import ascii_lower

# The phrases of the base, and the wording of well-known public license notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction including without limitation "
           "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
              "with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Words of a gram in notices; phrases are as short as two words and vote by two.
GRAM, SHORT = 3, 2
#: Diagonals this near each other are one alignment; share of a notice's grams that verifies it.
NEAR, LEAST_SHARE = 4, 0.5
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates(spark: SparkSession) -> DataFrame:
    """Every gram of every template with its position; a small table of fixed size."""
    rows = []
    for notice, texts, k in ((False, PHRASES, SHORT), (True, NOTICES, GRAM)):
        for number, item in enumerate(texts.items()):
            (words, label) = (item[1].split(), item[0]) if notice else (item[0].split(), item[1])
            grams = len(words) - k + 1
            for at in range(grams):
                three = words[at + 2] if k == GRAM else None
                rows.append((notice, number, label, grams, at, words[at], words[at + 1], three))
    schema = "notice boolean, template int, label string, grams int, at int, t1 string, t2 string, t3 string"
    return spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64("t1", "t2"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Every rolling gram of every text is joined by its hash to the templates' positions (words are compared
    too, so a hash decides nothing). Hits are counted per document, template and diagonal, the offset between the
    text's and the template's position. A phrase stands where one diagonal has all its grams. Neighbouring diagonals
    of a notice are merged and the alignment is verified by the share of its grams that were met. Null texts are
    empty; texts without words have no places; repeated rows are counted apart; an empty table gives an empty result.
    """
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), _GAP), "")
    rows = docs.select(F.col(key).alias("id"), words.alias("words")).withColumn("uid", F.monotonically_increasing_id())
    size = F.size("words")
    # The number of words rides on the first gram: nothing that is computed from the text stands beside the generator.
    grams = F.arrays_zip(
        F.col("words").alias("w1"), F.slice("words", 2, size).alias("w2"), F.slice("words", 3, size).alias("w3"),
        F.array(size.cast("long")).alias("n"))
    rolled = rows.select("uid", "id", F.posexplode(grams).alias("pos", "g"))
    rolled = rolled.select("uid", "id", "pos", "g.*").withColumn("gram", F.xxhash64("w1", "w2"))
    met = (
        (F.col("gram") == F.col("hash")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
        & (F.col("t3").isNull() | (F.col("w3") == F.col("t3")))
    )
    hits = rolled.join(F.broadcast(templates(docs.sparkSession)), met, "left")
    hits = hits.filter("template IS NOT NULL OR pos = 0")  # one row of every document stays
    diagonal = (F.col("pos") - F.col("at")).alias("diagonal")
    votes = hits.groupBy("uid", "id", "notice", "template", "label", "grams", diagonal).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    line = W.partitionBy("uid", "notice", "template").orderBy("diagonal")
    apart = ~F.col("notice") | (F.col("diagonal") - F.lag("diagonal", 1, -1 << 30).over(line) > NEAR)
    merged = votes.withColumn("group", F.sum(F.when(apart, 1).otherwise(0)).over(line)).groupBy(
        "uid", "id", "notice", "template", "label", "grams", "group"
    ).agg(F.max("n").alias("n"), F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    fits = (F.col("high") - F.col("low") + 1) <= 2 * F.col("grams")
    base = F.coalesce(~F.col("notice") & (share == 1.0), F.lit(False))
    verified = base | F.coalesce(F.col("notice") & (share >= LEAST_SHARE) & fits, F.lit(False))
    last = F.col("high") + F.when(F.col("notice"), GRAM).otherwise(SHORT)
    found = merged.withColumns({"share": share, "base": base, "ok": verified}).groupBy("uid", "id").agg(
        F.max("n").alias("n_words"),
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("low"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("ok"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("low", last.alias("end"), "label", "share")))).alias("spans"),
    )
    listed = {c: F.array_join(F.array_sort(c), ",") for c in ("base_labels", "labels")}
    return found.withColumns(listed).withColumnRenamed("id", key).drop("uid")
