"""License scans: an exact containment join of text blocks with license templates, and counts of base phrases.

Columns and functions of Spark only. Blocks are windows of words; prefix, length and positional filters on tokens in global
frequency order find every block that holds the needed share of a template's different words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.llm.common import stored, text_or_empty

#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases (all of them end in "license") and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public notices, their labels, and the words of each that must be there whatever share of the others is: they tell it from its like.
TEMPLATES = [
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "granted person"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "sublicense merchantability",
    ),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache compliance"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu redistribute"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser redistribute"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla mpl"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "fee hereby"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons"),
    ("cc", "licensed under cc by 4 0", "cc by"),
    ("cc", "licensed under cc by nc 4 0", "cc by nc"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
]
#: Templates of so many words at most are sought in blocks of twice as many, longer ones in blocks of twice the next power of two.
BLOCK = 64
THRESHOLD = 0.8
#: Score of a base phrase without a notice around it: it names a license, no more.
PHRASE_SCORE = 0.5


def step_of(template: str) -> int:
    """Words from one block to the next for a template: a passage of as many words lies whole in a block of twice as many."""
    return max(BLOCK, 1 << (len(template.split()) - 1).bit_length())


def _words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(WORD), F.lit(0))


def _places(words: Column) -> Column:
    """start and label of every base phrase, in order."""
    def at(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<start:int,label:string>")
        for phrase, label in PHRASES.items():
            *before, _ = phrase.split(" ")
            same = F.lit(True)
            for back, word in enumerate(reversed(before), 1):
                same = same & (i >= back) & (F.get(words, i - back) == word)
            out = F.when(same, F.struct((i - len(before)).alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return F.when(w == "license", out)

    none = F.array().cast("array<struct<start:int,label:string>>")
    return F.when(F.array_contains(words, "license"), F.filter(F.transform(words, at), lambda p: p.isNotNull())).otherwise(none)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Blocks are 2 * n words from every n-th word on, n by the length of a template, so a passage of n words lies whole in one.
    A template is found where a block holds threshold of its different words and all of those that it must have. Only words of
    the templates' vocabulary matter and are kept, without the text. The templates are a fixed list, so their side of the
    join and the frequencies of their words are bounded by it.
    score: the largest containment of a template reached in the document; PHRASE_SCORE at least with a base phrase, else 0.
    Null or empty text: no words, null places, empty labels, score 0. Null ids stay null, repeated rows stay repeated, an
    empty table gives an empty table, other columns are not read.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(t.split()))) for label, t, _ in templates]
    musts = [sorted(set(must.split())) for _, _, must in templates]
    if any(not set(m) <= set(s) for m, (_, s) in zip(musts, sets, strict=True)):
        raise ValueError("a word that a template must have is none of its words")
    steps = [step_of(t) for _, t, _ in templates]
    need = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    vocabulary = F.array(*map(F.lit, sorted({w for _, s in sets for w in s})))
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("k"), _words(text_or_empty(text_col)).alias("w"))

    def cut(step: int) -> Column:
        starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        least = min(n for n, x in zip(need, steps, strict=True) if x == step)
        tokens = F.transform(starts, lambda i: F.array_intersect(F.slice("w", i + 1, 2 * step), vocabulary))
        return F.transform(F.filter(tokens, lambda b: F.size(b) >= least), lambda b: F.struct(F.lit(step).alias("step"), b.alias("tokens")))

    blocks = F.concat(*map(cut, sorted(set(steps))))
    found = stored(narrow.select("row", "k", F.size("w").cast("long").alias("n_words"), _places(F.col("w")).alias("places"), blocks.alias("blocks")), "license-blocks")

    block = found.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("block", "b")).select("row", "block", "b.*")
    seen = {r["token"]: r["n"] for r in block.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    order = {w: n for n, w in enumerate(sorted({w for _, s in sets for w in s}, key=lambda w: (seen.get(w, 0), w)))}
    ordered = [sorted(s, key=order.__getitem__) for _, s in sets]
    prefix = [(w, t, i, len(s), need[t], steps[t]) for t, s in enumerate(ordered) for i, w in enumerate(s[: len(s) - need[t] + 1])]
    rare = F.array(*map(F.lit, sorted({p[0] for p in prefix})))
    place = F.create_map(*(x for w, n in order.items() for x in (F.lit(w), F.lit(n))))
    likely = block.where(F.arrays_overlap("tokens", rare)).select("row", "block", "step", F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct(F.element_at(place, w).alias("o"), w.alias("w")))), lambda s: s["w"]).alias("tokens"))
    left = spark.createDataFrame(prefix, "token string, template int, i int, size int, need int, step int")
    pairs = (
        likely.select("row", "block", "step", "tokens", F.posexplode("tokens").alias("j", "token"))
        .join(F.broadcast(left), ["token", "step"])  # a row for each prefix token of a fixed list
        .where((F.size("tokens") >= F.col("need")) & (F.col("j") <= F.size("tokens") - F.col("need")))
        .where(1 + F.least(F.col("size") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1) >= F.col("need"))
        .select("row", "block", "template", "need", "size", "tokens")
        .dropDuplicates(["row", "block", "template"])
    )
    whole = F.array(*(F.array(*map(F.lit, s)) for _, s in sets))
    labels = F.array(*(F.lit(label) for label, _ in sets))
    must = F.array(*(F.array(*map(F.lit, m)).cast("array<string>") for m in musts))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("tokens", F.get(whole, F.col("template"))))).where("common >= need").where(F.size(F.array_except(F.get(must, F.col("template")), "tokens")) == 0)
    matched = pairs.groupBy("row").agg(F.collect_set(F.get(labels, F.col("template"))).alias("more"), F.max(F.col("common") / F.col("size")).alias("best"))
    none = F.array().cast("array<string>")
    base = F.transform("places", lambda p: p["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.join(matched, "row", "left").select(
        F.col("k").alias(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("more", none))).alias("labels"),
        F.greatest(F.when(F.size("places") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0)), F.coalesce("best", F.lit(0.0))).alias("score"),
    )
