"""License scans (operator 8): diagonal voting.

All rolling 3-word hashes of every document are joined to the template positions (a table of
fixed size). A hit at word i on template position j votes for diagonal i - j; votes are
aggregated by diagonal. Each diagonal is merged with its neighbours that begin at most half a template
later, so a span is at most 1.5 times as long as its template however many diagonals lie side by side; it is verified by the
share of template positions that it covers. Of verified spans that begin within ``DRIFT`` words of each other the one
that covers most stays. The base phrases are templates too: a diagonal that has all of a phrase's positions is a place of the phrase.

Cases. Null text is empty. Fewer than three words: no grams, no labels. Rows that repeat doc_id and text get the
same result; a null doc_id stays null. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import back, cut, doc_ids, rolling, word_hashes

K, DRIFT, COVERAGE, STRETCH = 3, 4, 0.6, 1.5
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening passages of public licences.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial License",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def words(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(_LOWER))


def templates() -> list[tuple[int, str, bool, list[str]]]:
    named = [(label, True, words(phrase)) for phrase, label in BASE.items()] + [(label, False, words(t)) for label, t in TEMPLATES.items()]
    return [(i, label, base, w) for i, (label, base, w) in enumerate(named)]


@lru_cache(1)
def _inside() -> np.ndarray:
    """Code points of WORDS, upper case too."""
    return np.fromiter((c > 127 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), 500):
            part = batch.iloc[i : i + 500]
            yield pd.DataFrame({"doc_id": part["doc_id"], "key": part["key"], "grams": [rolling(h, K).view(np.int64) for h in word_hashes(part["text"], _inside(), "ascii")]})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "n_words": [len(h) for h in word_hashes(batch["text"], _inside(), "ascii")]})


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, template, label, base, first_pos, last_pos, coverage of every verified span."""
    rows = []
    for i, label, base, w in templates():
        grams = rolling(next(word_hashes([" ".join(w)], _inside(), "ascii")), K).view(np.int64).tolist()
        rows += [(g, i, label, base, j, len(grams)) for j, g in enumerate(grams)]
    places = docs.sparkSession.createDataFrame(rows, "gram long, template int, label string, base boolean, j int, size int")
    grams = doc_ids(docs, "key", "text").mapInPandas(_grams, "doc_id string, key long, grams array<long>").select("doc_id", "key", F.posexplode("grams").alias("i", "gram"))
    votes = grams.join(F.broadcast(places), "gram").groupBy("doc_id", "key", "template", "label", "base", "size", (F.col("i") - F.col("j")).alias("diagonal"))
    votes = votes.agg(F.collect_set("j").alias("js"), F.min("i").alias("first_pos"), F.max("i").alias("last_pos"))
    # Read twice below, so the documents are scanned once for it.
    votes, place = cut(votes, "votes"), ["doc_id", "key", "template"]
    phrases = votes.where(F.col("base") & (F.size("js") == F.col("size"))).select(*place, "label", "base", "size", "diagonal", "first_pos", "last_pos", F.size("js").alias("covered"))
    reach = F.floor(F.col("size") * (STRETCH - 1))
    w = Window.partitionBy(*place).orderBy("diagonal").rangeBetween(0, int(max(len(t[3]) for t in templates()) * (STRETCH - 1)))
    ahead = votes.where(~F.col("base")).withColumn("ahead", F.collect_list(F.struct("diagonal", "js", "first_pos", "last_pos")).over(w))
    ahead = ahead.withColumn("ahead", F.filter("ahead", lambda x: x["diagonal"] - F.col("diagonal") <= reach))
    spans_ = ahead.select(
        *place, "label", "base", "size", "diagonal", F.array_min("ahead.first_pos").alias("first_pos"), F.array_max("ahead.last_pos").alias("last_pos"), F.size(F.array_distinct(F.flatten("ahead.js"))).alias("covered")
    ).where(F.col("covered") >= COVERAGE * F.col("size"))
    by = Window.partitionBy(*place).orderBy("diagonal")
    step = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT).cast("int"), F.lit(1))
    islands = spans_.withColumn("step", step).withColumn("island", F.sum("step").over(by))
    best = Window.partitionBy(*place, "island").orderBy(F.desc("covered"), "diagonal")
    whole = islands.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("step", "island", "rn")
    return phrases.unionByName(whole).withColumn("coverage", F.col("covered") / F.col("size"))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    found = spans(docs).groupBy("doc_id", "key").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score"),
    )
    found = cut(found, "spans").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    counted = doc_ids(docs, "key", "text").mapInPandas(_count, "doc_id string, key long, n_words long")
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return back(joined).select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
