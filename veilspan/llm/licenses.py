"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined with the k-grams of a fixed
set of license templates. Each hit (checked word by word, so a hash collision is no hit)
votes for the diagonal `text position - template position`. Votes are added up a diagonal,
neighbouring diagonals (words inserted or left out) are merged into spans, and a span is
verified by the share of the k-grams it covers that voted.

Beside that, short base phrases are counted wherever their words stand consecutively.

One walk over the texts: it counts the words, finds the phrases and keeps the k-grams whose
hash may be a template's (a bit table of 2^16 hash ends lets one in fifty of the others
pass). What it finds is written once, a few dozen bytes a row, and the join, the votes and the
spans work on that.

Defined results: null, empty and wordless texts have no words, places or labels and score 0.
Very long texts are scanned whole. Every row is judged by itself, whatever its id: null and
repeated ids, and repeated rows, each get their own result. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.llm.textexpr import ALNUM_RE, ascii_lower, gram_hashes, pinned, words
from veilspan.session import materialize

K = 3
#: Diagonals at most this far apart belong to one span.
DRIFT = 3
#: A span is verified if this share of the k-grams it covers voted, and either six tenths of the
#: template's k-grams or MIN_VOTES of them did.
MIN_VOTES, MIN_SHARE = 8, 0.6

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Openings and notices of public licenses, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def template_words(text: str) -> list[str]:
    return re.findall(ALNUM_RE, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(hash, template, label, place, gram, size): a constant table, a few hundred rows.

    size: the template's k-grams; a label in several templates keeps them apart.
    """
    rows = []
    for number, (label, text) in enumerate(templates):
        tokens = template_words(text)
        for i in range(len(tokens) - k + 1):
            rows.append((number, label, i, " ".join(tokens[i : i + k]), len(tokens) - k + 1))
    table = spark.createDataFrame(rows, "template int, label string, place int, gram string, size int")
    parts = F.split("gram", " ")
    return table.withColumn("hash", F.xxhash64(*[F.xxhash64(parts[j]) for j in range(k)]))


def may_be(hashes: list[int]) -> Callable[[Column], Column]:
    """A test whether a hash may be one of `hashes`: its last 16 bits in a bit table."""
    table = [0] * 1024
    for h in hashes:
        table[h >> 6 & 1023] |= 1 << (h & 63)
    bits = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x) for x in table])
    return lambda h: F.getbit(F.get(bits, F.shiftright(h, 6).bitwiseAND(F.lit(1023)).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def phrase_starts(phrases) -> Column:
    """(i, p) for every word i of `_w` where phrase number p starts."""
    heads = sorted({p.split()[0] for p, _ in phrases})

    def found(i: Column) -> Column:
        out = F.lit(None).cast("int")
        for number, (phrase, _) in enumerate(phrases):
            fits = F.lit(True)
            for j, w in enumerate(phrase.split()):
                fits = fits & F.coalesce(F.get("_w", i + j) == w, F.lit(False))
            out = F.when(fits, F.lit(number)).otherwise(out)
        return out

    return F.filter(F.transform("_w", lambda w, i: F.when(w.isin(heads), F.struct(i.alias("i"), found(i).alias("p")))), lambda x: x["p"].isNotNull())


def walked(documents: DataFrame, text: str, id_column: str, phrases, templates, k: int) -> DataFrame:
    """id, _row (a number of the row), n_words, _s (phrase starts) and _hits (k-grams that may be a template's); written once."""
    grams = template_grams(documents.sparkSession, templates, k)
    may = may_be([r[0] for r in grams.select("hash").distinct().collect()])
    rows = documents.select(F.col(id_column).alias("_id"), pinned(words(ascii_lower(F.col(text)), ALNUM_RE)).alias("_w"))
    rows = rows.select("_id", "_w", pinned(F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"))
    rows = rows.select("_id", "_w", pinned(F.filter(F.transform(gram_hashes(F.col("_h"), k), lambda h, i: F.when(may(h), F.struct(i.alias("pos"), h.alias("hash")))), lambda x: x.isNotNull())).alias("_m"))
    hits = F.transform("_m", lambda x: F.struct(x["pos"].alias("pos"), x["hash"].alias("hash"), F.concat_ws(" ", *[F.get("_w", x["pos"] + j) for j in range(k)]).alias("gram")))
    rows = rows.select("_id", F.monotonically_increasing_id().alias("_row"), F.size("_w").cast("long").alias("n_words"), phrase_starts(phrases).alias("_s"), hits.alias("_hits"))
    return materialize(rows, "walked").withColumnRenamed("_id", id_column)


def diagonal_spans(rows: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(_row, template, label, start, end, votes, share, size): verified spans of what `walked` gives."""
    hits = rows.where(F.size("_hits") > 0).select("_row", F.explode("_hits").alias("x")).select("_row", F.col("x.pos").alias("pos"), F.col("x.hash").alias("hash"), F.col("x.gram").alias("_gram"))
    # The template side is a constant of this module or of the caller, never a corpus table.
    hits = hits.join(F.broadcast(template_grams(rows.sparkSession, templates, k)), "hash").where("_gram = gram")
    keys = ["_row", "template", "label", "size"]
    diagonals = hits.groupBy(*keys, (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("place").alias("from"), F.max("place").alias("to")
    )
    # Neighbouring diagonals of one template: an island ends where the gap is over DRIFT words.
    order = Window.partitionBy(*keys).orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"), F.lit(1))
    islands = diagonals.withColumn("_new", new).withColumn("island", F.sum("_new").over(order))
    merged = islands.groupBy(*keys, "island").agg(F.sum("votes").alias("votes"), F.min("first").alias("start"), (F.max("last") + k).alias("end"), F.min("from").alias("from"), F.max("to").alias("to"))
    share = F.least(F.lit(1.0), F.col("votes") / F.greatest(F.col("to") - F.col("from") + 1, F.col("end") - F.col("start") - k + 1))
    checked = merged.withColumn("share", share)
    return checked.where((F.col("share") >= MIN_SHARE) & (F.col("votes") >= F.least(F.lit(float(MIN_VOTES)), 0.6 * F.col("size")))).select("_row", "template", "label", "start", "end", "votes", "share", "size")


def spans(documents: DataFrame, text: str = "text", id_column: str = "doc_id", templates=TEMPLATES, k: int = K) -> DataFrame:
    """(id, template, label, start, end, votes, share, size): verified spans, in words of the text, row by row."""
    rows = walked(documents, text, id_column, PHRASES, templates, k)
    return rows.select(id_column, "_row").join(diagonal_spans(rows, templates, k), "_row").drop("_row")


def scan(documents: DataFrame, text: str = "text", id_column: str = "doc_id", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document: base columns, labels (base and template labels) and score.

    score: the best verified share, weighted by how much of the template stands there; at
    least 0.5 where a base phrase is found.
    """
    rows = walked(documents, text, id_column, phrases, templates, K)
    worth = F.col("share") * F.least(F.lit(1.0), F.col("votes") / F.least(F.col("size"), F.lit(8)))
    best = diagonal_spans(rows, templates).groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max(worth).alias("_score"))
    names, nothing = F.array(*[F.lit(label) for _, label in phrases]), F.array().cast("array<string>")
    base = F.coalesce(F.array_sort(F.array_distinct(F.transform("_s", lambda x: F.get(names, x["p"])))), nothing)
    places = F.transform("_s", lambda x: x["i"])
    return rows.join(best, "_row", "left").select(
        id_column, "n_words", F.greatest(F.size("_s"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.coalesce("_labels", nothing))), ",").alias("labels"),
        F.greatest(F.coalesce("_score", F.lit(0.0)), F.when(F.size("_s") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
