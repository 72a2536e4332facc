"""License scans with MinHash bands over text windows (operator 6, DataFrame functions only).

Texts and templates become hashes of five-word shingles (lower-cased words of
letters and digits).  A template of s shingles is looked for in windows of s
shingles, one every s/4.  Its band key for each of ``BANDS`` hash functions is
its smallest shingle hash; a window retrieves the template when it has the
same smallest hash in any band.  Where at least four fifths of a template's
shingles stand in place, some window has a Jaccard similarity of 0.5 to it,
so 20 bands of one row miss it with a probability below 1e-6.

A band can only collide in a window that holds the template's smallest
shingle of that band.  So texts without any of these anchor shingles are
dropped where they are read (nothing is lost), and only windows around
anchors are hashed.  Retrieved windows are verified: the share of the
template's shingles in the window and half a window on both sides must reach
``containment``.  Only matches are shuffled.

A template below five words is one shingle, its whole sequence of words, and
is found where it stands word for word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, BANDS, CONTAINMENT = 5, 20, 0.8
#: Bytes of template text that may be broadcast.
TEMPLATE_BYTES = 4 << 20

#: Notices and permission texts by which public licenses are declared.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
                "and accompanying documentation covered by this license"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software."),
]


def default_templates(spark: SparkSession) -> DataFrame:
    rows = [(i, lic, text) for i, (lic, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id int, license_id string, text string")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often and wherever ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of ``width`` words in order; none below so many words, NULL for a NULL text."""
    return _bind(_words(text), lambda w: F.when(F.size(w) >= width, F.transform(
        F.sequence(F.lit(0), F.size(w) - width),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>")))


def _short_hits(docs: DataFrame, templates: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """Places of templates below ``WIDTH`` words, as rows like those of the others."""
    t = templates.where("text IS NOT NULL").select("template_id", "license_id", "text", F.size(_words(F.col("text"))).alias("width"))
    t = t.where((F.col("width") > 0) & (F.col("width") < WIDTH))
    out = None
    for width in sorted(r["width"] for r in t.select("width").distinct().collect()):
        table = t.where(F.col("width") == width).select("template_id", "license_id", F.get(shingles(F.col("text"), width), F.lit(0)).alias("gram"))
        keys = [r["gram"] for r in table.select("gram").distinct().collect()]       # one a template, of bounded size
        at = _bind(shingles(F.col(text_col), width), lambda h: F.filter(F.transform(h, lambda g, i: F.when(
            g.isin(keys), F.struct(g.alias("gram"), i.alias("start")))), lambda x: x.isNotNull()))
        d = docs.select(F.col(id_col).alias("_id"), F.explode(at).alias("p")).select("_id", "p.*")
        d = d.join(F.broadcast(table), "gram").select("_id", "license_id", "template_id", "start", F.lit(1.0).alias("containment"))
        out = d if out is None else out.unionByName(d)
    return out


def anchors(templates: DataFrame) -> DataFrame:
    """(anchor, template_id, license_id, size, grams, bands): the smallest shingles of a template and their bands."""
    t = templates.where("text IS NOT NULL").select("template_id", "license_id", shingles(F.col("text")).alias("_h"))
    t = t.select("template_id", "license_id", F.array_distinct("_h").alias("grams"), F.size("_h").alias("size"))
    t = t.where("size > 0")
    each = t.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("low", F.array_min(
        F.transform("grams", lambda g: F.struct(F.xxhash64(g, F.col("band")).alias("h"), g.alias("g")))))
    return each.groupBy(F.col("low.g").alias("anchor"), "template_id", "license_id", "size", "grams").agg(
        F.collect_list("band").alias("bands"))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         containment: float = CONTAINMENT) -> DataFrame:
    """One row (id, license_id, containment, first_word, n_windows) for each license found in a document.

    ``containment``: largest share of a template's shingles found at one
    place; ``first_word``: where the first such window begins (words from 0);
    ``n_windows``: retrieved and verified windows.

    NULL and empty texts hold nothing; repeated rows with one id are one
    document; templates below five words are found word for word, those without
    words never; an empty document or template table gives an empty result.  Other
    columns are ignored.  Templates above ``TEMPLATE_BYTES`` are refused.
    """
    size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates have {size} bytes, {TEMPLATE_BYTES} may be broadcast")
    table = anchors(templates)
    keys = [r["anchor"] for r in table.select("anchor").distinct().collect()]      # at most BANDS a template, fixed size
    widest = table.agg(F.max("size")).first()[0] or 1

    def places(h: Column) -> Column:
        # every anchor, with as much around it as its windows and their surroundings can reach
        at = F.filter(F.transform(h, lambda g, i: F.when(g.isin(keys or [0]), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(
            F.get(h, i).alias("anchor"), i.alias("at"), F.greatest(i - 2 * widest, F.lit(0)).alias("base"),
            F.slice(h, F.greatest(i - 2 * widest, F.lit(0)) + 1, F.lit(4 * widest + 1)).alias("near")))

    d = docs.select(F.col(id_col).alias("_id"), F.explode(_bind(shingles(F.col(text_col)), places)).alias("p"))
    d = d.select("_id", "p.*")
    c = d.join(F.broadcast(table), "anchor")                                       # its size has been checked
    stride = F.greatest(F.floor(F.col("size") / 4).cast("int"), F.lit(1))
    first = F.greatest(F.ceil((F.col("at") - F.col("size") + 1) / stride) * stride, F.lit(0)).cast("int")
    c = c.withColumn("start", F.explode(F.sequence(first, F.greatest(F.col("at"), first), stride))).where("start <= at")
    window = F.slice(F.col("near"), F.col("start") - F.col("base") + 1, F.col("size"))
    collides = F.exists("bands", lambda k: F.xxhash64(F.col("anchor"), k) == F.array_min(
        F.transform(F.col("_win"), lambda g: F.xxhash64(g, k))))
    c = c.withColumn("_win", window).where(collides)
    half = F.floor((F.col("size") + 1) / 2).cast("int")
    lo = F.greatest(F.col("start") - half, F.col("base"))
    around = F.slice(F.col("near"), lo - F.col("base") + 1, F.col("start") - lo + F.col("size") + half)
    found = F.size(F.array_intersect("grams", around)) / F.size("grams")
    c = c.withColumn("containment", found).where(F.col("containment") >= containment)
    c = c.select("_id", "license_id", "template_id", "start", "containment")
    short = _short_hits(docs, templates, id_col, text_col)
    c = c if short is None else c.unionByName(short)
    hits = c.groupBy("_id", "license_id").agg(
        F.max("containment").alias("containment"),
        F.min_by("start", F.struct(-F.col("containment"), F.col("start"))).cast("long").alias("first_word"),
        F.countDistinct("template_id", "start").alias("n_windows"))
    return hits.select(F.col("_id").alias(id_col), "license_id", "containment", "first_word", "n_windows")
