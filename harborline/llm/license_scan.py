"""Licences by TF-IDF cosine to templates, inherited from the nearest directory, in SQL functions only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborline.session import spool

# Headers and opening words of public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License",
        "GNU General Public License Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation; either version 2 of the License",
        "GNU General Public License Version 2, June 1991",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License Version 3, 19 November 2007"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "ISC": [
        "Licensed under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Every term of a template holds one of these, so passages without any are not compared.
CUE = r"[A-Za-z0-9]"
#: Names of files that speak for their directory; so do files that are mostly licence.
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.-][^/]*)?$"
LEAST = 0.7
MOSTLY = 0.5


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def template_terms(spark: SparkSession) -> DataFrame:
    """(template, licence, term, tf) of the fixed templates."""
    rows = [(f"{name}/{k}", name, text) for name, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "template string, licence string, text string")
    exploded = table.select("template", "licence", F.explode(terms(F.col("text"))).alias("term"))
    return exploded.groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))


def can_reach(held: Column, squares: dict[str, dict[str, float]], least: float) -> Column:
    """Whether a passage of these terms can reach the cosine ``least`` to a template.

    ``squares`` are the squared parts of a template's unit vector by term. A cosine is at
    most the root of their sum over the terms that the passage holds.
    """
    # A constant, folded once.
    templates = F.from_json(F.lit(json.dumps(list(squares.values()))), "array<map<string,double>>")

    def total(parts: Column) -> Column:
        return F.aggregate(held, F.lit(0.0), lambda so_far, term: so_far + F.coalesce(F.element_at(parts, term), F.lit(0.0)))

    return F.exists(templates, lambda parts: total(parts) >= least * least - 1e-6)


def heavy_terms(squares: dict[str, dict[str, float]], least: float) -> list[str]:
    """Terms without any of which no passage reaches the cosine ``least`` to a template.

    Of each template the lightest terms whose squared parts together stay below the least
    are left out: a passage that holds only those stays below it.
    """
    out: set[str] = set()
    for parts in squares.values():
        total = 0.0
        for term, square in sorted(parts.items(), key=lambda x: (x[1], x[0])):
            total += square
            if total >= least * least - 1e-6:
                out.add(term)
    return sorted(out)


def holds_term(text: Column, listed: list[str]) -> Column:
    """Whether the lower-cased text has one of the terms as a term of its own."""
    edge = r"[\p{L}\p{N}]"
    return F.lower(text).rlike(rf"(?<!{edge})(?:{'|'.join(listed)})(?!{edge})")


def passages(text: Column, fits: Callable[[Column], Column]) -> Column:
    """Sentences, lines and paragraphs that fit, each once."""
    lines, blocks = F.split(text, r"\r?\n"), F.split(text, r"\r?\n[ \t]*\r?\n")
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])[ \t]+")))
    return F.filter(F.array_distinct(F.concat(sentences, lines, blocks)), lambda p: p.rlike(CUE) & fits(p))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, id, path, n_terms, licence, score, share) for every file of (id, path, text).

    Weights are tf times idf; idf counts, over all files, those that hold a term of
    the templates, and other terms weigh one. The best passage of a file decides;
    ties go to the first template by name. ``share`` is its part of all terms. Only
    passages whose terms can reach ``least`` are compared; other files score zero.
    """
    spark = files.sparkSession
    wanted = spool(template_terms(spark), "templates")
    vocabulary = sorted(r[0] for r in wanted.select("term").distinct().collect())  # of the fixed templates
    words = terms(F.coalesce(F.col("text"), F.lit("")))
    known = F.array(*[F.lit(t) for t in vocabulary])
    seen = files.select(F.array_intersect(words, known).alias("held"))
    # The document count comes with the others, under a term that no text has.
    counts = spool(
        seen.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-files"
    )
    total = (counts.where("term = ''").first() or (None, 0))[1]
    holders = counts.where("term <> ''")
    weight = F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    idf = spool(wanted.select("term").distinct().join(holders, "term", "left").select("term", weight.alias("idf")), "idf")
    weighed = wanted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    model = spool(weighed.join(norms, "template").select("template", "licence", "term", (F.col("w") / F.col("t_norm")).alias("tw")), "template-model")
    squares: dict[str, dict[str, float]] = {}
    for r in model.select("template", "term", "tw").collect():  # of the fixed templates
        squares.setdefault(r["template"], {})[r["term"]] = r["tw"] ** 2

    heavy = heavy_terms(squares, least)

    def fits(text: Column, its_terms: Column) -> Column:
        # A lambda's value is computed once.
        one = F.transform(F.array(F.array_intersect(its_terms, known)), lambda held: can_reach(held, squares, least))
        return F.when(holds_term(text, heavy), F.element_at(one, 1)).otherwise(False)

    # A passage holds no more terms than its file.
    some = F.when(fits(F.col("text"), F.col("words")), passages(F.col("text"), lambda p: fits(p, terms(p))))
    read = spool(
        files.withColumn("words", words)
        .select("id", "path", "text", F.size("words").alias("n_terms"), "words")
        .select(
            F.monotonically_increasing_id().alias("row"), "id", "path", "n_terms",
            F.coalesce(some, F.array().cast("array<string>")).alias("passages"),
        ),
        "files",
    )

    place = ["row", "passage"]
    counted = (
        read.select("row", F.posexplode("passages").alias("passage", "text"))
        .select("row", "passage", F.explode(terms(F.col("text"))).alias("term"))
        .groupBy(*place, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
        .join(idf, "term", "left")
        .withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    )
    counted = spool(counted, "passage-terms")
    sizes = counted.groupBy(*place).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("terms"))
    scores = (
        counted.join(model, "term")
        .groupBy(*place, "template", "licence")
        .agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
        .join(sizes, place)
        .select("row", "template", "licence", "terms", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    )
    # The greatest score; of equal ones the longest passage, then the first template.
    best = scores.groupBy("row").agg(
        F.max_by(F.struct("licence", "score", "terms"), F.struct("score", "terms", F.transform(F.split("template", ""), lambda c: -F.ascii(c)).alias("t"))).alias("b")
    )
    return read.join(best, "row", "left").select(
        "row", "id", "path", "n_terms", F.col("b.licence").alias("licence"), F.coalesce("b.score", F.lit(0.0)).alias("score"),
        F.coalesce(F.col("b.terms") / F.greatest("n_terms", F.lit(1)), F.lit(0.0)).alias("share"),
    )


def license_scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per input row: key, path, licence, score, origin, licensed_by.

    ``origin`` is ``own`` where a passage of the file reaches the cosine ``least``,
    ``inherited`` where the nearest directory above holds a licence file (by name, or
    one that is mostly licence), else ``none`` with a null licence. ``licensed_by`` is
    that directory; the root is the empty string. Of several licence files in one
    directory the best score counts, then the first licence by name. Null texts count
    as empty; a null path has no directory. Repeated keys are each reported; an empty
    table gives no rows; further columns are not looked at.
    """
    base = files.select(F.col(key).alias("id"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    above = F.when(F.col("path").isNotNull(), F.regexp_replace("path", r"/?[^/]*$", ""))
    found = spool(scan(base, least).withColumn("dir", above).withColumn("own", F.col("score") >= least), "licences")
    speaks = F.col("own") & (F.col("path").rlike(FILE_NAME) | (F.col("share") >= MOSTLY))
    first = F.transform(F.split("licence", ""), lambda c: -F.ascii(c))
    held = spool(
        found.where(speaks & F.col("dir").isNotNull())
        .groupBy("dir")
        .agg(F.max_by(F.struct("licence", "score"), F.struct("score", first.alias("f"))).alias("l"))
        .select("dir", "l.licence", "l.score"),
        "licence-folders",
    )
    # Every directory once, with all directories above it.
    parts = F.split("dir", "/")
    folders = (
        found.where("not own and dir is not null")
        .select("dir").distinct()
        .withColumn("depth", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))))
        .select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("above"))
    )
    nearest = (
        folders.alias("f").join(held.alias("h"), F.col("f.above") == F.col("h.dir"))
        .groupBy("f.dir")
        .agg(F.max_by(F.struct("above", "licence", "score"), "depth").alias("n"))
        .select(F.col("dir").alias("n_dir"), "n")
    )
    rows = found.join(spool(nearest, "nearest"), (F.col("dir") == F.col("n_dir")) & ~F.col("own"), "left")
    return rows.select(
        F.col("id").alias(key),
        F.col("path").alias(path),
        F.when(F.col("own"), F.col("licence")).otherwise(F.col("n.licence")).alias("licence"),
        F.when(F.col("own"), F.col("score")).otherwise(F.col("n.score")).alias("score"),
        F.when(F.col("own"), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~F.col("own"), F.col("n.above")).alias("licensed_by"),
    )
