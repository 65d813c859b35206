"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Built-in functions only. Templates are the notices below, the whole texts in ``license_texts``
and the first OPENING words of each. The units compared are, of a file with an anchor in it:
the runs of up to WINDOW adjacent lines with an anchor (joined; a term split drops comment
marks), so that a wrapped header is met whole, the whole text, and its first OPENING words. A run
without an anchor is not compared. A term's document frequency is counted over all files. Dot
products come from joining a unit's terms with the templates' (a fixed, small table), so
terms that no template has cost nothing but their part of the norm. The weights of the TERMS most
frequent terms are broadcast; the others' are known to be at least that of the least frequent
of these, which bounds a unit's cosine from above. Units whose bound reaches the threshold, and
no others, are joined with the other terms' counts, so every score is exact. A file's
license is the template of highest cosine if that reaches THRESHOLD.

A license file is one that has the name of one, or whose whole text is one. A directory's
license is that of the license files in it (highest cosine, then name). A file without a
license of its own takes that of the nearest directory above it that has one: each
distinct directory is joined with its ancestors' paths, and the deepest wins.
"""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, release

THRESHOLD = 0.6
#: Notices of common licenses, one unit a line.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
ANCHORS = r"(?i)licen[cs]|permission is hereby|redistribut|public domain|free software|\bCC[ -]?(BY|0)\b|creative commons|mozilla public|\bGNU\b|\bSPDX\b"
#: Lines of a run at most.
WINDOW = 8
#: Words of a text's opening.
OPENING = 100
#: Rows of a small side that are broadcast at most.
FEW = 100_000
#: Terms besides those of templates whose weights are broadcast at most: some 10 MB.
TERMS = 150_000
TEXTS = Path(__file__).with_name("license_texts")
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def templates() -> list[tuple[str, str]]:
    """(license, text): notices, whole texts and their openings."""
    out = list(TEMPLATES)
    for file in sorted(TEXTS.glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        out += [(file.stem, text), (file.stem, " ".join(text.split()[:OPENING]))]
    return out


def template_terms() -> list[tuple[int, str, str, int]]:
    """(number, license, term, times) of the templates."""
    out = []
    for i, (name, text) in enumerate(templates()):
        words = Counter("".join(c if c.isalnum() else " " for c in text.lower()).split())
        out += [(i, name, w, n) for w, n in words.items()]
    return out


def values(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small fixed table, as SQL VALUES."""
    text = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")


def parent(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def idf(files: DataFrame) -> tuple[DataFrame, int]:
    """(term, n) of every term in the files, and the number of files."""
    each = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n")), files.count()


def weight(total: int) -> Column:
    """ln((1 + files) / (1 + files with the term)) + 1; ``n`` is null for a term of no file."""
    return F.log((1.0 + total) / (1.0 + F.coalesce("n", F.lit(0)))) + 1.0


def units(files: DataFrame) -> DataFrame:
    """(path, unit, text) of files with an anchor: the runs of lines, numbered, the whole text (-1) and its opening (-2)."""
    # inline() keeps the lines from being split again for each use
    split = files.filter(F.col("text").rlike(ANCHORS)).select("path", F.inline(F.array(F.struct(F.split("text", "\n").alias("lines")))))
    at = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(ANCHORS), i)), lambda i: i.isNotNull())
    near = split.select("path", "lines", F.inline(F.array(F.struct(at.alias("at")))))
    around = F.transform("at", lambda i: F.struct(i.alias("i"), F.least(i, F.lit(WINDOW - 1)).alias("own"), F.slice("lines", F.greatest(i - (WINDOW - 2), F.lit(1)), F.lit(2 * WINDOW - 1)).alias("near")))
    anchored = near.select("path", F.inline(around))
    runs = [(back, size) for back in range(WINDOW) for size in range(back + 1, WINDOW + 1)]
    run = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(back).alias("back"), F.lit(size).alias("size")) for n, (back, size) in enumerate(runs)])).alias("run")
    told = anchored.select("path", "i", "own", "near", run).filter("run.back <= own and own - run.back + run.size <= size(near)")
    line = told.select("path", (F.col("i").cast("bigint") * len(runs) + F.col("run.n")).alias("unit"), F.array_join(F.slice("near", F.col("own") - F.col("run.back") + 1, F.col("run.size")), " ").alias("text"))
    opening = F.regexp_extract("text", rf"(?s)^\s*((?:\S+\s*){{1,{OPENING}}})", 1)
    whole = files.filter(F.col("text").rlike(ANCHORS)).select("path", F.inline(F.array(F.struct(F.lit(-1).cast("bigint").alias("unit"), F.col("text").alias("text")), F.struct(F.lit(-2).cast("bigint").alias("unit"), opening.alias("text")))))
    return line.unionByName(whole)


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score, whole, whole_license) of the files with a license of their own; score to six places.

    whole, whole_license: the score and license of the whole text alone, where that has one.
    """
    spark = files.sparkSession
    counts, total = idf(files)
    counts = cut(counts)
    least = _least(counts)
    listed = cut(_listed(spark, counts, total, least))
    raw = units(files).select("path", "unit", F.explode(terms(F.col("text"))).alias("term"))
    # dealt by unit once: what is summed over a unit needs no further shuffle
    each = raw.repartition("path", "unit").groupBy("path", "unit", "term").agg(F.count(F.lit(1)).alias("times"))
    w = F.col("times") * F.col("idf")
    known = F.struct(F.lit(-1).alias("template"), F.lit("").alias("name"), (w * w).alias("value"))
    rare = F.struct(F.lit(-2).alias("template"), F.col("term").alias("name"), (F.col("times") * F.col("times")).cast("double").alias("value"))
    shared = F.transform("tws", lambda t: F.struct(t["template"].alias("template"), t["license"].alias("name"), (w * t["tw"]).alias("value")))
    parts = F.when(F.col("idf").isNull(), F.array(rare)).when(F.col("tws").isNull(), F.array(known)).otherwise(F.concat(F.array(known), shared))
    sums = each.join(F.broadcast(listed), "term", "left").select("path", "unit", F.inline(parts)).groupBy("path", "unit", "template", "name").agg(F.sum("value").alias("value"))
    unit = sums.groupBy("path", "unit").agg(
        F.coalesce(F.sum(F.when(F.col("template") == -1, F.col("value"))), F.lit(0.0)).alias("known"),
        F.coalesce(F.sum(F.when(F.col("template") == -2, F.col("value"))), F.lit(0.0)).alias("unlisted"),
        F.collect_list(F.when(F.col("template") == -2, F.struct(F.col("name").alias("term"), "value"))).alias("rare"),
        F.collect_list(F.when(F.col("template") >= 0, F.struct(F.col("name").alias("license"), F.col("value").alias("dot")))).alias("dots"),
    )
    lowest = math.log((1.0 + total) / least) + 1.0  # an unlisted term is in fewer than ``least`` files
    shortest = F.sqrt(F.col("known") + F.col("unlisted") * (lowest * lowest))
    kept = cut(unit.filter(F.exists("dots", lambda d: d["dot"] >= (threshold - 1e-6) * shortest)))
    again = kept.select("path", "unit", F.inline("rare")).join(counts, "term").withColumn("idf", weight(total))
    more = again.groupBy("path", "unit").agg(F.sum(F.col("value") * F.col("idf") * F.col("idf")).alias("more"))
    length = F.sqrt(F.col("known") + F.coalesce("more", F.lit(0.0)))
    exact = kept.drop("rare").join(more, ["path", "unit"], "left").select("path", "unit", length.alias("length"), F.inline("dots"))
    scored = exact.withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("score") >= threshold)
    rank = F.struct((-F.col("score")).alias("down"), "license")
    best = scored.groupBy("path").agg(F.min(rank).alias("best"), F.min(F.when(F.col("unit") == -1, rank)).alias("whole"))
    told = best.select("path", F.col("best.license").alias("license"), (-F.col("best.down")).alias("score"), (-F.col("whole.down")).alias("whole"), F.col("whole.license").alias("whole_license"))
    told = cut(told)
    release(counts, listed, kept)
    return told


def _least(counts: DataFrame) -> int:
    """The power of two so that at most TERMS terms are in as many files; 1 if all terms are TERMS at most."""
    by_bits = dict(counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("terms")).collect())  # 63 rows at most
    held = 0
    for bits in sorted(by_bits, reverse=True):
        held += by_bits[bits]
        if held > TERMS:
            return 1 << bits
    return 1


def _listed(spark: SparkSession, counts: DataFrame, total: int, least: int) -> DataFrame:
    """(term, idf, tws) of every term of a template or of ``least`` files; tws: its weights in the templates, of unit length."""
    own = values(spark, template_terms(), "template, license, term, times")  # a fixed table
    met = counts.join(F.broadcast(own.select("term").distinct()), "term")
    weighed = own.join(F.broadcast(met), "term", "left").withColumn("idf", weight(total)).withColumn("w", F.col("times") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighed.join(F.broadcast(norms), "template").withColumn("tw", F.col("w") / F.col("norm"))
    taught = unit.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "license", "tw")).alias("tws"))
    others = counts.filter(F.col("n") >= least).join(F.broadcast(own.select("term").distinct()), "term", "left_anti")
    return taught.unionByName(others.select("term", weight(total).alias("idf")), allowMissingColumns=True)


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, license, from_dir): of directories (dir) the license of the nearest of (dir, license), itself included."""
    parts = F.split("dir", "/")
    every = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))
    up = directories.select("dir", F.inline(F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))).otherwise(every)))
    met = up.join(licensed.select(F.col("dir").alias("above"), "license"), "above")
    return met.groupBy("dir").agg(F.max_by("license", "depth").alias("license"), F.max_by("above", "depth").alias("from_dir"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, license, score, inherited_from) for each row of ``files`` (path, text, more).

    license: the file's own, with its score and inherited_from null; else that of the nearest
    directory with a license file, with score null; else null. A null text has no license
    of its own; a null path no directory either, and is not matched. Rows that repeat a path
    share a license (the best of them). Other columns are ignored; an empty table gives
    an empty result.
    """
    rows = files.select("path", "text")
    own = own_licenses(rows.filter("path is not null"), threshold)
    by_name = F.regexp_extract("path", r"(?s)([^/]*)$", 1).rlike(LICENSE_FILE)
    told = F.when(by_name, F.struct((-F.col("score")).alias("down"), "license")).otherwise(F.struct((-F.col("whole")).alias("down"), F.col("whole_license").alias("license")))
    licensed = own.filter(by_name | F.col("whole").isNotNull()).groupBy(parent(F.col("path")).alias("dir")).agg(F.min(told).alias("best")).select("dir", F.col("best.license").alias("license"))
    own = own.select("path", "license", "score")
    joined = rows.select("path").join(own, "path", "left").withColumn("dir", parent(F.col("path")))
    from_above = cut(inherited(joined.filter("license is null and path is not null").select("dir").distinct(), licensed))
    if from_above.count() <= FEW:
        from_above = F.broadcast(from_above)
    out = joined.join(from_above.select("dir", F.col("license").alias("above"), "from_dir"), "dir", "left")
    alone = F.col("license").isNull()
    return out.select("path", F.coalesce("license", "above").alias("license"), "score", F.when(alone, F.col("from_dir")).alias("inherited_from"))


def paths(documents: DataFrame) -> DataFrame:
    """(path, text, doc_id): documents as files ``source/lang/doc_id``; those without source or lang stand in ``?``, which no name is."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    folder = [F.coalesce(F.replace(F.replace(c, F.lit("?"), F.lit("??")), F.lit("/"), F.lit("?_")), F.lit("?")) for c in ("source", "lang")]
    return documents.select(F.concat_ws("/", *folder, name).alias("path"), "text", "doc_id")


def scan_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, path, license, score, inherited_from) for each document."""
    files = paths(documents)
    found = scan(files).drop_duplicates(["path"])
    return files.select("doc_id", "path").join(found, "path").select("doc_id", "path", "license", "score", "inherited_from")
