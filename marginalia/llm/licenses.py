"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directories.

Templates are notices, a sentence or two, and whole licence texts. A first pass over every whole text counts the
documents of every term. A second one looks for passages that could reach the threshold of a notice (lines, sentences,
paragraphs, whole texts, and every run of as many terms as a notice has) and for whole texts that could reach that of a
licence text, by bounds: a term outside the templates weighs 1 at least, the least that any can. The terms of those
passages then get their true weights by a join, and a third pass over these texts alone takes the cosines. Files without
a licence of their own take that of the nearest directory above them that holds a licence file, by joins on paths.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, keep_ids, map_arrow

THRESHOLD = 0.6
#: A term: a word, a number, or a whole SPDX tag, which is one term with its licence.
TERM = re.compile(r"spdx-license-identifier:[ \t]*[a-z0-9.+-]+|[a-z0-9]+(?:\.[0-9]+)*")
#: Ends of lines, of sentences, and of paragraphs (runs of lines that hold a letter or digit).
CUTS = re.compile(r"\n"), re.compile(r"[.!?;](?=\s)"), re.compile(r"\n(?:[^\w\n]*\n)+")

#: Short forms of public licences: (licence, notice). Fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]


#: Whole licence texts, one file for each licence.
TEXTS = Path(__file__).with_name("licence_texts")
#: Names that SPDX tags also use for a licence.
SPDX = {"GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"), "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"), "LGPL-2.1": ("LGPL-2.1-only", "LGPL-2.1-or-later"), "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later")}


def notices() -> list[tuple[str, str]]:
    """The notices of TEMPLATES and an SPDX tag for every licence."""
    names = sorted({n for n, _ in TEMPLATES if n != "Proprietary"} | {f.stem for f in TEXTS.glob("*.txt")})
    return TEMPLATES + [(n, f"SPDX-License-Identifier: {tag}") for n in names for tag in (n, *SPDX.get(n, ()))]


def licence_texts() -> list[tuple[str, str]]:
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]


def tokens_of(low: str) -> list[str]:
    """The terms of a lower-cased text."""
    found = TERM.findall(low)
    return [t.replace(" ", "").replace("\t", "") for t in found] if "spdx-" in low else found


def terms(text: str) -> Counter:
    return Counter(tokens_of(text.lower()))


def damped(counts: dict[str, int]) -> dict[str, float]:
    """Counts as they weigh in whole licence texts, where common words repeat hundreds of times."""
    return {t: 1 + math.log(n) for t, n in counts.items()}


Vector = tuple[str, dict[str, float], float]


def cosines(counts: dict[str, float], templates: list[Vector], idf: dict[str, float], own: dict[str, float] | None = None) -> list[tuple[float, str]]:
    """(cosine, licence) with each template; `own` has the weights of terms outside the templates, 1 where it lacks one."""
    own = own or {}
    weights = {t: n * (idf.get(t) or own.get(t, 1.0)) for t, n in counts.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return [(sum(w * weights[t] for t, w in vector.items() if t in weights) / (norm * size) if norm and size else 0.0, name) for name, vector, size in templates]


def vector_of(name: str, counts: dict[str, float], idf: dict[str, float]) -> Vector:
    vector = {t: n * idf[t] for t, n in counts.items()}
    return name, vector, math.sqrt(sum(w * w for w in vector.values()))


def strong_terms(vectors: list[Vector], idf: dict[str, float], threshold: float) -> frozenset[str]:
    """Terms of which a passage must have one: the others hold too little of any template for the threshold.

    A cosine is at most the square root of the shared terms' part of a template's squared weights. The most common
    terms are weak as long as all weak terms together stay below that part in every template.
    """
    weak: set[str] = set()
    known = {t for _, v, _ in vectors for t in v}
    for term in sorted(known, key=lambda t: (idf[t], t)):
        more = weak | {term}
        if any(sum(v[t] ** 2 for t in more if t in v) >= 0.999 * (threshold * size) ** 2 for _, v, size in vectors):
            break
        weak = more
    return frozenset(known) - weak


@dataclass
class Scanner:
    """The notices and licence texts as vectors, with what prunes: all that a task needs."""

    notices: list[Vector]
    sizes: list[int]
    files: list[Vector]
    idf: dict[str, float]
    threshold: float

    def __post_init__(self):
        self.strong = strong_terms(self.notices, self.idf, self.threshold)
        self.known = frozenset(t for _, v, _ in self.files for t in v)
        names = sorted({t for _, v, _ in self.notices for t in v})
        self.number = {t: i for i, t in enumerate(names)}
        self.product = np.array([[v.get(t, 0.0) * self.idf[t] for _, v, _ in self.notices] for t in names] + [[0.0] * len(self.notices)])

    def ranges(self, low: str, tokens: list[str]) -> list[tuple[int, int]]:
        """The lines, sentences and paragraphs that hold a strong term, and the whole, as ranges of the text's terms."""
        if self.strong.isdisjoint(tokens):
            return []
        places = [i for i, t in enumerate(tokens) if t in self.strong]
        starts = [m.start() for m in TERM.finditer(low)]
        found = {(0, len(tokens))}
        for cut in CUTS:
            bounds = [0, *(bisect_left(starts, m.end()) for m in cut.finditer(low)), len(tokens)]
            at = 0
            for first, last in zip(bounds, bounds[1:]):
                while at < len(places) and places[at] < first:
                    at += 1
                if at < len(places) and places[at] < last:
                    found.add((first, last))
        return sorted(found)

    def runs(self, tokens: list[str]) -> list[tuple[int, tuple[str, ...]]]:
        """(template, terms) of the distinct runs of as many terms as a notice has that could reach the threshold.

        Running sums give each run's product with the template and a bound of its length: repeated terms weigh more than
        the sum of their single squares, and terms outside the templates at least 1.
        """
        ids = np.array([self.number.get(t, len(self.number)) for t in tokens], np.int64)
        squares = np.concatenate([[0.0], np.array([self.idf.get(t, 1.0) ** 2 for t in tokens]).cumsum()])
        found = set()
        for k, ((_, _, size), n) in enumerate(zip(self.notices, self.sizes, strict=True)):
            if not size or n > len(ids):
                continue
            product = np.concatenate([[0.0], self.product[ids, k].cumsum()])
            bound = (product[n:] - product[:-n]) / (size * np.sqrt(squares[n:] - squares[:-n]))
            found.update((k, tuple(tokens[i : i + n])) for i in np.flatnonzero(bound >= self.threshold - 1e-9).tolist())
        return sorted(found)

    def candidates(self, text: str | None) -> list[tuple[bool, list[Vector], dict[str, float]]]:
        """(whole, templates, counts) of everything in a text whose cosine could reach the threshold."""
        low = (text or "").lower()
        tokens = tokens_of(low)
        found = []
        reach = self.threshold - 1e-9
        if ranges := self.ranges(low, tokens):
            for first, last in ranges:
                counts = Counter(tokens[first:last])
                if max(cosines(counts, self.notices, self.idf))[0] >= reach:
                    found.append((last - first == len(tokens), self.notices, counts))
            found += [(len(run) == len(tokens), [self.notices[k]], Counter(run)) for k, run in self.runs(tokens)]
        # a cosine is at most the root of the shared terms' part of a template's squares
        if shared := self.known.intersection(tokens):
            if any(sum(v[t] ** 2 for t in shared if t in v) >= (reach * size) ** 2 for _, v, size in self.files):
                counts = damped(Counter(tokens))
                if max(cosines(counts, self.files, self.idf))[0] >= reach:
                    found.append((True, self.files, counts))
        return found

    def best(self, text: str | None, own: dict[str, float]) -> tuple[float, str, bool] | None:
        """(score, licence, whole) of a text: its whole before any part, then the best score, then the first name."""
        scored = [(not whole, -s, name) for whole, templates, counts in self.candidates(text) for s, name in cosines(counts, templates, self.idf, own) if s >= self.threshold]
        if not scored:
            return None
        part, score, name = min(scored)
        return min(-score, 1.0), name, not part


def scan(spark: SparkSession, files: DataFrame, templates: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, path, license, score, origin, from_dir) of every row of `files` (file_id, path, text).

    `templates` are notices, `texts` whole licence texts (the fixed ones by default). origin is `file` where the whole
    text is a licence or a notice, `header` where a line, a sentence, a paragraph or a run of as many terms as a notice has
    is one, `inherited` where the nearest directory above holds a licence file (from_dir), else `none` with a null license
    and the score 0. A `file` has the licence of its whole text, a `header` that of its best passage. Ties of scores go to
    the first licence by name; a directory with several licence files takes the licence of most, then the first by name.
    Terms weigh by the documents they are in, over all rows. Null texts count as empty, null paths as the root; rows that
    repeat count each; an empty table gives an empty result; other columns are ignored.
    """
    ws = Workspace(spark, "licence")
    short = [(n, terms(t)) for n, t in (notices() if templates is None else templates)]
    long = [(n, damped(terms(t))) for n, t in (licence_texts() if texts is None else texts)]
    docs = files.select("file_id", "path", "text")
    id_type = docs.schema["file_id"].dataType.simpleString()

    def first(batch):
        df = Counter()
        for text in batch.column(2):
            df.update(set(tokens_of((text.as_py() or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array(["", *df], pa.string()), pa.array([batch.num_rows, *df.values()], pa.int64())], ["term", "n"])

    df = ws.put(map_arrow(docs, first, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    # a row for each term of the templates
    vocabulary = sorted({t for _, counts in (*short, *long) for t in counts} | {""})
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "term string")
    counted = {r["term"]: r["n"] for r in df.join(F.broadcast(wanted), "term").collect()}
    total = counted.pop("", 0)
    idf = {t: math.log((1 + total) / (1 + counted.get(t, 0))) + 1 for t in vocabulary if t}
    scanner = Scanner([vector_of(n, c, idf) for n, c in short], [c.total() for _, c in short], [vector_of(n, c, idf) for n, c in long], idf, threshold)

    def second(batch):
        out = []
        for i, text in enumerate(batch.column(2)):
            if found := scanner.candidates(text.as_py()):
                out.append((i, sorted({t for _, _, counts in found for t in counts} - idf.keys())))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), batch.column(1).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.string()))], ["file_id", "h", "terms"])

    hashed = docs.select("file_id", F.xxhash64("text").alias("h"), "text")
    likely = ws.put(map_arrow(hashed, second, f"file_id {id_type}, h long, terms array<string>").dropDuplicates(["file_id", "h"]), "likely")
    # the terms of one text's passages, with their documents
    weighed = likely.select("file_id", "h", F.explode("terms").alias("term")).join(df, "term").groupBy("file_id", "h").agg(F.collect_list("term").alias("terms"), F.collect_list("n").alias("ns"))
    near = likely.select("file_id", "h").join(weighed.withColumnsRenamed({"file_id": "_id", "h": "_h"}), F.col("file_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select(F.col("file_id").alias("_id"), F.col("h").alias("_h"), "terms", "ns")
    again = keep_ids(hashed, "file_id", likely.select("file_id").distinct())
    again = again.join(near, again["file_id"].eqNullSafe(near["_id"]) & (again["h"] == near["_h"])).select("file_id", "text", "terms", "ns")

    def third(batch):
        out = []
        for i, (text, names, ns) in enumerate(zip(*(batch.column(k) for k in (1, 2, 3)), strict=True)):
            own = {t: math.log((1 + total) / (1 + n)) + 1 for t, n in zip(names.as_py() or [], ns.as_py() or [], strict=True)}
            if best := scanner.best(text.as_py(), own):
                out.append((i, *best))
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[2], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[3], pa.bool_())], ["file_id", "license", "score", "whole"])

    scored = map_arrow(again, third, f"file_id {id_type}, license string, score double, whole boolean")
    best = scored.groupBy("file_id").agg(F.min(F.struct((~F.col("whole")).alias("part"), (-F.col("score")).alias("s"), "license")).alias("b"))
    own = ws.put(best.select(F.col("file_id").alias("own_id"), F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), (~F.col("b.part")).alias("whole")), "own")

    placed = docs.select("file_id", "path", F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1).alias("dir"))
    joined = ws.put(placed.join(own, placed["file_id"].eqNullSafe(own["own_id"]), "left").select("file_id", "path", "dir", "license", "score", "whole"), "joined")
    votes = joined.filter("whole").groupBy("dir", "license").agg(F.count(F.lit(1)).alias("c"))
    declared = votes.groupBy("dir").agg(F.min(F.struct((-F.col("c")).alias("c"), "license")).alias("v")).select(F.col("dir").alias("above"), F.col("v.license").alias("given"))
    # each directory with itself and those above it; directories are far fewer than files, and a path's depth bounds its rows
    dirs = joined.select("dir").distinct().withColumn("parts", F.split("dir", "/"))
    above = dirs.select("dir", F.explode(F.expr("transform(sequence(0, size(parts)), i -> array_join(slice(parts, 1, i), '/'))")).alias("above")).distinct()
    nearest = above.join(declared, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("l"), "above", "given")).alias("n"))
    nearest = ws.put(nearest.select("dir", F.col("n.above").alias("from_dir"), F.col("n.given").alias("given")), "near")
    out = joined.join(nearest, "dir", "left")
    origin = F.when(F.col("whole"), "file").when(F.col("license").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "file_id", "path", F.coalesce("license", "given").alias("license"), F.coalesce("score", F.lit(0.0)).alias("score"), origin.alias("origin"),
        F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def scan_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """`scan` of a documents table, whose rows stand at source/lang/doc_id (a null source or lang is `_`)."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    return scan(spark, documents.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")
