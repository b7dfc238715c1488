"""License scans of a file tree.

Windows of a whole text, of up to twice a template's length in words and across line ends, are
compared with license templates by the cosine of sparse TF-IDF vectors; the best window at or above
the threshold is the file's own license. A licence file speaks
for its directory: a file without a license of its own takes that of the nearest directory above
it that has one, found by joins of directories with their ancestors.

The weight of a word is its inverse document frequency over all files. A word that a template
lacks weighs no more than the template's rarest word: a name inside a header weighs the same in
a small and in a large corpus. Counts of all words stay on Spark; those of the templates' words (a
bounded list) go to the driver, and those of a candidate's other words are joined to it.

Null and empty texts have no license of their own and may inherit one. A null path has no
directory and inherits nothing. Of several licence files of a directory the highest cosine
decides, then the first license by name. Repeated rows are scanned alike. Templates with equal
cosine are taken in order of their names. An empty table gives an empty table. Columns of the
input that have the name of a result are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from paperlode.llm.common import unused
from paperlode.session import settle

#: Headers, titles and own clauses of license texts (fixed values).
TEMPLATES = {
    "AGPL-3.0": [
        "GNU Affero General Public License Version 3, 19 November 2007",
        "the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, "
        "are permitted provided that the following conditions are met",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior "
        "written permission",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "Creative Commons Attribution-ShareAlike 4.0 International",
    ],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "GPL-2.0": [
        "GNU General Public License Version 2, June 1991",
        "the GNU General Public License as published by the Free Software Foundation, "
        "either version 2 of the License",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "GNU General Public License Version 3, 29 June 2007",
        "the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": [
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: A license whose text has all of another one's: found, it counts instead of the other.
EXTENDS = {"BSD-3-Clause": "BSD-2-Clause"}
#: Words that turn a header into its opposite, up to ``BEFORE`` words before or inside a window.
NEGATIONS = frozenset(["not", "never", "isn", "isnt", "wasn", "cannot", "unlike", "except"])
BEFORE = 3
THRESHOLD = 0.7
#: Different words that a task counts before it hands the counts on.
COUNTED = 200_000
TOKEN = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")


def terms(line: str) -> Counter:
    return Counter(TOKEN.findall(line.lower()))


def _tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Scanner:
    """Windows of a text against templates; knows templates and weights of their words."""

    def __init__(self, templates: dict[str, list[str]], idf: dict[str, float], threshold: float):
        self.idf, self.threshold, self.templates = idf, threshold, []
        for name in sorted(templates):
            for text in templates[name]:
                bag = terms(text)
                square = {w: (n * idf[w]) ** 2 for w, n in bag.items()}
                norm = sum(square.values())
                # A window without any of these words can't have enough of the template.
                needed, rest = set(), norm
                for w in sorted(square, key=lambda w: (-square[w], w)):
                    if rest < threshold**2 * norm * (1 - 1e-9):
                        break
                    needed.add(w)
                    rest -= square[w]
                weight = {w: idf[w] for w in bag}
                self.templates.append((name, bag, square, norm, needed, weight, max(weight.values())))

    def passages(self, text: str | None) -> list[list[str]]:
        """The parts of a text, as words, that can have a window with enough of a template."""
        words = _tokens(text)
        known, spans = set(words), []
        for _, bag, square, norm, needed, _, _ in self.templates:
            least = self.threshold**2 * norm * (1 - 1e-9)
            if not needed & known or sum(q for w, q in square.items() if w in known) < least:
                continue
            reach = 2 * bag.total() - 1
            for at in (i for i, w in enumerate(words) if w in needed):
                start, end = max(0, at - reach), at + reach + 1
                if sum(square[w] for w in bag.keys() & set(words[start:end])) >= least:
                    spans.append((start, end))
        out: list[list[int]] = []
        for start, end in sorted(spans):
            if out and start <= out[-1][1]:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end])
        return [words[start:end] for start, end in out]

    def best(
        self, passages: list[list[str]], other: dict[str, float]
    ) -> tuple[str | None, float | None]:
        """The best window of all; ``other``: inverse document frequencies of words that are not
        in templates."""
        found: dict[str, float] = {}
        for name, bag, square, norm, needed, weight, most in self.templates:
            for words in passages:
                if needed.isdisjoint(words):
                    continue
                for start in (i for i, w in enumerate(words) if w in bag):
                    if not NEGATIONS.isdisjoint(words[max(0, start - BEFORE) : start]):
                        continue
                    seen: Counter = Counter()
                    length = shared = 0.0
                    for w in words[start : start + 2 * bag.total()]:
                        n, own = seen[w], weight.get(w)
                        seen[w] = n + 1
                        if own is None:
                            if w in NEGATIONS:
                                break
                            length += (2 * n + 1) * min(self.idf.get(w) or other[w], most) ** 2
                            continue
                        length += (2 * n + 1) * own**2
                        shared += bag[w] * own * own
                        cosine = shared / math.sqrt(length * norm)
                        if cosine >= self.threshold - 1e-12 and cosine > found.get(name, 0.0) + 1e-12:
                            found[name] = cosine
        if not found:
            return None, None
        chosen = min(found, key=lambda name: (-round(found[name], 12), name))
        for more, less in EXTENDS.items():
            chosen = more if chosen == less and more in found else chosen
        return chosen, found[chosen]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` and ``n``, the number of files that have it; the empty word stands for all files."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen[""] += 1
                seen.update(set(_tokens(t.as_py())))
                if len(seen) > COUNTED:
                    yield rows()
                    seen = Counter()
        yield rows()

    totals = docs.select(text).mapInArrow(count, "word string, n long")
    return settle(totals.groupBy("word").agg(F.sum("n").alias("n")), "words")


def spark_words(docs: DataFrame, words: list[str]) -> DataFrame:
    return docs.sparkSession.createDataFrame([(w,) for w in words], "word string")


def directory(path: Column) -> Column:
    """The path before its last slash; empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).when(
        path.isNotNull(), ""
    )


def scan(
    docs: DataFrame,
    path: str = "path",
    text: str = "text",
    is_licence_file: Column | None = None,
    templates: dict[str, list[str]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` without the text, with ``license``, ``cosine``, ``origin`` (``own``,
    ``inherited``, ``none``) and ``license_dir`` (whose licence file was taken)."""
    templates = TEMPLATES if templates is None else templates
    named = ["license", "cosine", "origin", "license_dir"]
    docs = docs.drop(*named)
    if is_licence_file is None:
        is_licence_file = F.lower(F.col(path)).rlike(r"(^|/)(licen[cs]e|copying|unlicense)[^/]*$")
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in kept]
    speaks, here = unused(docs, "speaks"), unused(docs, "here")
    passages, row = unused(docs, "passages"), unused(docs, "row")
    counts = word_counts(docs, text)
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in terms(t)})
    asked = spark_words(docs, [*vocabulary, ""])
    known = {r["word"]: r["n"] for r in counts.join(F.broadcast(asked), "word").collect()}
    n = known.get("", 0)
    idf = {w: math.log((1 + n) / (1 + known.get(w, 0))) + 1 for w in vocabulary}
    scanner = Scanner(templates, idf, threshold)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                index = part.schema.get_field_index
                found = [scanner.passages(t) or None for t in part.column(index(text)).to_pylist()]
                columns = [part.column(index(c)) for c in names]
                made = pa.array(found, pa.list_(pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*columns, made], names=[*names, passages])

    held = StructType([*kept, StructField(passages, ArrayType(ArrayType(StringType())))])
    parts = docs.select(*names, text).mapInArrow(cut, held)
    parts = settle(parts.withColumn(row, F.monotonically_increasing_id()), "passages")
    flat = parts.filter(f"`{passages}` is not null").select(F.col(row).alias("row"), F.col(passages).alias("p"))
    others = flat.select("row", F.explode(F.array_distinct(F.flatten("p"))).alias("word"))
    others = others.join(F.broadcast(asked), "word", "left_anti").join(counts, "word")
    others = others.groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("others"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                other = {x["word"]: math.log((1 + n) / (1 + x["n"])) + 1 for x in more or []}
                found.append(scanner.best(p, other))
            made = [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["row", "license", "cosine"])

    judged = flat.join(others, "row", "left").select("row", "p", "others")
    judged = judged.mapInArrow(judge, "row long, license string, cosine double").filter("license is not null")
    judged = judged.withColumnRenamed("row", row)
    own = parts.join(judged, row, "left").select(*names, "license", "cosine")
    own = own.withColumn(speaks, F.coalesce(is_licence_file, F.lit(False)))
    own = settle(own.withColumn(here, directory(F.col(path))), "licenses")

    over, said, under = (unused(own, c) for c in ("above", "dir_license", "dir"))
    spoken = own.filter(F.col(speaks) & F.col("license").isNotNull())
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l")))
    spoken = spoken.groupBy(F.col(here).alias(over)).agg(best.alias("b"))
    spoken = settle(spoken.select(over, F.col("b.l").alias(said)), "spoken")
    dirs = own.filter(f"license is null and `{here}` is not null").select(F.col(here).alias(under)).distinct()
    parts = F.split(F.col(under), "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    pairs = dirs.select(under, F.posexplode(above).alias("depth", over)).join(spoken, over)
    nearest = pairs.groupBy(under).agg(F.max(F.struct("depth", over, said)).alias("n"))
    nearest = settle(nearest.select(under, F.col("n")[over].alias(over), F.col("n")[said].alias(said)), "nearest")
    out = own.join(nearest, F.col(here) == F.col(under), "left")
    inherits = F.col("license").isNull() & F.col(said).isNotNull()
    origin = F.when(F.col("license").isNotNull(), "own").when(inherits, "inherited").otherwise("none")
    return (
        out.withColumn("origin", origin)
        .withColumn("license_dir", F.when(inherits, F.col(over)))
        .withColumn("license", F.coalesce("license", said))
        .select(*names, *named)
    )
