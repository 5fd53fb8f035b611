"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Terms are those of the templates, weighed by their document frequency over the whole corpus; any other word of
a text counts as a term of its own with the highest weight, so prose around a notice lowers its cosine. Scored
are the lines of a text, its blocks (lines between blank lines) and the whole text. A line or block above the
threshold is a header; a whole text above it is a licence file, and its licence holds for every file below its
directory that has no header of its own, unless a nearer directory has one. A licence's full text is far longer than
any notice, so it is told by its first and last words instead: a text is also a licence file if the words
from there to there (``TEXTS``) are the threshold's share of all its words; the share is then its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import prepare, stage

TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
THRESHOLD = 0.6

# fixed values: customary notices of public licences
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
     "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
]

# fixed values: licence, first words of its full text, words that must follow (or none), last words; by terms
TEXTS = [
    ("Apache-2.0", "apache license version 2.0 january 2004", "grant of patent license", "end of terms and conditions"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007", "conveying verbatim copies", "end of terms and conditions"),
    ("GPL-2.0", "gnu general public license version 2 june 1991", "you may copy and distribute verbatim copies", "end of terms and conditions"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007", "combined works", "permanent authorization for you to choose that version for the library"),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999", "work that uses the library", "end of terms and conditions"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991", "work that uses the library", "end of terms and conditions"),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007", "remote network interaction", "end of terms and conditions"),
    ("MPL-2.0", "mozilla public license version 2.0", "covered software", "incompatible with secondary licenses as defined by the mozilla public license v 2.0"),
    ("CC-BY-4.0", "creative commons attribution 4.0 international public license", "licensed rights", "section 8 interpretation"),
    ("CC-BY-SA-4.0", "creative commons attribution-sharealike 4.0 international public license", "adapter s license", "section 8 interpretation"),
    ("CC-BY-NC-4.0", "creative commons attribution-noncommercial 4.0 international public license", "noncommercial means", "section 8 interpretation"),
    ("CC-BY-ND-4.0", "creative commons attribution-noderivatives 4.0 international public license", "licensed rights", "section 8 interpretation"),
    ("CC-BY-NC-SA-4.0", "creative commons attribution-noncommercial-sharealike 4.0 international public license", "noncommercial means", "section 8 interpretation"),
    ("CC-BY-NC-ND-4.0", "creative commons attribution-noncommercial-noderivatives 4.0 international public license", "noncommercial means", "section 8 interpretation"),
    ("CC0-1.0", "cc0 1.0 universal", "statement of purpose", "duty or obligation with respect to this cc0 or use of the work"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software", "without warranty of any kind", "or other dealings in the software"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms", "endorse or promote products", "even if advised of the possibility of such damage"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms", "in binary form must reproduce", "even if advised of the possibility of such damage"),
    ("Unlicense", "this is free and unencumbered software released into the public domain", "without warranty of any kind", "for more information please refer to"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose", "provided that the above copyright notice", "use or performance of this software"),
]
#: words one of which every full text holds
FULL_TEXT = re.compile("license|terms and|redistribution|permission|unencumbered|cc0", re.IGNORECASE)


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def full_text(text: str, threshold: float = THRESHOLD) -> tuple[float, str] | None:
    """(share of the words, licence) of a full licence text that holds that share of ``text`` at least."""
    if not FULL_TEXT.search(text):
        return None
    words = f" {' '.join(terms(text))} "
    total, hits = words.count(" ") - 1, []
    for i, (name, first, then, last) in enumerate(TEXTS):
        start = words.find(f" {first} ")
        if start < 0:
            continue
        middle, end = words.find(f" {then} ", start), words.rfind(f" {last} ")
        if start < middle < end:
            share = words.count(" ", start, end + len(last) + 1) / total
            if share >= threshold:
                hits.append((share, -i, name))
    return max(hits)[::2] if hits else None


class Matcher:
    """Templates as sparse TF-IDF vectors of unit length."""

    def __init__(self, df: dict[str, int], docs: int, templates=TEMPLATES, threshold: float = THRESHOLD):
        vocabulary = sorted({t for _, text in templates for t in terms(text)})
        self.weight = {t: math.log((1 + docs) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
        self.other = math.log(1 + docs) + 1
        self.threshold = threshold
        self.templates, self.at = [], {}
        for i, (name, text) in enumerate(templates):
            tf = Counter(terms(text))
            norm = math.sqrt(sum((n * self.weight[t]) ** 2 for t, n in tf.items()))
            self.templates.append((name, {t: n * self.weight[t] / norm for t, n in tf.items()}))
            for t in tf:
                self.at.setdefault(t, []).append(i)

    def best(self, tf: Counter, others: int) -> tuple[float, str] | None:
        """(cosine, licence) of the best template at or above the threshold."""
        inside = sum((n * self.weight[t]) ** 2 for t, n in tf.items())
        norm2 = inside + others * self.other**2
        if inside < self.threshold**2 * norm2 or not inside:  # by Cauchy and Schwarz no template can reach it
            return None
        dots: dict[int, float] = {}
        for t, n in tf.items():
            for i in self.at[t]:
                dots[i] = dots.get(i, 0.0) + n * self.weight[t] * self.templates[i][1][t]
        cosine, i = max((d / math.sqrt(norm2), -i) for i, d in dots.items())
        return (min(1.0, cosine), self.templates[-i][0]) if cosine >= self.threshold else None

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """(licence, cosine or share, whether the whole text is the licence)."""
        if text and (hit := full_text(text, self.threshold)):
            return hit[1], hit[0], True
        found: list[tuple[float, str]] = []
        whole, block = Counter(), Counter()
        whole_others = block_others = block_lines = 0

        def close():
            if block_lines > 1 and (hit := self.best(block, block_others)):
                found.append(hit)

        for line in (text or "").split("\n"):
            own = terms(line)
            if not own:
                close()
                block, block_others, block_lines = Counter(), 0, 0
                continue
            tf = Counter(t for t in own if t in self.weight)
            others = len(own) - sum(tf.values())
            if hit := self.best(tf, others):
                found.append(hit)
            block.update(tf)
            whole.update(tf)
            block_others, whole_others, block_lines = block_others + others, whole_others + others, block_lines + 1
        close()
        if hit := self.best(whole, whole_others):
            return hit[1], hit[0], True
        if found:
            cosine, name = min(found, key=lambda f: (-f[0], f[1]))
            return name, cosine, False
        return None, 0.0, False


def _frequencies(vocabulary: list[str]):
    known = frozenset(vocabulary)

    def run(batches):
        count, docs = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                docs += 1
                if text:
                    count.update(known.intersection(terms(text)))
        rows = [("", docs), *count.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    return run


def fit(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> Matcher:
    """Document frequencies of the templates' terms over all rows; as many numbers as the templates have terms."""
    vocabulary = sorted({t for _, text in templates for t in terms(text)})
    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_frequencies(vocabulary), "term string, n long")
    df = {r[0]: r[1] for r in parts.groupBy("term").agg(F.sum("n")).collect()}
    return Matcher(df, df.pop("", 0), templates, threshold)


def directory(path) -> F.Column:
    """The part before the last slash; empty for a file at the top. Doubled and outer slashes don't count."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def ancestors(folder) -> F.Column:
    """The directory itself and all above it, up to the empty one."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(docs: DataFrame, path: F.Column, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, path, license, score, origin, license_dir.

    origin is ``file`` (the text is a licence), ``header``, ``inherited`` (from ``license_dir``, the nearest
    directory at or above the file's that holds a licence file) or ``none``. Of several licence files of one
    directory the best score counts, then the first name. Null and empty texts have no licence of their own; a
    null path lies in no directory and neither gives nor inherits. Repeated rows are scanned each. An empty
    table gives an empty result; only the named columns are read.
    """
    prepare(docs.sparkSession)
    matcher = fit(docs, text_col, templates, threshold)

    def run(batches):
        for batch in batches:
            out = [matcher.scan(t) for t in batch.column(0).to_pylist()]
            cols = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=["doc_id", "path", "own", "cosine", "whole"])

    clean = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/", "")
    slim = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), clean.cast("string").alias("path"))
    found = stage(slim.mapInArrow(run, "doc_id long, path string, own string, cosine double, whole boolean").withColumn("dir", directory(F.col("path"))), "licences")
    given = found.where("whole and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own").alias("given"))).alias("best"))
    given = given.select(F.col("dir").alias("above"), "best.given")
    # directories, not files, climb
    folders = found.where("own is null and dir is not null").select("dir").distinct()
    climbed = folders.select("dir", F.explode(ancestors(F.col("dir"))).alias("up"))
    nearest = climbed.join(given, F.col("up") == F.col("above")).groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "given")).alias("n"))
    nearest = nearest.select(F.col("dir").alias("folder"), F.col("n.up").alias("license_dir"), F.col("n.given").alias("given"))
    joined = found.join(nearest, F.col("own").isNull() & (F.col("dir") == F.col("folder")), "left")
    origin = F.when(F.col("whole"), "file").when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "doc_id", "path", F.coalesce("own", "given").alias("license"), F.col("cosine").alias("score"), origin.alias("origin"), "license_dir"
    )
