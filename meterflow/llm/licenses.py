"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance by path.

1. Document frequencies of the templates' words over all texts, whole, in one pass (a table no larger
   than the templates' vocabulary). A word's weight is its count times ln((N + 1) / (df + 1)) + 1, times
   the same measure over the licences, so that the words which tell licences apart decide; words
   outside the vocabulary weigh as words of no text and no licence.
2. Every window of a template's number of words, anywhere in a text, is compared to the template by
   cosine of sparse TF-IDF vectors. A window below the threshold need not be met: the rarest words
   of a template that together hold more than 1 - threshold**2 of its squared length are found
   first, and only windows with at least one of them can reach the threshold. The best template
   (then the first in the list) is the file's own licence, unless another licence's template is within
   MARGIN of it on overlapping words (or equals it, where the words are all its own): a wrong answer would be worse than none.
3. A file whose name is LICENSE, LICENCE, COPYING, NOTICE or UNLICENSE, with any ending, speaks for
   its directory. Directories, not files, are expanded to their ancestors and joined to what speaks;
   the nearest ancestor wins, files then take their directory's licence where they have none of
   their own. Of several licence files in one directory the best score, then the first name, counts.

Null texts count as empty and have no licence; files with a null path inherit nothing. Repeated rows
each get their result. Empty tables give empty tables. Columns other than id, path and text are not
read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAZY_CHARS, lean, small, text_of, written

THRESHOLD = 0.8
WORDS = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
FILE_NAME = r"(?i)^(?:un)?(?:licen[sc]e|copying|notice)(?:[.\-_].*)?$"
#: Another licence's template this close to the best, on words the two windows share, makes the answer unsure: none is given.
MARGIN = 0.01
_FREE = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{then} either version {v} of the License, or (at your option) any later version."
_GNU = (("GPL-3.0", "", "3"), ("GPL-2.0", "", "2"), ("AGPL-3.0", "Affero ", "3"), ("LGPL-3.0", "Lesser ", "3"), ("LGPL-2.1", "Lesser ", "2.1"))
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Notices, file headings and telling passages of common licences, in their publishers' wording.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    *NOTICES,
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in _CC),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License") for k, name in _CC.items()),
    *((f"CC-{k}-4.0", f"Creative Commons {name} 4.0 International Public License") for k, name in _CC.items()),
    *((name, _FREE.format(what=what, mark=mark, kind=kind, then=then, v=v)) for name, kind, v in _GNU for what in ("program", "library") for mark, then in ((":", ","),)),
    *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys([*(n for n, _ in NOTICES), *(f"CC-{k}-4.0" for k in _CC)])),
    *((name, f"SPDX-License-Identifier: {name}-{end}") for name, _, _ in _GNU for end in ("only", "or-later")),
)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def telling(templates) -> dict[str, float]:
    """How much a word tells licences apart: ln((L + 1) / (l + 1)) + 1 for a word of l of L licences' templates."""
    has: dict[str, set[str]] = {}
    for name, text in templates:
        for w in words_of(text):
            has.setdefault(w, set()).add(name)
    names = len({name for name, _ in templates})
    return {w: math.log((names + 1) / (len(of) + 1)) + 1 for w, of in has.items()}


class Matcher:
    """Finds the best template of a text, given the document frequencies of the templates' words."""

    def __init__(self, templates, frequency: dict[str, int], texts: int, threshold: float = THRESHOLD):
        self.threshold = threshold
        tells = telling(templates)
        self.weight = {w: (math.log((texts + 1) / (n + 1)) + 1) * tells.get(w, 1.0) for w, n in frequency.items()}
        self.unknown = (math.log(texts + 1) + 1) * (math.log(len({name for name, _ in templates}) + 1) + 1)
        self.templates = []
        for name, text in templates:
            words = words_of(text)
            if not words:
                continue
            vector = self.vector(words)
            length = math.sqrt(sum(x * x for x in vector.values()))
            needed, share = set(), 0.0
            for w in sorted(vector, key=lambda w: (-self.weight.get(w, self.unknown), w)):
                needed.add(w)
                share += vector[w] ** 2
                if share > (1 - threshold**2) * length**2 + 1e-9:
                    break
            self.templates.append((name, len(words), vector, length, needed))
        self.needed = set().union(*(t[4] for t in self.templates)) if self.templates else set()
        # Every needed word stands alone in the token pattern, so a plain search decides whether to look closer.
        self.quick = re.compile("|".join(map(re.escape, sorted(self.needed, key=len, reverse=True))) or r"(?!)")

    def vector(self, words: list[str]) -> dict[str, float]:
        return {w: n * self.weight.get(w, self.unknown) for w, n in Counter(words).items()}

    def best(self, text: str) -> tuple[str, float, int] | None:
        """(licence, cosine, first word), or None: nothing close enough, or two licences as close on the same words."""
        lowered = text.lower()
        if not self.quick.search(lowered):
            return None
        words = WORDS.findall(lowered)
        places = [i for i, w in enumerate(words) if w in self.needed]
        here = {words[p] for p in places}
        found: list[tuple[str, float, int, int]] = []
        for name, size, vector, length, needed in self.templates:
            if needed.isdisjoint(here):
                continue
            starts = set()
            for p in places:
                if words[p] in needed:
                    starts.update(range(max(0, p - size + 1), max(1, min(p, len(words) - size) + 1)))
            for start in sorted(starts):
                window = self.vector(words[start : start + size])
                dot = sum(x * vector[w] for w, x in window.items() if w in vector)
                cosine = dot / (length * math.sqrt(sum(x * x for x in window.values())))
                if cosine >= self.threshold - 1e-12:
                    found.append((name, cosine, start, start + size))
        best = None
        for x in found:
            if best is None or x[1] > best[1] + 1e-12:
                best = x
        # Words that are all the template's own are sure, unless another licence has the same.
        margin = MARGIN if best is not None and best[1] < 1 - 1e-9 else 1e-9
        if best is None or any(x[0] != best[0] and x[1] > best[1] - margin and x[2] < best[3] and best[2] < x[3] for x in found):
            return None
        return best[:3]


def document_frequencies(texts: DataFrame, vocabulary: frozenset[str]) -> tuple[dict[str, int], int]:
    """How many texts have each word of the vocabulary, and how many texts there are."""

    def run(frames):
        import pyarrow as pa

        counts: Counter = Counter()
        for batch in frames:
            for text in batch.column(0).to_pylist():
                lowered = text.lower()
                found = {m.group() for m in WORDS.finditer(lowered)} if len(lowered) > LAZY_CHARS else set(WORDS.findall(lowered))
                counts.update(vocabulary.intersection(found))
            counts[""] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the vocabulary, no more
    found = {r["word"]: r["n"] for r in rows}
    total = found.pop("", 0)
    return {w: found.get(w, 0) for w in vocabulary}, total


def own_licences(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, own, score, first_word) for each row of files (id, path, text)."""
    spark = files.sparkSession
    vocabulary = frozenset(w for _, t in templates for w in words_of(t))
    frequency, total = document_frequencies(files.select("text"), vocabulary)
    shared = spark.sparkContext.broadcast((tuple(templates), frequency, total, threshold))
    kind = files.schema["id"].dataType.simpleString()

    def run(frames):
        import pyarrow as pa

        matcher = Matcher(*shared.value)
        for batch in frames:
            found = [matcher.best(t) or (None, None, None) for t in batch.column(2).to_pylist()]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "path", "own", "score", "first_word"])

    return files.mapInArrow(run, f"id {kind}, path string, own string, score double, first_word long")


def scan(files: DataFrame, id_col: str = "doc_id", path: str = "path", text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, own_licence, score, first_word, licence, origin, inherited_from) for each row of files.

    origin: file (a licence file with a match), header (a match in any other file), inherited, none.
    """
    lean(files.sparkSession)
    frame = files.select(F.col(id_col).alias("id"), F.col(path).cast("string").alias("path"), text_of(text).alias("text"))
    found = written(own_licences(frame, templates, threshold), "licences")
    name, directory = F.regexp_extract("path", "[^/]*$", 0), F.regexp_replace("path", "/?[^/]*$", "")
    rows = found.withColumn("is_file", F.coalesce(F.regexp_like(name, F.lit(FILE_NAME)), F.lit(False))).withColumn("dir", directory)

    speaks = rows.where("is_file AND own IS NOT NULL").groupBy("dir")
    speaks = speaks.agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("m")).select(F.col("dir").alias("ancestor"), F.col("m.own").alias("licence"), F.col("m.path").alias("from"))
    speaks = written(speaks, "declared")
    steps = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("ancestor")))
    dirs = rows.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.inline(ancestors))
    nearest = dirs.join(speaks, "ancestor").groupBy("dir").agg(F.max_by(F.struct("licence", "from"), "depth").alias("m"))
    nearest = written(nearest.select("dir", F.col("m.licence").alias("inherited"), F.col("m.from").alias("inherited_from")), "inherited")

    out = rows.join(small(nearest, 50_000), "dir", "left")
    takes = F.col("own").isNull() & F.col("inherited").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.col("own").alias("own_licence"),
        "score",
        "first_word",
        F.coalesce("own", "inherited").alias("licence"),
        F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(takes, "inherited").otherwise("none").alias("origin"),
        F.when(takes, F.col("inherited_from")).alias("inherited_from"),
    )


def paths_of(docs: DataFrame) -> DataFrame:
    """documents as files: source/lang/thousand/id.txt. Ids divisible by 20 are licence files, of their
    thousand, of source/lang (ids divisible by 100) or of the source (ids divisible by 1000)."""
    part = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("_"))
    n = F.col("doc_id")
    thousand = F.floor(n / 1000).cast("string")
    level = F.when(n % 1000 == 0, F.array(part("source"))).when(n % 100 == 0, F.array(part("source"), part("lang"))).otherwise(F.array(part("source"), part("lang"), thousand))
    name = F.when(n % 20 == 0, F.concat(F.lit("LICENSE."), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat(F.array_join(level, "/"), F.lit("/"), name).alias("path"), "text")
