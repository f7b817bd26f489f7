import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterflow.llm import licenses

FILES = "doc_id long, path string, text string"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def brute_best(text, templates, frequency, texts, threshold=0.8):
    names = {n for n, _ in templates}
    holders = lambda w: len({n for n, t in templates if w in licenses.words_of(t)})
    tells = {w: math.log((len(names) + 1) / (holders(w) + 1)) + 1 for _, t in templates for w in licenses.words_of(t)}
    weight = lambda w: (math.log((texts + 1) / (frequency.get(w, 0) + 1)) + 1) * tells.get(w, math.log(len(names) + 1) + 1)
    vector = lambda ws: {w: n * weight(w) for w, n in Counter(ws).items()}
    words, found = licenses.words_of(text), []
    for name, t in templates:
        v = vector(licenses.words_of(t))
        size = len(licenses.words_of(t))
        for s in range(max(1, len(words) - size + 1)):
            u = vector(words[s : s + size])
            if not u:
                continue
            cosine = sum(x * v[w] for w, x in u.items() if w in v) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
            if cosine >= threshold:
                found.append((name, cosine, s, s + size))
    best = next((x for x in found if x[1] >= max(c for _, c, _, _ in found) - 1e-12), None)
    margin = licenses.MARGIN if best and best[1] < 1 - 1e-9 else 1e-9
    if best and any(n != best[0] and c > best[1] - margin and a < best[3] and best[2] < z for n, c, a, z in found):
        return None
    return best and best[:3]


TEXTS = [
    "print hello\n# Licensed under the Apache License, Version 2.0.\ncode code",
    "some words RELEASED under the MIT license and more words",
    "licensed under the mit licence of our own house rules here",
    "This work is licensed under the GNU General Public License version 3",
    "Licensed under CC BY 4.0. but also Licensed under CC BY-NC 4.0.",
    "the software is software",
    "nothing to see",
    "",
]


def test_matches_equal_brute_force(spark):
    files = spark.createDataFrame([(i, f"d/{i}", t) for i, t in enumerate(TEXTS)], FILES)
    vocabulary = frozenset(w for _, t in licenses.TEMPLATES for w in licenses.words_of(t))
    frequency, total = licenses.document_frequencies(files.select("text"), vocabulary)
    assert total == len(TEXTS)
    assert all(n == sum(w in licenses.words_of(t) for t in TEXTS) for w, n in frequency.items())
    got = rows(licenses.scan(files))
    for i, t in enumerate(TEXTS):
        want = brute_best(t, licenses.TEMPLATES, frequency, total)
        found = (got[i].own_licence, got[i].score, got[i].first_word)
        assert found == (None, None, None) if want is None else found == (want[0], pytest.approx(want[1]), want[2])


def test_nearest_ancestor_speaks(spark):
    mit, gpl, apache = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0."
    table = [
        (0, "LICENSE", mit), (1, "a/x.py", "code"), (2, "a/b/COPYING.txt", gpl), (3, "a/b/c/y.py", "code"), (4, "a/b/z.py", apache), (5, "top.py", "code"), (6, "q/NOTICE", "no licence in here"),
        (7, "q/r/s.py", "code"), (8, None, "code"), (9, "a/bb/w.py", "code"), (10, "u/LICENSE.b", mit), (11, "u/LICENSE.a", mit), (12, "u/v", "x"), (13, "a/mylicense.py", gpl),
    ]
    got = rows(licenses.scan(spark.createDataFrame(table, FILES)))
    assert {i: (r.licence, r.origin, r.inherited_from) for i, r in got.items()} == {
        0: ("MIT", "file", None), 1: ("MIT", "inherited", "LICENSE"), 2: ("GPL-3.0", "file", None), 3: ("GPL-3.0", "inherited", "a/b/COPYING.txt"), 4: ("Apache-2.0", "header", None), 5: ("MIT", "inherited", "LICENSE"),
        6: ("MIT", "inherited", "LICENSE"), 7: ("MIT", "inherited", "LICENSE"), 8: (None, "none", None), 9: ("MIT", "inherited", "LICENSE"), 10: ("MIT", "file", None), 11: ("MIT", "file", None),
        12: ("MIT", "inherited", "u/LICENSE.a"), 13: ("GPL-3.0", "header", None),
    }


def test_odd_rows_and_empty_table(odd, empty):
    paths = licenses.paths_of(odd)
    found = licenses.scan(paths.withColumn("own", F.lit(1)).withColumn("dir", F.lit(2)))
    assert found.count() == odd.count()
    assert found.where("own_licence IS NOT NULL").count() == 0
    assert licenses.scan(licenses.paths_of(empty)).count() == 0


WHOLE = {
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\nCopyright (C) 2007 Free Software Foundation\nPreamble\nThe GNU Affero General Public License is a free, copyleft license ... specifically designed to ensure cooperation. You may link it with work under the GNU General Public License, version 3.",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nThis version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nEveryone is permitted to copy and distribute verbatim copies",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY",
    "BSD-3-Clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "GPL-2.0": "// SPDX-License-Identifier: GPL-2.0-only",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "Apache-2.0": "/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License. */",
}
#: Neither named wrongly nor guessed: close to several licences, or to none.
UNSURE = ["Licensed under CC BY-XX 4.0.", "SPDX-License-Identifier: Foo-1.0", "This work is licensed under the GNU General Public License, version 4."]


@pytest.mark.parametrize("filler", [0, 5000])
def test_families_are_told_apart_or_refused(filler):
    """With equal frequencies, and in a corpus where ordinary words are common."""
    vocabulary = {w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)}
    common = {"this", "the", "of", "and", "to", "in", "is", "or", "for", "with", "by", "as", "2", "3", "4.0", "version"}
    matcher = licenses.Matcher(licenses.TEMPLATES, {w: filler if w in common else 0 for w in vocabulary}, 2 * filler)
    assert {k: (matcher.best(f"x = 1\n{t}\ny = 2") or [None])[0] for k, t in WHOLE.items()} == {k: k for k in WHOLE}
    assert [matcher.best(t) for t in UNSURE] == [None] * len(UNSURE)
    for name, text in licenses.TEMPLATES:
        assert matcher.best(f"a b {text} c d")[0] == name, text
