import re

from umbra.llm.licences import TEMPLATES, THRESHOLD, bigrams, key_words, scan, size_bounds


def brute(text):
    units = {text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n"), *re.split(r"[.!?;:]+\s+", text)} if text else set()
    best, hits = None, set()
    for u in units:
        a = bigrams(u)
        for i, (name, t) in enumerate(TEMPLATES):
            b = bigrams(t)
            d = 2 * len(a & b) / (len(a) + len(b))
            if d >= THRESHOLD:
                hits.add(a)
                if best is None or (name[:11] != "LicenseRef-", d, -i) > best[:3]:
                    best = (name[:11] != "LicenseRef-", d, -i, name)
    return (best[3], -best[2], best[1], len(hits)) if best else (None, None, None, 0)


MIT = TEMPLATES[2][1]
BSD = """Copyright (c) 2020, Acme Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CLAUSE = """
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
TEXTS = [
    BSD,
    BSD + CLAUSE,
    "Copyright 2020 Acme Inc. All rights reserved. Some prose follows.",
    "Our tool is new. This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published\nby the Free Software Foundation, either version 3 of the License, or (at your option) any later version. More prose.",
    "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore prose follows here.",
    "© 2020 Jane. ALL RIGHTS RESERVED",
    "all rights\nreserved",
    "  All -- rights __ reserved!! ",
    MIT,
    MIT.replace(". ", ".\n"),
    "Intro words.\n\n" + MIT.replace(", ", ",\n") + "\n\nOutro.",
    MIT.replace("hereby", "").replace("free of charge", "gratis") + " trailing",
    "licensed " * 500,
    ("free software license rights " * 200).strip(),
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.\nLicensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 2.",
]
ASF = """/*
 * Licensed to the Apache Software Foundation (ASF) under one or more
 * contributor license agreements.  See the NOTICE file distributed with
 * this work for additional information regarding copyright ownership.
 * The ASF licenses this file to You under the Apache License, Version 2.0
 * (the "License"); you may not use this file except in compliance with
 * the License.
 */
package example;
"""
NAMED = {
    ASF: "Apache-2.0",
    "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS": "Apache-2.0",
    "#!/bin/sh\n# SPDX-License-Identifier: GPL-2.0-or-later\nexit": "GPL-2.0",
    "// SPDX-License-Identifier: MIT\nint x;": "MIT",
    "<!-- SPDX-License-Identifier: CC-BY-SA-4.0 -->": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: LicenseRef-Other": None,
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright": "GPL-3.0",
    "The version of June 2007 is a public document.": None,
}
TEXTS += NAMED


def test_against_every_template(spark, odd):
    texts = TEXTS + [r.text for r in odd.select("text").collect()]
    rows = scan(spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, top int, found string")).collect()
    assert {r.doc_id: (r.licence, r.template, r.dice, r.n_matches) for r in rows} == {i: brute(t) for i, t in enumerate(texts)}
    assert sum(r.licence is not None for r in rows) >= 10
    assert [r.licence for r in sorted(rows, key=lambda r: r.doc_id)[:3]] == ["BSD-2-Clause", "BSD-3-Clause", "LicenseRef-All-Rights-Reserved"]


def test_headers_titles_and_identifiers(spark):
    rows = scan(spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")).collect()
    assert [r.licence for r in sorted(rows, key=lambda r: r.doc_id)] == list(NAMED.values())


def test_bounds_and_keys_lose_nothing():
    for size in range(1, 60):
        lo, hi = size_bounds(size, THRESHOLD)
        for n in range(1, 200):
            assert (2 * min(n, size) / (n + size) >= THRESHOLD) == (lo <= n <= hi)
    keys = key_words(TEMPLATES, THRESHOLD)
    for _, t in TEMPLATES:
        rest = {b for b in bigrams(t) if not set(b.split(" ")) & set(keys)}
        assert 2 * len(rest) / (len(rest) + len(bigrams(t))) < THRESHOLD


def test_other_templates_and_none(spark, none, odd):
    assert scan(none).count() == 0
    assert {r.licence for r in scan(odd, templates=()).collect()} == {None}
    rows = scan(odd, templates=(("x", "one two three four five six seven"),)).collect()
    assert {r.doc_id for r in rows if r.licence == "x"} == {1, 2}
