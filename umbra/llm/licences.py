"""Licence scans: Dice coefficient over word bigrams against templates (DataFrame functions only).

Units of a text are the whole text, its paragraphs (parted by blank lines), its lines and
its sentences (in the whole text, so also those wrapped over lines).  Units and templates are normalised alike: lower case, every run of characters
that are neither letters nor digits one space.  With a unit's and a template's sets of
bigrams A and B, 2|A and B| / (|A| + |B|) can reach the threshold t only if |A| lies
between t / (2 - t) and (2 - t) / t times |B|: those bounds name the few templates a
unit is compared with.

The same inequality says how many of its bigrams a template must share, so a set of key
words that stand in more than the others of them is certain to occur in any match;
texts without a key word are passed over after one search.  All is done row by row,
with no exchange.
"""

from __future__ import annotations

import math
import re
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import inputs

THRESHOLD = 0.85
SENTENCE_END = r"[.!?;:]+\s+"

# Public licence notices and grants, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    (
        "BSD-2-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-2-Clause",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
    # File headers, titles and openings of licences.
    (
        "Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with "
        "this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version "
        '2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    (
        "Apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, "
        "no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, "
        "sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    # Identifiers of the same licences, as one line names them.
    *(
        (name, f"SPDX-License-Identifier: {identifier}")
        for name, identifiers in (
            ("MIT", ("MIT",)),
            ("Apache-2.0", ("Apache-2.0",)),
            ("GPL-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+")),
            ("GPL-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+")),
            ("LGPL-2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")),
            ("LGPL-3.0", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
            ("AGPL-3.0", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
            ("MPL-2.0", ("MPL-2.0",)),
            ("BSD-2-Clause", ("BSD-2-Clause",)),
            ("BSD-3-Clause", ("BSD-3-Clause",)),
            ("ISC", ("ISC",)),
            ("Unlicense", ("Unlicense",)),
            ("CC-BY-4.0", ("CC-BY-4.0",)),
            ("CC-BY-SA-4.0", ("CC-BY-SA-4.0",)),
            ("CC-BY-NC-4.0", ("CC-BY-NC-4.0",)),
            ("CC0-1.0", ("CC0-1.0",)),
        )
        for identifier in identifiers
    ),
)


def normalise(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def bigrams(text: str) -> frozenset[str]:
    words = normalise(text).split(" ")
    return frozenset(f"{a} {b}" for a, b in zip(words, words[1:]))


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """The sizes of sets that can reach ``threshold`` with one of ``size`` (a hair's breadth wider)."""
    share = threshold / (2 - threshold)
    return math.ceil(share * size - 1e-9), math.floor(size / share + 1e-9)


@cache
def key_words(templates: tuple[tuple[str, str], ...], threshold: float) -> tuple[str, ...]:
    """Words of which any text that reaches ``threshold`` with a template has one.

    Greedy cover: a template is safe once its bigrams without a key word are fewer than
    those that a match must share; each time the word that brings most is taken, the
    longer of two as good.
    """
    todo = [(set(b), math.ceil(threshold / (2 - threshold) * len(b) - 1e-9)) for _, t in templates if (b := bigrams(t))]
    keys: list[str] = []
    while todo:
        gain: dict[str, int] = {}
        for left, need in todo:
            short = len(left) - need + 1
            for w in {w for b in left for w in b.split(" ")}:
                gain[w] = gain.get(w, 0) + min(short, sum(w in b.split(" ") for b in left)) * len(w) ** 2
        best = max(gain, key=lambda w: (gain[w], w))
        keys.append(best)
        todo = [(left, need) for left, need in (({b for b in left if best not in b.split(" ")}, need) for left, need in todo) if len(left) >= need]
    return tuple(sorted(keys))


def scan(
    df: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of ``df``: doc_id, licence, template, dice, n_matches.

    licence and template (its number) are those of the largest coefficient over all
    units, of equal ones the first template; a template that names no licence
    (``LicenseRef-``) only counts where no other matches.  null, with n_matches 0, where
    no unit reaches ``threshold``.  n_matches counts the different units that reach it.  Null,
    empty and blank texts match nothing; repeated rows each give a row; ids may be null.
    """
    sets = [bigrams(t) for _, t in templates]
    bounds = [size_bounds(len(b), threshold) if b else (1, 0) for b in sets]
    low, high = min((a for a, _ in bounds), default=1), max((b for _, b in bounds), default=0)
    keys = key_words(templates, threshold)
    text = F.col("_t")
    may = F.lower(text).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, keys)) + r")(?![\p{L}\p{N}])") if keys else F.lit(False)
    units = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n"), F.split(text, SENTENCE_END)))
    words = F.transform(units, lambda u: F.split(F.trim(F.regexp_replace(F.lower(u), r"[^\p{L}\p{N}]+", " ")), " "))
    fits = lambda w: (F.size(w) > low) & ((F.size(w) - 1 <= high) | (F.size(F.array_distinct(w)) - 1 <= high))

    def pairs(w: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))

    def best(b: Column) -> Column:
        n = F.size(b)
        scores = [
            F.when(n.between(lo, hi), F.struct(F.lit(not name.startswith("LicenseRef-")).alias("named"), (F.lit(2.0) * F.size(F.array_intersect(b, F.array(*map(F.lit, sorted(s))))) / (n + len(s))).alias("dice"), F.lit(-i).alias("t")))
            for i, (s, (lo, hi), (name, _)) in enumerate(zip(sets, bounds, templates))
            if s
        ]
        # Of what reaches the threshold, so that a named licence below it does not stand before the rest.
        return F.array_max(F.filter(F.array(*scores), lambda x: x["dice"] >= threshold))

    rows = inputs(df, doc_id=(id_col, "long"), _t=(text_col, "string"))
    if not any(sets):
        found = F.array().cast("array<struct<named:boolean,dice:double,t:int>>")
        rows = rows.select("doc_id", found.alias("found"))
    else:
        rows = rows.select("doc_id", F.when(may, F.filter(words, fits)).alias("words"))
        rows = rows.select("doc_id", F.array_distinct(F.transform("words", pairs)).alias("pairs"))
        rows = rows.select("doc_id", F.filter(F.transform("pairs", best), lambda s: s.isNotNull()).alias("found"))
    top = F.array_max("found")
    names = F.array(*(F.lit(name) for name, _ in templates)) if templates else F.array().cast("array<string>")
    rows = rows.select("doc_id", top.alias("top"), F.coalesce(F.size("found"), F.lit(0)).alias("n"))
    return rows.select(
        "doc_id",
        F.get(names, -F.col("top.t")).alias("licence"),
        (-F.col("top.t")).alias("template"),
        F.col("top.dice").alias("dice"),
        F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_matches"),
    )
