"""License scans by a positional index of rare words, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import ascii_lower, let

#: What stands between two words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Fixed values: (label, key phrases that must stand whole at their place in the notice, notice).
NOTICES = [
    ("agpl-3.0", ["gnu affero general public license"], """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("apache-2.0", ["apache license version 2 0"], """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("apache-2.0", ["apache license version 2 0"], "Licensed under the Apache License, Version 2.0"),
    ("bsd", ["redistribution and use in source and binary forms"], """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""),
    ("bsl-1.0", ["boost software license version 1 0"], "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("cc-by-4.0", ["cc by 4 0"], "Licensed under CC BY 4.0"),
    ("cc-by-4.0", ["creative commons attribution 4 0"], """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit
http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""),
    ("cc-by-nc", ["cc by nc"], "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", ["creative commons attribution noncommercial"], "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", ["cc by sa"], "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", ["creative commons attribution sharealike"], "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", ["cc0 1 0"], "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    ("epl-2.0", ["eclipse public license"], """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0"""),
    ("gpl-2.0", ["gnu general public license version 2"], "Licensed under the GNU General Public License version 2"),
    ("gpl-3.0", ["gnu general public license version 3"], "This work is licensed under the GNU General Public License version 3."),
    ("gpl", ["terms of the gnu general public license"], """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("gpl", ["terms of the gnu general public license"], "under the terms of the GNU General Public License"),
    ("isc", ["with or without fee is hereby granted"], """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("lgpl", ["gnu lesser general public license"], """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("mit", ["under the mit license"], "Released under the MIT License."),
    ("mit", ["permission is hereby granted free of charge"], """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("mpl-2.0", ["mozilla public license"], """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", ["free and unencumbered software", "public domain"], """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", ["in no event will the authors be held liable", "altered source versions must be plainly marked"], """This software is provided 'as-is', without any express or implied warranty. In no event will
the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."""),
]


def _split(text: str) -> list[str]:
    return [w for w in re.split(BREAK, text.lower()) if w]


#: (label, words of the notice, [(place, words) of each key phrase]).
TEMPLATES = []
for _label, _keys, _notice in NOTICES:
    _own = _split(_notice)
    _places = [(next(i for i in range(len(_own)) if _own[i : i + len(k)] == k), k) for k in map(_split, _keys)]
    TEMPLATES.append((_label, _own, _places))
VOCABULARY = sorted({w for p in BASE for w in p.split()} | {w for _, own, _ in TEMPLATES for w in own})
#: A place of a template in a text is one number: template * SPAN + start + SHIFT.
SPAN, SHIFT = 1 << 40, 1 << 10


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def _at(word_list: Column, start: Column, phrase: list[str]) -> Column:
    """True if `phrase` stands in `word_list` from index `start` (0 and up)."""
    e = F.get(word_list, start) == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        e = e & (F.get(word_list, start + k) == w)
    return F.coalesce(e & (start >= 0), F.lit(False))


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def word_idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents; as many rows as `VOCABULARY` at most."""
    df = docs.select(F.array_intersect(license_words(F.col(text)), _strings(VOCABULARY)).alias("w"))
    df = df.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in df.collect()}
    total = counts.pop("", 0)  # every text has the empty word once
    return {w: math.log((total + 1) / n) for w, n in counts.items()}


def _literal(words_: list[str]) -> Column:
    return F.split(F.lit(" ".join(words_)), " ")


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rarest: int = 6, min_votes: int = 2) -> DataFrame:
    """Finds licence notices in every whole text; one row per input row.

    Base: places of the `BASE` phrases. Method: for every template whose key phrases' words a text has, the `rarest` of
    the template's words that stand in this very text, by their IDF over all documents, are looked up; their places in
    the text and their postings in the template imply starts, and a start with `min_votes` votes counts if every key
    phrase stands whole at its relative place. `matches` holds those (label, start, share), share being the IDF weight
    of the template's words that stand in place. `score` is 0 without a label, 0.5 for base labels alone, and goes with the
    largest share from there up to 1 for a notice that stands whole: what is verified never counts less than a bare phrase. Null and empty texts have no words; very long texts are scanned whole; repeated rows are judged each; equal
    places are listed once; an empty table gives an empty table; other columns are not read.
    """
    idf = word_idf(docs, text)
    weight = {w: round(max(idf.get(w, 20.0), 1e-3), 9) for w in VOCABULARY}
    by_idf = sorted(VOCABULARY, key=lambda w: (-weight[w], w))

    df = docs.select(F.col(doc_id).alias("doc_id"), license_words(F.col(text)).alias("w"))
    df = df.withColumn("present", F.array_intersect("w", _literal(VOCABULARY)))
    has = lambda words_: F.size(F.array_except(_literal(sorted(set(words_))), F.col("present"))) == 0
    none = F.array().cast("array<int>")

    def places_of(phrase: list[str]) -> Column:
        return F.array_compact(F.transform("w", lambda w, i: F.when((w == phrase[0]) & _at(F.col("w"), i, phrase), i)))

    df = df.withColumns({f"at{k}": F.when(has(p.split()), places_of(p.split())).otherwise(none) for k, p in enumerate(BASE)})
    df = df.withColumn("starts", F.flatten(F.array(*(f"at{k}" for k in range(len(BASE))))))
    df = df.withColumn("base", F.array_compact(F.array(*(F.when(F.size(f"at{k}") > 0, F.lit(x)) for k, x in enumerate(BASE.values())))))

    # Templates whose key words are all there; none for almost every text, and nothing more is done then.
    struct = lambda k: F.struct(F.lit(k).alias("t"), _literal(TEMPLATES[k][1]).alias("words"), _literal(sorted(set(TEMPLATES[k][1]), key=by_idf.index)).alias("by_idf"))
    possible = [F.when(has([w for _, key in t[2] for w in key]), struct(k)) for k, t in enumerate(TEMPLATES)]
    df = df.withColumn("possible", F.array_compact(F.array(*possible)))

    def votes(text_words: Column, present: Column, templates: Column) -> Column:
        def of(t: Column) -> Column:
            own = F.slice(F.array_intersect(t["by_idf"], present), 1, rarest)  # in order of the first array
            places = lambda ws, x: F.array_compact(F.transform(ws, lambda w, i: F.when(w == x, i)))
            start = lambda i, q: t["t"].cast("long") * SPAN + i - q + SHIFT
            return F.flatten(F.transform(own, lambda x: F.flatten(F.transform(places(text_words, x), lambda i: F.transform(places(t["words"], x), lambda q: start(i, q))))))
        return F.array_sort(F.flatten(F.transform(templates, of)))

    df = df.withColumn("votes", F.when(F.size("possible") > 0, votes(F.col("w"), F.col("present"), F.col("possible"))).otherwise(F.array().cast("array<long>")))
    agreed = let(F.col("votes"), lambda v: F.array_distinct(F.array_compact(F.transform(v, lambda x, i: F.when(F.get(v, i + (min_votes - 1)) == x, x)))))

    labels = _literal([t[0] for t in TEMPLATES])
    words_ = F.array(*(_literal(t[1]) for t in TEMPLATES))
    weights = F.array(*(F.split(F.lit(" ".join(repr(weight[w]) for w in t[1])), " ").cast("array<double>") for t in TEMPLATES))

    def judged(v: Column) -> Column:
        t, start = F.floor(v / SPAN).cast("int"), (v % SPAN - SHIFT).cast("int")
        whole = F.lit(False)
        for k, (_, _, keys) in enumerate(TEMPLATES):
            stands = F.lit(True)
            for place, key in keys:
                stands = stands & _at(F.col("w"), start + place, key)
            whole = F.when(t == k, stands).otherwise(whole)
        # an index below 0 or behind the end gives null, which is not in place
        in_place = F.zip_with(F.transform(F.get(words_, t), lambda x, q: F.coalesce(F.get("w", start + q) == x, F.lit(False))), F.get(weights, t), lambda hit, w: F.when(hit, w).otherwise(F.lit(0.0)))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        return F.when(whole, F.struct(F.get(labels, t).alias("label"), start.alias("start"), F.least(total(in_place) / total(F.get(weights, t)), F.lit(1.0)).alias("share")))

    df = df.withColumn("matches", F.when(F.size("votes") > 0, F.array_compact(F.transform(agreed, judged))))
    df = df.withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<label:string,start:int,share:double>>")))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.array_max(F.transform("matches", lambda m: m["share"]))
    return df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.coalesce(0.5 + best / 2, F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
        "matches",
    )
