"""Licence scan: a positional index of rare licence words. DataFrame functions only.

The templates, notices and whole licence texts, are indexed by word with positions and the
words' inverse document frequency among the templates. A template whose mandatory key
phrase stands in a text has its rarest words looked up there; each occurrence votes, for
every posting of its word, for the place where the template would begin. The place that
most postings agree on is the alignment; rare words that are missing or stand elsewhere
count against it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents
from tessella.llm.winnowing import let

#: Characters that words don't have, once A-Z are lower-cased.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
LOWER_WORD = f"[^{GAP}]+"
#: The same words in a text as it is.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose places are counted, and their labels: fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: str  # must stand in a text that gets the label


#: Notices by which licences are usually named or begin: fixed values.
TEMPLATES = (
    Template("mit", "Released under the MIT License", "mit license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission is hereby granted free of charge"),
    Template("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "in compliance with the license"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", "general public license"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lesser general public license"),
    Template("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("bsd", "Released under the BSD License", "bsd license"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    Template("cc-by", "Licensed under CC BY 4.0", "cc by 4"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright; CC0 1.0 Universal", "cc0 1"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public license"),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
)
#: Whole licence texts, or what files carry of them: fixed values.
BODIES = (
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
        IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "permission is hereby granted free of charge",
    ),
    Template(
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
        "in compliance with the license",
    ),
    Template(
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
        "gnu general public license",
    ),
    Template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
        notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
        OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "distribute this software for any purpose",
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
        source distribution.""",
        "altered source versions must be plainly marked",
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
        copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.""",
        "unencumbered software",
    ),
    Template(
        "mpl",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
        one at http://mozilla.org/MPL/2.0/.""",
        "mozilla public license",
    ),
)


def words_of(text: str) -> list[str]:
    return re.findall(LOWER_WORD, text.translate(str.maketrans(UPPER, LOWER)))


class Index:
    """Postings, frequencies and lengths of the templates, as one value that the plan carries."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = list(templates)
        self.words = [words_of(t.text) for t in templates]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for t, own in enumerate(self.words):
            for p, w in enumerate(own):
                self.postings.setdefault(w, []).append((t, p))
        n = len(self.templates)
        self.idf = {w: math.log(1 + n / len({t for t, _ in own})) for w, own in self.postings.items()}
        self.rarest_first = sorted(self.postings, key=lambda w: (-self.idf[w], w))

    #: Of each template: its label, key phrase between blanks, words, how near places agree, its rarest words, their postings in it and how many these are.
    SCHEMA = "array<struct<label:string,phrase:string,n:int,slack:int,rare:array<string>,postings:map<string,array<int>>,asked:int>>"

    def as_json(self, rarest: int) -> str:
        rows = []
        for template, own in zip(self.templates, self.words, strict=True):
            places: dict[str, list[int]] = {}
            for p, w in enumerate(own):
                places.setdefault(w, []).append(p)
            rare = sorted(places, key=lambda w: (-self.idf[w], w))[:rarest]
            postings = {w: places[w] for w in rare}
            phrase = f" {' '.join(words_of(template.phrase))} "
            rows.append({"label": template.label, "phrase": phrase, "n": len(own), "slack": max(1, len(own) // 10), "rare": rare, "postings": postings, "asked": sum(map(len, postings.values()))})
        return json.dumps(rows)

    def gate(self) -> str:
        """A pattern for texts that can hold a key phrase at all: the base phrases' last words, and the rarest of a phrase without them."""
        keys = {words_of(phrase)[-1] for phrase, _ in BASE}
        for t in self.templates:
            own = words_of(t.phrase)
            if not keys & set(own):
                keys.add(max(own, key=lambda w: (self.idf.get(w, 9.0), len(w))))
        edge = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
        return f"(?i)(?<!{edge})(?:{'|'.join(sorted(map(re.escape, keys)))})(?!{edge})"


def phrase_at(words: Column, i: Column, phrase: str) -> Column:
    """Whether the phrase's words stand from word i on."""
    parts = [F.coalesce(F.get(words, i + j) == w, F.lit(False)) for j, w in enumerate(words_of(phrase))]
    found = parts[0]
    for p in parts[1:]:
        found = found & p
    return found


def best_place(votes: Column) -> Column:
    """The place of most votes, the first of equal ones, and how many: runs of equal values in order, so long lists cost no more than sorting."""
    start = F.struct(F.lit(None).cast("int").alias("now"), F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["now"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("now"), run.alias("run"), F.greatest(acc["best"], run).alias("best"), F.when(run > acc["best"], x).otherwise(acc["at"]).alias("at"))

    return F.aggregate(F.array_sort(votes), start, step, lambda acc: F.struct(acc["best"].alias("best"), acc["at"].alias("at")))


def scan(df: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES + BODIES, rarest: int = 24, least: float = 0.6) -> DataFrame:
    """Adds n_words, base_places (array of struct<start, label>), matches (array of struct<label, score, start>).

    Null and empty texts have no words and no places. All columns are made row by row, so
    nothing is shuffled and no text meets another; columns of those names are replaced.
    Only texts that hold a word of a phrase are split into words. Every template whose key
    phrase stands in a text is aligned by its own `rarest` rarest words, however many
    templates a text holds; it matches where at least `least` of these words' postings
    agree on a place. Places agree within a tenth of the template's length, as names and
    years are put into licences; `start` is that near the template's first word. Repeated
    rows have equal results.
    """
    index = Index(templates)
    table = F.from_json(F.lit(index.as_json(rarest)), Index.SCHEMA)  # one value for all templates, however many

    def places(words: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("start"), F.coalesce(*[F.when(phrase_at(words, i, p), F.lit(label)) for p, label in BASE]).alias("label")))
        return F.filter(starts, lambda s: s["label"].isNotNull())

    def matches(words: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return let(F.struct(words.alias("words"), line.alias("line")), verdicts)

    def verdicts(x: Column) -> Column:
        named = F.filter(table, lambda t: F.contains(x["line"], t["phrase"]))
        return F.filter(F.transform(named, lambda t: aligned(x["words"], t)), lambda m: m["score"] >= least)

    def aligned(words: Column, t: Column) -> Column:
        n, slack = t["n"], t["slack"]
        hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(t["rare"], h["w"]))
        # where the template would begin, counted from its length before the text, and the posting that says so
        votes = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(t["postings"], h["w"]), lambda p: F.struct((h["i"] - p + n).alias("at"), p.alias("p")))))

        def agreed(v: Column, shift: Column) -> Column:
            once = F.array_distinct(F.transform(v, lambda x: F.struct(F.floor((x["at"] + shift) / slack).cast("int").alias("bin"), x["p"].alias("p"))))
            found = best_place(F.transform(once, lambda x: x["bin"]))
            return let(found, lambda f: F.struct(f["best"].alias("best"), (f["at"] * slack - shift - n).alias("at")))

        def better(v: Column) -> Column:  # a place near the edge of one bin is inside one of the other
            half = F.floor(slack / 2).cast("int")
            best = F.array_max(F.transform(F.array_distinct(F.array(F.lit(0), half)), lambda shift: agreed(v, shift)))
            return let(best, lambda b: F.struct(t["label"].alias("label"), (b["best"] / t["asked"]).alias("score"), F.greatest(b["at"], F.lit(0)).cast("long").alias("start")))

        return let(votes, better)

    whole = F.coalesce(F.col(text), F.lit(""))
    gated = F.when(whole.rlike(index.gate()), F.regexp_extract_all(F.translate(whole, UPPER, LOWER), F.lit(LOWER_WORD), F.lit(0)))
    none = F.array().cast("array<struct<start:int,label:string>>")
    no_match = F.array().cast("array<struct<label:string,score:double,start:bigint>>")

    def found(words: Column) -> Column:
        some = F.size(words) > 0
        return F.struct(
            F.when(some, places(words)).otherwise(none).alias("base_places"),
            F.when(some, matches(words)).otherwise(no_match).alias("matches"),
        )

    df = df.drop("n_words", "base_places", "matches")
    df = df.withColumn("n_words", F.regexp_count(whole, F.lit(ANY_WORD)).cast("long")).withColumn("__found", let(gated, found))
    return df.withColumn("base_places", F.col("__found.base_places")).withColumn("matches", F.col("__found.matches")).drop("__found")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    rows = scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.array_distinct(F.transform("base_places", lambda s: s["label"]))
    starts = F.transform("base_places", lambda s: s["start"].cast("long"))
    every = F.array_union(base, F.transform("matches", lambda m: m["label"]))
    scores = F.concat(F.transform("matches", lambda m: F.least(m["score"], F.lit(1.0))), F.array(F.when(F.size("base_places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.array_max(scores).alias("score"),
    )
