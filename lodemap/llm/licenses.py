"""Licence scan by sentence rules.

1. A text is cut into sentences.  A sentence ends at ``. ! ? ; :`` before white
   space; inside it each line, and each rest of the sentence from the start of a
   line, is a candidate too, so that a licence sentence is found behind a line
   without a full stop and also where it is wrapped over lines.
2. Candidates are normalised (lower case, everything but ASCII letters and digits
   is one space) and mapped to the identifiers of known licence sentences.
3. The identifiers of a text, in order, are matched against the rules, in order.
   A rule is a sequence of identifiers that have to follow each other; what a rule
   has matched is used up, so that general rules come after those they are part of.

DataFrame functions only, one pass over the rows and no shuffle: the known
sentences and rules are constants of the plan, whatever the size of the corpus.

Null and empty texts have no sentences and no licences.  Repeated rows each give
their row; a null id stays null.  Columns other than the two named ones are not
read.  A text may be as long as a row can be; nothing is cut off.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices and clauses as the licences state them.
SENTENCES = {
    "MIT-GRANT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MIT-NOTICE": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MIT-RELEASED": "Released under the MIT License",
    "MIT-LICENSED": "Licensed under the MIT License",
    "MIT-PROJECT": "This project is licensed under the terms of the MIT license",
    "AS-IS": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "NO-LIABILITY": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "ISC-GRANT": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "APACHE-2": "Licensed under the Apache License, Version 2.0",
    "APACHE-2-THE": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "APACHE-COMPLY": "you may not use this file except in compliance with the License",
    "APACHE-COPY-AT": "You may obtain a copy of the License at",
    "APACHE-COPY": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "APACHE-WARRANTY": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "APACHE-SEE": "See the License for the specific language governing permissions and limitations under the License",
    "GPL-3-WORK": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2-WORK": "This work is licensed under the GNU General Public License, version 2",
    "GPL-FREE": "This program is free software",
    "GPL-2-LATER": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-V2-LATER": "either version 2 of the License, or (at your option) any later version",
    "GPL-V3-LATER": "either version 3 of the License, or (at your option) any later version",
    "GPL-HOPE": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "GPL-MERCHANT": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "LGPL-FREE": "This library is free software",
    "LGPL-REDIST": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-V21-LATER": "either version 2.1 of the License, or (at your option) any later version",
    "AGPL-REDIST": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "BSD-REDIST": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-SOURCE": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSD-BINARY": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSD-ENDORSE": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "MPL-SUBJECT": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "MPL-2-COPY": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "UNLICENSE": "This is free and unencumbered software released into the public domain",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC-BY-4": "Licensed under CC BY 4.0",
    "CC-BY-SA-4": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-SA-4": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-4": "Licensed under CC BY-ND 4.0",
    "CC-BY-4-WORK": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4-WORK": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ALL-RIGHTS": "All rights reserved",
}

#: (licence, identifiers that follow each other): tried in this order.
RULES = (
    ("MIT", ("MIT-GRANT", "MIT-NOTICE", "AS-IS", "NO-LIABILITY")),
    ("MIT", ("MIT-GRANT", "MIT-NOTICE")),
    ("MIT", ("MIT-RELEASED",)),
    ("MIT", ("MIT-LICENSED",)),
    ("MIT", ("MIT-PROJECT",)),
    ("ISC", ("ISC-GRANT",)),
    ("Apache-2.0", ("APACHE-2-THE", "APACHE-COMPLY", "APACHE-COPY", "APACHE-WARRANTY", "APACHE-SEE")),
    ("Apache-2.0", ("APACHE-2-THE", "APACHE-COMPLY", "APACHE-COPY-AT", "APACHE-WARRANTY", "APACHE-SEE")),
    ("Apache-2.0", ("APACHE-2-THE", "APACHE-COMPLY")),
    ("Apache-2.0", ("APACHE-2-THE",)),
    ("Apache-2.0", ("APACHE-2",)),
    ("GPL-3.0-or-later", ("GPL-FREE", "GPL-2-LATER", "GPL-V3-LATER")),
    ("GPL-2.0-or-later", ("GPL-FREE", "GPL-2-LATER", "GPL-V2-LATER")),
    ("LGPL-2.1-or-later", ("LGPL-FREE", "LGPL-REDIST", "LGPL-V21-LATER")),
    ("AGPL-3.0-or-later", ("GPL-FREE", "AGPL-REDIST", "GPL-V3-LATER")),
    ("GPL-3.0", ("GPL-3-WORK",)),
    ("GPL-2.0", ("GPL-2-WORK",)),
    ("BSD-3-Clause", ("BSD-REDIST", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE")),
    ("BSD-2-Clause", ("BSD-REDIST", "BSD-SOURCE", "BSD-BINARY")),
    ("MPL-2.0", ("MPL-SUBJECT", "MPL-2-COPY")),
    ("MPL", ("MPL-SUBJECT",)),
    ("Unlicense", ("UNLICENSE",)),
    ("CC0-1.0", ("CC0",)),
    ("CC-BY-4.0", ("CC-BY-4",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-4",)),
    ("CC-BY-NC-SA-4.0", ("CC-BY-NC-SA-4",)),
    ("CC-BY-ND-4.0", ("CC-BY-ND-4",)),
    ("CC-BY-4.0", ("CC-BY-4-WORK",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-4-WORK",)),
    ("Proprietary", ("ALL-RIGHTS",)),
)

#: Where a sentence ends, and the sign that is put there.
SENTENCE_END, CUT = r"([.!?;:])[ \t\r\n\f]+", "\x01"
NOT_WORD = "[^a-z0-9]+"


def normal(sentence: str) -> str:
    """Normal form of a known sentence; the same rule as ``normalised`` for columns."""
    return re.sub(NOT_WORD, " ", sentence.lower()).strip()


#: Normal form -> identifier. No known sentence has an end of a sentence inside it.
KNOWN = {normal(text): name for name, text in SENTENCES.items()}
#: A candidate of more lines than the longest known sentence has words can't be known.
MAX_WORDS = max(len(text.split()) for text in KNOWN)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def sentence_ids(text: Column) -> Column:
    """The identifiers of known sentences of a text, in order: array<string>."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    name = lambda candidate: F.try_element_at(known, candidate)

    def of_sentence(sentence: Column) -> Column:
        lines = F.filter(F.transform(F.split(sentence, "\n"), normalised), lambda x: x != "")

        def at(line: Column, i: Column) -> Column:
            rest = F.size(lines) - i
            whole = F.array_join(F.slice(lines, i + 1, rest), " ")
            return F.coalesce(F.when((rest > 1) & (rest <= MAX_WORDS), name(whole)), name(line))

        one = F.array(name(normalised(sentence)))
        return F.when(F.contains(sentence, F.lit("\n")), F.transform(lines, at)).otherwise(one)

    cut = F.split(F.regexp_replace(text, SENTENCE_END, "$1" + CUT), CUT)
    return F.filter(F.flatten(F.transform(cut, of_sentence)), lambda x: x.isNotNull())


def apply_rules(ids: Column) -> Column:
    """struct(left string, found array<string>): the licences whose rules match, in rule order, and what no rule used."""
    rules = F.array(
        *[F.struct(F.lit(licence).alias("licence"), F.lit("".join(f"<{i}>" for i in sequence)).alias("sequence")) for licence, sequence in RULES]
    )
    start = F.struct(
        F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("left"), F.array().cast("array<string>").alias("found")
    )

    def step(acc: Column, rule: Column) -> Column:
        return F.when(
            F.contains(acc["left"], rule["sequence"]),
            F.struct(
                F.replace(acc["left"], rule["sequence"], F.lit("-")).alias("left"), F.array_append(acc["found"], rule["licence"]).alias("found")
            ),
        ).otherwise(acc)

    return F.aggregate(rules, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_known long, sentence_ids, licenses, unmatched string) for every row.

    ``licenses`` are the distinct licences, sorted and comma-joined; ``unmatched``
    are the identifiers that no rule used.
    """
    ids = docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col), F.lit(""))).alias("_ids"))
    empty = F.struct(F.lit("").alias("left"), F.array().cast("array<string>").alias("found"))
    ruled = ids.withColumn("_r", F.when(F.size("_ids") > 0, apply_rules(F.col("_ids"))).otherwise(empty))
    return ruled.select(
        id_col,
        F.size("_ids").cast("long").alias("n_known"),
        F.array_join("_ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct("_r.found")), ",").alias("licenses"),
        F.array_join(F.regexp_extract_all("_r.left", F.lit("<([^<>]+)>"), 1), ",").alias("unmatched"),
    )
