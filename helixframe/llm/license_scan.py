"""License scan by sentence rules.

A text is normalised to lower-case words between marks: sentence ends and empty lines are
hard marks, the ends of wrapped lines soft ones. Known licence sentences are looked for
up to any mark, from any mark and, if they are long, from any word; soft marks may stand
inside one, hard ones may not, so it makes no difference how a notice is wrapped, which
comment signs begin its lines or what stands before it on its line. The identifiers found,
in text order, are then matched against ordered rules, each a sequence of identifiers. A
rule that matches uses its sentences up, so rules that stand earlier, and are longer, win
over the parts they are made of. SPDX tags are read by their own small grammar. Everything
is string and array functions over one row at a time: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import text_of

# Sentences of public licence texts and notices, from sentence end to sentence end, as written there.
SENTENCES = {
    "mit-released": "Released under the MIT License",
    "mit-project": "This project is licensed under the terms of the MIT license",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-licensed": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-contributors": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "apache-asf": 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")',
    "apache-asf-lower": 'The ASF licenses this file to you under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-urls": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "program-free": "This program is free software",
    "library-free": "This library is free software",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "version-2": "either version 2 of the License, or (at your option) any later version",
    "version-2-1": "either version 2.1 of the License, or (at your option) any later version",
    "version-3": "either version 3 of the License, or (at your option) any later version",
    "program-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "library-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "no-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this library",
    "lgpl-received-program": "You should have received a copy of the GNU Lesser General Public License along with this program",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-copy-https": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "boost-short": "Distributed under the Boost Software License, Version 1.0",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "epl2-notice-http": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "epl2-heading": "Eclipse Public License - v 2.0",
    "epl-terms": 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT")',
    "cddl-subject": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',
    "cddl1-heading": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    "gpl2-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "cc0-extent": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-laws": 'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work")',
    "artistic-free": "This is free software, licensed under",
    "artistic2-name": "The Artistic License 2.0 (GPL Compatible)",
    "artistic2-terms": "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed",
    "rights": "All rights reserved",
}
# A licence's name and the sentences that it is told by, in matching order.
RULES = (
    ("MIT", "mit-grant mit-notice mit-as-is mit-liability"),
    ("MIT", "mit-grant mit-notice mit-as-is"),
    ("MIT-0", "mit-0-grant mit-as-is mit-liability"),
    ("MIT", "mit-notice mit-as-is mit-liability"),
    ("ISC", "isc-grant isc-as-is"),
    ("0BSD", "0bsd-grant isc-as-is"),
    ("Zlib", "zlib-as-is zlib-liability zlib-grant"),
    ("Unlicense", "unlicense-free unlicense-anyone"),
    ("EPL-2.0", "epl2-heading epl-terms"),
    ("Artistic-2.0", "artistic-free artistic2-name"),
    ("BSD-3-Clause", "rights bsd-grant bsd-source bsd-binary bsd-names bsd-as-is"),
    ("BSD-3-Clause", "rights bsd-grant bsd-source bsd-binary bsd-names-university bsd-as-is"),
    ("BSD-2-Clause", "rights bsd-grant bsd-source bsd-binary bsd-as-is"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names bsd-as-is"),
    ("BSD-3-Clause", "bsd-grant bsd-source bsd-binary bsd-names-university bsd-as-is"),
    ("BSD-2-Clause", "bsd-grant bsd-source bsd-binary bsd-as-is"),
    ("Apache-2.0", "apache-contributors apache-asf apache-comply apache-copy apache-url apache-unless apache-see"),
    ("Apache-2.0", "apache-licensed apache-comply apache-copy apache-url apache-unless apache-see"),
    ("Apache-2.0", "apache-licensed apache-comply apache-copy apache-urls apache-unless apache-see"),
    ("Apache-2.0", "apache-licensed apache-comply apache-copy-url apache-unless apache-see"),
    ("Apache-2.0", "apache-asf apache-comply"),
    ("Apache-2.0", "apache-licensed apache-comply"),
    ("Apache-2.0", "apache-short apache-comply"),
    ("CDDL", "cddl-subject apache-comply apache-see"),
    ("CDDL", "cddl-subject apache-comply"),
    ("Apache-2.0", "apache-comply apache-see"),
    ("GPL-3.0-or-later", "program-free gpl3-terms program-hope no-implied gpl-see gpl-received"),
    ("GPL-2.0-or-later", "program-free gpl-terms version-2 program-hope no-implied gpl-see gpl-received"),
    ("AGPL-3.0-or-later", "program-free agpl3-terms program-hope no-implied agpl-see agpl-received"),
    ("LGPL-3.0-or-later", "program-free lgpl3-terms program-hope no-implied lgpl-see lgpl-received-program"),
    ("LGPL-3.0-or-later", "library-free lgpl3-terms library-hope no-implied lgpl-see lgpl-received"),
    ("LGPL-2.1-or-later", "library-free lgpl-terms version-2-1 library-hope no-implied lgpl-see lgpl-received"),
    ("GPL-2.0-only", "program-free gpl2-only-terms"),
    ("GPL-3.0-or-later", "program-free gpl3-terms"),
    ("GPL-3.0-or-later", "program-free gpl-terms version-3"),
    ("GPL-2.0-or-later", "program-free gpl-terms version-2"),
    ("AGPL-3.0-or-later", "program-free agpl3-terms"),
    ("LGPL-3.0-or-later", "program-free lgpl3-terms"),
    ("LGPL-3.0-or-later", "library-free lgpl3-terms"),
    ("LGPL-3.0-or-later", "library-free lgpl-terms version-3"),
    ("LGPL-2.1-or-later", "library-free lgpl-terms version-2-1"),
    ("MPL-2.0", "mpl-subject mpl-copy"),
    ("MPL-2.0", "mpl-subject mpl-copy-https"),
    ("MIT", "mit-grant"),
    ("MIT", "mit-released"),
    ("MIT", "mit-project"),
    ("BSD", "bsd-grant bsd-source"),
    ("Apache-2.0", "apache-licensed"),
    ("Apache-2.0", "apache-short"),
    ("GPL-3.0", "gpl3-short"),
    ("CC-BY-NC-4.0", "cc-by-nc-short"),
    ("CC-BY-4.0", "cc-by-short"),
    ("CC-BY-SA-4.0", "cc-by-sa-short"),
    ("CC-BY-4.0", "cc-by"),
    ("CC-BY-SA-4.0", "cc-by-sa"),
    ("CC-BY-NC-4.0", "cc-by-nc"),
    ("MPL-2.0", "mpl-subject"),
    ("Zlib", "zlib-grant"),
    ("Unlicense", "unlicense-free"),
    ("BSL-1.0", "boost-grant"),
    ("BSL-1.0", "boost-short"),
    ("EPL-2.0", "epl2-notice"),
    ("EPL-2.0", "epl2-notice-http"),
    ("CDDL-1.0", "cddl1-heading"),
    ("CDDL", "cddl-subject"),
    ("CC0-1.0", "cc0-extent"),
    ("CC0-1.0", "cc0-laws"),
    ("Artistic-2.0", "artistic2-terms"),
)
#: What a text without any licence is told by, where its rights are reserved.
RESERVED = ("proprietary", "rights")
#: A sentence of so many words is told wherever it begins; a shorter one only after a mark.
LONG = 8

# Identifiers of the SPDX licence list that expressions are read for, and older names for some of them.
SPDX = (
    "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-1.0", "EPL-2.0",
    "CDDL-1.0", "CDDL-1.1", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Artistic-2.0",
)
FAMILIES = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")


def spdx_names() -> dict[str, str]:
    """Lower-case identifiers, as they may be written, to the list's; with a + they are of this version or a later one."""
    names = {name.lower() + plus: name for name in SPDX for plus in ("", "+")}
    for family in FAMILIES:
        names |= {family.lower(): f"{family}-only", f"{family.lower()}+": f"{family}-or-later", f"{family.lower()}-only+": f"{family}-or-later"}
    return names


IDENTIFIER = r"[a-z0-9][a-z0-9.-]*\+?"
#: An expression after its tag, in lower case: identifiers, in brackets or not, between operators. Each part is read once.
PLAIN_EXPRESSION = rf"spdx-license-identifier:[\x20\x09]*(\(*{IDENTIFIER}\)*(?:[\x20\x09]+(?:or|and|with)[\x20\x09]+\(*{IDENTIFIER}\)*)*)"
EXPRESSION = PLAIN_EXPRESSION[:-2] + "*+)"  # possessive, so that a long one needs no stack
EXCEPTION = rf"[\x20\x09]+with[\x20\x09]+{IDENTIFIER}"
#: Unknown sentences that may stand between two of a rule.
MAX_GAP = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends in punctuation before white space or the end, or with an empty line. A run of punctuation is tried
#: from its first character only, and each run once, so that the time is linear in the text.
ENDS = r"[.!?;:](?<![.!?;:]{2})[.!?;:]*+([\x20\x09-\x0D]|\z)|\n[^a-z0-9\n]*+\n"
#: Steps after lower-casing: hard marks, words, and marks that meet become one. A single space, the usual case, is left as it is.
STEPS = ((ENDS, "|"), (r"[^a-z0-9|\n\x20][^a-z0-9|\n]*|\x20[^a-z0-9|\n]+", " "), (r"[ \n]*\|[ |\n]*", "|"), (r" *\n[ \n]*", "\n"))
#: The first of these in patterns without lookbehind or possessive repeats, as SQL engines have them, which find the same.
PLAIN_ENDS = r"[.!?;:]+([\x20\x09-\x0D]|\z)|\n[^a-z0-9\n]*\n"


def marked(text: Column) -> Column:
    """The words of a text, with | at its ends and at sentence ends, and line feeds where lines end otherwise."""
    out = F.concat(F.lit("|"), F.translate(text, UPPER + "|", LOWER + " "), F.lit("|"))
    for pattern, mark in STEPS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def normalised(sentence: str) -> str:
    """The words of a known sentence."""
    return " ".join("".join(c if c in LOWER + "0123456789" else " " for c in sentence.translate(str.maketrans(UPPER, LOWER))).split())


def spans_of(names: dict[str, str]) -> str:
    """A pattern of a known sentence after the mark, or blank, before it; of those that begin there the longest."""

    def grouped(sentences: list[str]) -> str:
        by_word: dict[str, list[str]] = {}
        for sentence in sentences:  # longest first
            first, *rest = sentence.split(" ")
            by_word.setdefault(first, []).append("".join(rf"[ \n]{w}" for w in rest))
        return "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in by_word.items())

    long, short = ([s for s in names if (len(s.split()) >= LONG) == is_long] for is_long in (True, False))
    told = ([f"(?:{grouped(long)})"] if long else []) + ([rf"(?<=[|\n])(?:{grouped(short)})"] if short else [])
    return rf"[|\n ]({'|'.join(told)})(?=[|\n])"


def names_of(known: dict[str, str]) -> dict[str, str]:
    """An identifier for each normalised sentence, longest first; of equal sentences the first identifier."""
    names: dict[str, str] = {}
    for name, sentence in known.items():
        names.setdefault(normalised(sentence), name)
    return dict(sorted(names.items(), key=lambda x: -len(x[0])))


def spdx_expressions(text: Column) -> tuple[Column, Column]:
    """The SPDX expressions of a text as the list writes them, and the licences that they name, those not on the list left out."""
    names = spdx_names()
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(EXPRESSION), F.lit(1))
    found = F.when(text.rlike("(?i)spdx-license-identifier:"), found).otherwise(F.array().cast("array<string>"))

    def spelled(part: Column) -> Column:
        return F.when(part.isin("or", "and", "with"), F.upper(part)).otherwise(F.coalesce(F.try_element_at(known, part), part))

    def written(expression: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(expression, F.lit(rf"[()]|{IDENTIFIER}"), F.lit(0)), spelled)
        return F.replace(F.replace(F.array_join(parts, " "), F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))

    def told(expression: Column) -> Column:
        parts = F.regexp_extract_all(F.regexp_replace(expression, EXCEPTION, ""), F.lit(IDENTIFIER), F.lit(0))
        return F.filter(F.transform(parts, lambda p: F.try_element_at(known, p)), lambda name: name.isNotNull())

    return F.transform(found, written), F.flatten(F.transform(found, told))


def names_told(rules=RULES, reserved=RESERVED) -> list[str]:
    """Every licence that a scan can tell, in the order of its output."""
    return list(dict.fromkeys([*(name for name, _ in rules), *SPDX, reserved[0]]))


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=SENTENCES, rules=RULES, reserved=RESERVED, max_gap: int = MAX_GAP
) -> DataFrame:
    """One row per row of docs: (id, n_sentences, n_known, sentence_ids, licenses, unmatched, spdx).

    sentence_ids: the identifiers in known of the sentences found, comma-joined in text
    order; of sentences that begin at one place the longest. licenses: name:count of each
    licence that rules or SPDX expressions told, comma-joined in the order of rules, then of
    the SPDX list; where they told none, the reserved one if its sentence is there.
    unmatched: identifiers that no rule used. spdx: the expressions, joined by semicolons,
    with identifiers as the list spells them and unknown ones as they stand. Sentences of a
    rule follow one another with at most max_gap unknown ones between. A null or empty text
    has no sentences, and empty strings in the last four columns. Repeated rows are scanned
    each for itself; an empty table gives no rows; other columns are not read.
    """
    names = names_of(known)
    places = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    written, listed = spdx_expressions(text_of(text_col))
    rows = docs.select(F.col(id_col), marked(text_of(text_col)).alias("marked"), F.array_join(written, "; ").alias("spdx"), listed.alias("listed"))
    #  a known sentence with the mark or blank before it, or a hard mark before an unknown one
    found = F.regexp_extract_all("marked", F.lit(rf"{spans_of(names)}|\|"), F.lit(1))
    rows = rows.select(
        id_col,
        "spdx",
        "listed",
        (F.length("marked") - F.length(F.replace("marked", F.lit("|"))) - 1).cast("long").alias("n_sentences"),
        F.transform(found, lambda s: F.when(s != "", F.try_element_at(places, F.replace(s, F.lit("\n"), F.lit(" "))))).alias("ids"),
    )
    #  unknown sentences are dots; a longer gap breaks the sequence
    marks = F.array_join(F.transform("ids", lambda i: F.coalesce(F.concat(F.lit("<"), i, F.lit(">")), F.lit("."))), "")
    rows = rows.withColumn("marks", F.regexp_replace(F.regexp_replace(marks, r"\.{%d,}" % (max_gap + 1), "|"), r"\.", ""))
    rows = rows.withColumn("known", F.filter("ids", lambda i: i.isNotNull())).drop("ids")
    #  rules in order over what the ones before left, each use of one a | in its place
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in rule.split())).alias("mark")) for name, rule in rules])

    def after(state: Column, rule: Column) -> Column:
        left, mark = state.getField("left"), rule.getField("mark")
        following = F.replace(left, mark, F.lit("|"))
        uses = ((F.length(left) - F.length(following)) / (F.length(mark) - 1)).cast("int")
        return F.struct(following.alias("left"), F.concat(state.getField("told"), F.array_repeat(rule.getField("name"), uses)).alias("told"))

    none = F.struct(F.col("marks").alias("left"), F.array().cast("array<string>").alias("told"))
    rows = rows.withColumn("state", F.when(F.col("marks").contains("<"), F.aggregate(steps, none, after)).otherwise(none)).drop("marks")
    #  what rules and expressions told, or else the reserved licence
    mark = F.lit(f"<{reserved[1]}>")
    alone = (F.size("state.told") == 0) & (F.size("listed") == 0) & F.contains("state.left", mark)
    count = ((F.length("state.left") - F.length(F.replace("state.left", mark))) / F.length(mark)).cast("int")
    left = F.when(alone, F.replace("state.left", mark, F.lit("|"))).otherwise(F.col("state.left"))
    told = F.when(alone, F.array_repeat(F.lit(reserved[0]), count)).otherwise(F.concat("state.told", "listed"))
    rows = rows.withColumn("state", F.struct(left.alias("left"), told.alias("told")))
    left, every = F.col("state.left"), F.array(*[F.lit(x) for x in names_told(rules, reserved)])
    number = lambda name: F.size(F.filter("state.told", lambda x: x == name)).cast("string")
    told = F.transform(F.filter(every, lambda name: F.array_contains("state.told", name)), lambda name: F.concat_ws(":", name, number(name)))
    told = F.when(F.size("state.told") > 0, F.array_join(told, ",")).otherwise("")
    rest = F.regexp_extract_all(left, F.lit("<([^>]+)>"), F.lit(1))
    return rows.select(
        id_col,
        "n_sentences",
        F.size("known").cast("long").alias("n_known"),
        F.array_join("known", ",").alias("sentence_ids"),
        told.alias("licenses"),
        F.array_join(rest, ",").alias("unmatched"),
        "spdx",
    )
