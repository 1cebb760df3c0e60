"""Licence recognition by sentence rules, in DataFrame functions alone.

A text is cut into pieces at line ends and at white space after ".", "!", "?" or
":".  A piece is normalised (lower case, every run of other characters than a-z
and 0-9 one space, ends trimmed).  A sentence is a run of pieces, so it may be
wrapped over lines, with comment marks before them, or have "v. 2.0" in it; no
run goes over a line without a-z or 0-9.  Runs that are known licence sentences
are mapped to their identifiers: from left to right, of those that start at one
piece the longest, and none that overlaps the one before.  The identifiers of a
document, in order and without unknown sentences, are matched against licence
rules: a rule is a sequence of identifiers that must occur side by side.

Runs are tried only from pieces that begin a known sentence and up to as many
pieces as a known sentence has words, in texts with a word of ANCHORS; every
known sentence has one, which is checked when rules are compiled, so nothing is
lost.

Null and empty texts, and texts without a known sentence, have no licence.  A
licence that matches more than once is named once; a repeated row gives a row
each time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import read, texts

# Words of which every known sentence holds one.
ANCHORS = ["licen", "copyright", "permission", "warrant", "software", "liab", "redistribut", "creative commons", "public domain", "spdx"]

# Known licence sentences by name.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-notice-3": "This project is licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-notice": "Licensed under the ISC License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-notice": "Licensed under the GNU General Public License, version 3.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-notice": "Licensed under the GNU General Public License, version 2.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-notice": "Licensed under the BSD License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ccby-notice": "Licensed under CC BY 4.0.",
    "ccby-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa-notice": "Licensed under CC BY-SA 4.0.",
    "ccbysa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync-notice": "Licensed under CC BY-NC 4.0.",
    "ccbync-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "ccbynd-notice": "Licensed under CC BY-ND 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "mpl11-notice": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

# Licence, and the sentences that state it side by side.
RULES = [
    ("MIT", ["mit-notice"]), ("MIT", ["mit-notice-2"]), ("MIT", ["mit-notice-3"]), ("MIT", ["mit-spdx"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is", "no-liability"]),
    ("ISC", ["isc-notice"]), ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-notice"]), ("Apache-2.0", ["apache-spdx"]), ("Apache-2.0", ["apache-header", "apache-copy", "apache-as-is", "apache-see"]),
    ("GPL-3.0", ["gpl3-work"]), ("GPL-3.0", ["gpl3-notice"]), ("GPL-3.0", ["gpl3-free", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0", ["gpl2-notice"]), ("GPL-2.0", ["gpl2-free", "gpl-warranty", "gpl-details"]),
    ("BSD", ["bsd-notice"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-4.0", ["ccby-notice"]), ("CC-BY-4.0", ["ccby-long"]), ("CC-BY-SA-4.0", ["ccbysa-notice"]), ("CC-BY-SA-4.0", ["ccbysa-long"]),
    ("CC-BY-NC-4.0", ["ccbync-notice"]), ("CC-BY-NC-4.0", ["ccbync-long"]), ("CC-BY-ND-4.0", ["ccbynd-notice"]),
    ("Unlicense", ["unlicense"]), ("MPL-2.0", ["mpl-notice"]), ("MPL-1.1", ["mpl11-notice"]),
    ("LGPL-2.1", ["lgpl21-free", "lgpl-warranty", "lgpl-details"]), ("AGPL-3.0", ["agpl3-free", "gpl-warranty", "agpl-details"]),
]

#: A compiled dictionary is a literal of the plan; more sentences than this are refused.
MOST_SENTENCES = 10_000

_BREAK = r"([.!?])[ \t\x0B\f\r]+"
_PIECE = r"(?<=[.!?])[ \t\x0B\f\r]+\n?|(?<=:)[ \t\x0B\f\r]+\n?|\n"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def pieces(text: str) -> list[str]:
    """The normalised sentences of a known text, cut as documents are."""
    return [s for x in re.sub(_BREAK, r"\1\n", text).split("\n") if (s := normalised(x))]


def compiled(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Identifiers of normalised sentences, and rules as (licence, sequence).

    A known text that is itself cut into several sentences gets as many
    identifiers."""
    ids: dict[str, int] = {}
    of = {name: [ids.setdefault(p, len(ids) + 1) for p in pieces(text)] for name, text in sentences.items()}
    anchored = {p for p in ids if any(normalised(a) in p for a in ANCHORS)}
    # A part without an anchor can't be looked for; its neighbours stand for it.
    of = {name: [k for k in own if list(ids)[k - 1] in anchored] for name, own in of.items()}
    if len(ids) > MOST_SENTENCES:
        raise ValueError(f"more than {MOST_SENTENCES} sentences")
    if empty := [name for name, own in of.items() if not own]:
        raise ValueError(f"no anchor word in {empty}")
    return {p: k for p, k in ids.items() if p in anchored}, [(licence, "," + "".join(f"{k}," for name in names for k in of[name])) for licence, names in rules]


def looked_up(sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """compiled(), but with one identifier for each known text as a whole."""
    compiled(sentences, rules)
    ids: dict[str, int] = {}
    of = {name: ids.setdefault(normalised(text), len(ids) + 1) for name, text in sentences.items()}
    return ids, [(licence, "," + "".join(f"{of[name]}," for name in names)) for licence, names in rules]


def cut(text: Column) -> Column:
    """The normalised pieces of a text that has an anchor, else none."""
    anchors = "(?i)" + "|".join(re.escape(a).replace(r"\ ", "[^a-z0-9]+") for a in ANCHORS)
    plain = F.transform(F.split(text, _PIECE), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    return F.when(text.rlike(anchors), plain).otherwise(F.array().cast("array<string>"))


def known_sentences(pieces: Column, ids: dict[str, int]) -> Column:
    """Identifiers of the known sentences among pieces, in order."""
    table = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    words = [s.split(" ") for s in ids]
    begins = sorted({" ".join(w[:k]) for w in words for k in range(1, len(w) + 1)})
    most, none = max(map(len, words)), F.array().cast("array<int>")
    starts = F.filter(F.transform(pieces, lambda s, i: F.when(s.isin(begins), i + 1)), lambda i: i.isNotNull())

    def longest(i: Column) -> Column:
        """at, past, id of the longest known run from piece i, or null."""
        sizes = F.sequence(F.lit(1), F.least(F.lit(most), F.size(pieces) - i + 1))
        runs = F.transform(sizes, lambda n: F.struct(i.alias("at"), (i + n).alias("past"), F.try_element_at(table, F.array_join(F.slice(pieces, i, n), " ")).alias("id")))
        return F.try_element_at(F.filter(runs, lambda r: r["id"].isNotNull()), F.lit(-1))

    hits = F.filter(F.transform(starts, longest), lambda r: r.isNotNull())
    first = F.struct(F.lit(0).alias("past"), none.alias("ids"))
    after = lambda a, r: F.when(r["at"] < a["past"], a).otherwise(F.struct(r["past"].alias("past"), F.concat(a["ids"], F.array(r["id"])).alias("ids")))
    return F.aggregate(hits, first, after, lambda a: a["ids"])


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_sentences (known ones), licenses (sorted, comma-separated, else empty)."""
    ids, sequences = looked_up(sentences or SENTENCES, rules or RULES)
    found = texts(docs).select("doc_id", cut(F.col("text")).alias("pieces")).select("doc_id", known_sentences(F.col("pieces"), ids).alias("known"))
    line = F.concat(F.lit(","), F.array_join(F.col("known").cast("array<string>"), ","), F.lit(","))
    hits = F.array(*(F.when(F.contains(F.col("line"), F.lit(s)), F.lit(licence)) for licence, s in sequences))
    named = F.when(F.size("known") > 0, F.array_join(F.array_sort(F.array_distinct(F.array_compact(hits))), ",")).otherwise("")
    return found.withColumn("line", line).select("doc_id", F.size("known").cast("long").alias("n_sentences"), named.alias("licenses"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    """SQL by places in the joined text, from the known texts as they are written."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in SENTENCES.items())
    rules = ", ".join(f"({quote(licence)}, {quote(',' + ','.join(names) + ',')})" for licence, names in RULES)
    return f"""
WITH RECURSIVE known AS (
  SELECT name, trim(regexp_replace(lower(given), '[^a-z0-9]+', ' ', 'g')) AS sentence FROM (VALUES {known}) AS t(name, given)),
rules(licence, seq) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?:])[ \\t\\x0B\\f\\r]+\\n?', '\\1' || chr(10), 'g'), chr(10)) AS parts
  FROM documents),
plain AS (
  SELECT doc_id, i, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS part
  FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part FROM cut)),
marked AS (SELECT doc_id, i, CASE WHEN part = '' THEN '|' ELSE part END AS part FROM plain),
placed AS (
  SELECT doc_id, i, part, sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS first FROM marked),
whole AS (SELECT doc_id, string_agg(part, ' ' ORDER BY i) AS line FROM marked GROUP BY doc_id),
begun AS (
  SELECT e.doc_id, e.i, e.first, name, sentence FROM placed e JOIN known ON starts_with(sentence || ' ', e.part || ' ')),
met AS (
  SELECT b.doc_id, b.i, b.first + length(sentence) AS past, name, length(sentence) AS size
  FROM begun b JOIN whole w ON b.doc_id = w.doc_id WHERE substr(w.line, CAST(b.first AS BIGINT), length(sentence)) = sentence),
longest AS (
  SELECT m.doc_id, m.i, e.i AS last, m.name FROM met m JOIN placed e ON m.doc_id = e.doc_id AND m.past = e.first + length(e.part)
  QUALIFY row_number() OVER (PARTITION BY m.doc_id, m.i ORDER BY m.size DESC) = 1),
taken AS (
  SELECT doc_id, i, last, name, 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM longest) WHERE r = 1
  UNION ALL
  SELECT doc_id, i, last, name, n + 1 FROM (
    SELECT l.doc_id, l.i, l.last, l.name, t.n, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.i) AS r
    FROM taken t JOIN longest l ON l.doc_id = t.doc_id AND l.i > t.last) WHERE r = 1),
line AS (
  SELECT doc_id, count(*) AS n, ',' || string_agg(name, ',' ORDER BY n) || ',' AS names FROM taken GROUP BY doc_id),
named AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses
  FROM line JOIN rules ON contains(names, seq) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(line.n, 0) AS BIGINT) AS n_sentences, coalesce(named.licenses, '') AS licenses
FROM documents d LEFT JOIN line ON d.doc_id = line.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""


ORACLE = _oracle()
