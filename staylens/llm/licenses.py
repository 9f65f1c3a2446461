"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised (lower case, runs of other
characters than a-z and 0-9 become one space) and mapped to the identifier of a
known licence sentence or to ``-``. The identifier sequence of a text is then
matched against rules: sentences of a licence in their order, with at most
``GAP`` other sentences between two of them. A text is cut in two ways, with a
line end as a space and as the end of a sentence; a rule may hold in either.

Known are the full grants and headers of ``SENTENCES``, one-line notices (a verb and a
name of ``NAMES``: "Licensed under the", "is released under the", ...) and SPDX lines.
The subject of a notice and the holder in "Neither the name of <holder> nor the
names of ..." are free words: they end a sentence (``ENDS``), so what is compared
begins after them. Single identifiers and the pairs ``SPDX_PAIRS`` are known in SPDX lines.

Both tables are parameters of fixed size and become literals; everything is
built-in column functions on one row at a time, without a shuffle.

Edge cases: null and empty texts have no sentences; texts without a cue word
(``cues``: one word of every known sentence) can't hold a known sentence and
aren't cut; rows that repeat are scanned alike; empty tables give empty
results; extra columns stay untouched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

GAP = 2
#: Identifier -> sentence of a public licence text or notice.
SENTENCES = {
    "reserved": "All rights reserved",
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-notice": "licensed under the GNU General Public License, version 3",
    "gpl3-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: Licence -> sentence identifiers in their order; a licence may have several rules.
RULES = [
    ("Apache-2.0", ["apache-notice"]), ("Apache-2.0", ["apache-header", "apache-comply"]), ("Apache-2.0", ["apache-obtain", "apache-see"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-name"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]), ("GPL-3.0", ["gpl3-notice"]), ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"]),
    ("MIT", ["mit-notice"]), ("MIT", ["mit-notice-2"]), ("MIT", ["mit-grant", "mit-keep"]), ("reserved", ["reserved"]),
]
#: Where sentences end; the second way also ends them at line ends. The subject of a notice
#: or grant, and the holder in the BSD condition on names, end a sentence too.
_FREE = r"(?i:\b(?:this|the)[ \t\r\n]+(?:work|file|program|software|project|library|code|package)[ \t\r\n]+is[ \t\r\n]+)|(?i:neither[ \t\r\n]+the[ \t\r\n]+names?[ \t\r\n][^.;:]{0,200}?[ \t\r\n]nor[ \t\r\n]+)"
ENDS = (rf"[.!?;:]+[ \t\r\n\f]+|{_FREE}", rf"[.!?;:]+[ \t\r\n\f]+|{_FREE}|[\r\n]+")
UNKNOWN = "-"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def cues(sentences: dict[str, str]) -> list[str]:
    """Words of which every known sentence has one: greedily those of most sentences, longest first."""
    left, out = [set(normalised(s).split()) for s in sentences.values()], []
    while left:
        words = {w for s in left for w in s}
        out.append(max(words, key=lambda w: (sum(w in s for s in left) * len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def rule_pattern(identifiers: list[str]) -> str:
    """A rule as a pattern over identifier sequences; ``x`` also stands for its wordings ``x~1``, ``x~2``, ..."""
    between = rf"(?:[^;]*;){{0,{GAP}}}"
    return "(?:^|;)" + between.join(re.escape(i).replace(r"\-", "-") + "(?:~[0-9]+)?;" for i in identifiers)


def _versions(long: str, short: str, *versions: str) -> list[str]:
    every = [f"{long}{sep}{v}" for v in versions for sep in (" version ", " v", " ")]
    return every + [f"{gnu}{short}{sep}{v}" for gnu in (("", "GNU ") if long.startswith("GNU") else ("",)) for v in versions for sep in (" version ", " v", "v", " ")]


#: Licence -> names in notices and headers.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License v2.0", "Apache 2.0"],
    "MIT": ["MIT License", "MIT", "Expat License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "GPL-2.0": _versions("GNU General Public License", "GPL", "2", "2.0"),
    "GPL-3.0": _versions("GNU General Public License", "GPL", "3", "3.0"),
    "LGPL-2.1": _versions("GNU Lesser General Public License", "LGPL", "2.1"),
    "LGPL-3.0": _versions("GNU Lesser General Public License", "LGPL", "3", "3.0"),
    "AGPL-3.0": _versions("GNU Affero General Public License", "AGPL", "3", "3.0"),
    "MPL-2.0": _versions("Mozilla Public License", "MPL", "2.0"),
    "EPL-1.0": _versions("Eclipse Public License", "EPL", "1.0"), "EPL-2.0": _versions("Eclipse Public License", "EPL", "2.0"),
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "ISC": ["ISC License"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
} | {f"CC-{code}-{v}": [f"CC {code} {v}", *(f"Creative Commons {words} {v}{end}" for end in ("", " License", " International License", " Unported License"))]
     for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                         ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")}
VERBS = ("licensed under", "released under", "distributed under", "available under")
#: Sentences of grants and headers beside the first ones.
PARTS = {
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant~1": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "zlib-origin": "The origin of this software must not be misrepresented",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl2-copy~1": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl-2.0-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-1.0-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "bsd-name~1": "the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-name~2": "the names of the contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "spdx": "SPDX-License-Identifier",
}
#: Identifiers known in SPDX lines beside those of ``NAMES`` and their "-only" and "-or-later" forms; pairs joined by OR.
SPDX = ["0BSD", "Artistic-2.0", "LGPL-2.0"]
SPDX_PAIRS = [("Apache-2.0", "MIT"), ("GPL-2.0", "MIT"), ("GPL-2.0", "BSD-3-Clause"), ("Apache-2.0", "BSD-3-Clause")]


def _extend() -> None:
    """Adds the tables above to ``SENTENCES`` and ``RULES``."""
    taken = {normalised(s) for s in SENTENCES.values()}

    def add(identifier: str, wordings: list[str]) -> str:
        """Wordings that aren't known yet, as ``identifier~1``, ``identifier~2``, ..."""
        for n, w in enumerate(wordings, 1):
            if normalised(w) not in taken:
                taken.add(normalised(w))
                SENTENCES[f"{identifier}~{n}"] = w
        return identifier

    SENTENCES.update(PARTS)
    taken.update(map(normalised, PARTS.values()))
    for name, identifiers in (("ISC", ["isc-grant"]), ("0BSD", ["0bsd-grant"]), ("Zlib", ["zlib-grant", "zlib-origin"]), ("Unlicense", ["unlicense-free"]),
                              ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]), ("EPL-2.0", ["epl-2.0-terms"]), ("EPL-1.0", ["epl-1.0-terms"]), ("BSL-1.0", ["bsl-grant"])):
        RULES.append((name, identifiers))
    for name, names in NAMES.items():
        RULES.append((name, [add("notice-" + name.lower(), [f"{verb} {the}{n}" for verb in VERBS for n in names for the in ("the ", "")])]))
    for kind, short, versions in (("General", "GPL", ("2", "3")), ("Lesser General", "LGPL", ("2.1", "3")), ("Affero General", "AGPL", ("3",))):
        grant = f"redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation"
        cut = add(f"{short.lower()}-grant", [f"you can {grant}", f"you may {grant}"])
        for v in versions:
            name = f"{short}-{v if '.' in v else v + '.0'}"
            later, only = f"either version {v} of the License, or (at your option) any later version", f"version {v} of the License"
            one = add(f"{name.lower()}-later", [f"you {c} {grant}, {later}" for c in ("can", "may")])
            for first in ([one], [cut, add(f"gnu-{v}-later", [later])]):
                RULES.append((name + "-or-later", [*first, "gpl-hope"]))
            for first in ([add(f"{name.lower()}-only", [f"you {c} {grant}, {only}" for c in ("can", "may")])], [cut, add(f"gnu-{v}-only", [only])]):
                RULES.append((name, [*first, "gpl-hope"]))
    forms: dict[str, list[str]] = {}
    for name in [*NAMES, *SPDX]:
        gnu = re.match("[AL]?GPL", name)
        forms[name] = [name, name + "-only"] if gnu else [name]
        if gnu:
            forms[name + "-or-later"] = [name + "-or-later"]
    for name, own in forms.items():
        RULES.append((name, ["spdx", add("spdx-" + name.lower(), own)]))
    for a, b in SPDX_PAIRS:
        pair = add(f"spdx-{a.lower()}-{b.lower()}", [f"{x} OR {y}" for m, n in ((a, b), (b, a)) for x in forms[m] for y in forms[n]])
        RULES.extend([(a, ["spdx", pair]), (b, ["spdx", pair])])


_extend()


def identifiers(text: Column, ends: str, sentences: dict[str, str]) -> Column:
    """The identifier sequence of a text, each identifier followed by a semicolon."""
    known = F.create_map(*[x for i, s in sentences.items() for x in (F.lit(normalised(s)), F.lit(i))])
    clean = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    found = F.transform(F.filter(F.transform(F.split(text, ends), clean), lambda s: s != ""),
                        lambda s: F.coalesce(F.element_at(known, s), F.lit(UNKNOWN)))
    return F.concat(F.array_join(found, ";"), F.lit(";"))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """``docs`` with license_sentences (known identifiers of the second cut, in
    order) and licenses (sorted, distinct)."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    cue = "(?i)" + "|".join(map(re.escape, cues(sentences)))
    held = docs.withColumn("__license_text", F.when(F.col("text").rlike(cue), F.col("text")))
    held = held.withColumn("__license_a", identifiers(F.col("__license_text"), ENDS[0], sentences)).withColumn("__license_b", identifiers(F.col("__license_text"), ENDS[1], sentences))
    none = F.array().cast("array<string>")
    patterns: dict[str, list[str]] = {}
    for name, own in rules:
        patterns.setdefault(name, []).append(rule_pattern(own))
    hits = F.array(*[F.when(F.col("__license_a").rlike(p) | F.col("__license_b").rlike(p), F.lit(name)) for name, p in ((n, "|".join(x)) for n, x in patterns.items())])
    known = F.filter(F.split("__license_b", ";"), lambda i: (i != UNKNOWN) & (i != ""))
    return held.withColumn("license_sentences", F.coalesce(known, none)).withColumn(
        "licenses", F.array_sort(F.array_distinct(F.array_compact(hits)))).drop("__license_text", "__license_a", "__license_b")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"),
                      F.array_join("license_sentences", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(normalised(s))}: {quote(i)}" for i, s in SENTENCES.items()) + "}"
    def cut(ends):
        return (f"list_transform(list_filter(list_transform(regexp_split_to_array(text, {quote(ends)}), "
                f"lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda s: s <> ''), lambda s: coalesce(known[s], '{UNKNOWN}'))")
    hits = ", ".join(f"CASE WHEN regexp_matches(a, {quote(p)}) OR regexp_matches(b, {quote(p)}) THEN {quote(n)} END" for n, p in ((n, rule_pattern(i)) for n, i in RULES))
    return f"""
WITH k AS (SELECT {known} AS known),
d AS (SELECT doc_id, {cut(ENDS[0])} AS ia, {cut(ENDS[1])} AS ib FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), k),
s AS (SELECT doc_id, ib, array_to_string(ia, ';') || ';' AS a, array_to_string(ib, ';') || ';' AS b FROM d),
r AS (SELECT doc_id, list_filter(ib, lambda i: i <> '{UNKNOWN}') AS ids,
  list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))) AS licenses FROM s)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(licenses, ','), '') AS licenses FROM r"""


QUERIES = {"op8_licenses": op8_licenses}
ORACLE = {"op8_licenses": _oracle()}
