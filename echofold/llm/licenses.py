"""License scans by sentence rules: sentences are normalised and mapped to known license-sentence identifiers, and the
sequence of identifiers is matched against ordered rules.

A boundary is a text's start or end, a line break, or a full stop, colon, semicolon, question or exclamation mark before
white space. A known sentence is found where its words lie between two boundaries, so it may be wrapped over lines. At
each place the longest known sentence is taken. A rule lists identifiers; it holds where they follow each other in order
with at most GAP other known sentences between two of them. Rules are tried in the order given, longest first, and use
up the identifiers they match.

Defined results: null and empty text hold no license; a document with several has each once, in order of name; a sentence
that no rule uses gives no license; repeated rows repeat their result; an empty table gives an empty table; other
columns are not read. Sentences are looked for in whole texts; a text without any of the ANCHORS, one of which
each known sentence has, is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echofold.llm.batches import lean, slices

GAP = 3
SLICE_BYTES = 4 << 20
#: Sentences of public licenses and of the notices that name them, by identifier.
SENTENCES = {
    "apache-named": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "mit-named": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License", "The MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "bsd-named": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2-named": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-named": ["Licensed under the ISC License", "ISC License", "SPDX-License-Identifier: ISC"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "gpl3-named": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GPLv3 License", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl2-named": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-received": ["You should have received a copy of the GNU General Public License along with this program"],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl3-later": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "lgpl3-later": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "agpl3-named": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "epl2-terms": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0", "SPDX-License-Identifier: EPL-2.0"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib-named": ["SPDX-License-Identifier: Zlib"],
    "cc0-waiver": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "SPDX-License-Identifier: CC0-1.0"],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "SPDX-License-Identifier: WTFPL"],
    "boost-named": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"],
    "mpl-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "cc-by-named": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-named": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-named": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: Licenses, each with the identifier sequences that state it.
RULES = [
    ("MIT", ["mit-named", "mit-grant", "mit-notice", "as-is"]), ("MIT", ["mit-grant", "mit-notice", "as-is"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-named", "apache-comply", "apache-copy", "apache-basis"]), ("Apache-2.0", ["apache-named", "apache-comply"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]), ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-received"]), ("GPL-3.0-or-later", ["gpl-free"]),
    ("MIT", ["mit-named"]), ("Apache-2.0", ["apache-named"]), ("BSD-3-Clause", ["bsd-named"]), ("BSD-2-Clause", ["bsd2-named"]), ("ISC", ["isc-named"]), ("ISC", ["isc-grant"]),
    ("GPL-2.0-or-later", ["gpl2-later"]), ("GPL-3.0-or-later", ["gpl3-later"]), ("LGPL-2.1-or-later", ["lgpl21-later"]), ("LGPL-3.0-or-later", ["lgpl3-later"]), ("AGPL-3.0-or-later", ["agpl3-later"]), ("AGPL-3.0-only", ["agpl3-named"]),
    ("EPL-2.0", ["epl2-terms"]), ("Zlib", ["zlib-as-is", "zlib-grant"]), ("Zlib", ["zlib-grant"]), ("Zlib", ["zlib-named"]), ("CC0-1.0", ["cc0-waiver"]), ("WTFPL", ["wtfpl"]), ("BSL-1.0", ["boost-named"]),
    ("GPL-3.0-only", ["gpl3-named"]), ("GPL-2.0-only", ["gpl2-named"]), ("MPL-2.0", ["mpl-terms"]), ("Unlicense", ["unlicense"]),
    ("CC-BY-4.0", ["cc-by-named"]), ("CC-BY-SA-4.0", ["cc-by-sa-named"]), ("CC-BY-NC-4.0", ["cc-by-nc-named"]),
]
#: Each known sentence holds one of these, lower-cased.
ANCHORS = ["licen", "gpl", "permission", "warrant", "redistribut", "copyright", "unencumbered"]
_BREAK = re.compile(r"\n|[.:;?!](?=\s|$)")
_WORD = re.compile(r"[a-z0-9]+")
_ANY = re.compile("|".join(map(re.escape, ANCHORS)))


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


KNOWN = {normalised(s): k for k, own in SENTENCES.items() for s in own}
LONGEST = max(len(s.split()) for s in KNOWN)
FIRST_WORDS = {s.split()[0] for s in KNOWN}


def sentence_ids(text: str) -> list[str]:
    """Identifiers of the known sentences of a text, in order; of several at a place the longest."""
    low = text.lower()
    if not _ANY.search(low):
        return []
    words, opens, closes = [], set(), set()
    at = 0
    for cut in [*_BREAK.finditer(low), None]:
        opens.add(len(words))
        words += _WORD.findall(low, at, cut.start() if cut else len(low))
        closes.add(len(words))
        at = cut.end() if cut else at
    found, k = [], 0
    while k < len(words):
        step = 1
        if k in opens and words[k] in FIRST_WORDS:
            for n in range(min(LONGEST, len(words) - k), 0, -1):
                if k + n in closes and (known := KNOWN.get(" ".join(words[k : k + n]))):
                    found.append(known)
                    step = n
                    break
        k += step
    return found


def licenses_of(ids: list[str], gap: int = GAP) -> list[str]:
    """Names of the licenses whose rules the identifiers meet, sorted.

    Identifiers stand in a list that used ones are unlinked from, so each is met once for each rule, however many
    there are.
    """
    n = len(ids)
    after = list(range(1, n + 2))  # the next unused place after each; place 0 is before the first, n + 1 behind the last
    names = set()
    for name, rule in sorted(RULES, key=lambda r: -len(r[1])):
        if not set(rule) <= set(ids):
            continue
        before, k = 0, after[0]
        while k <= n:
            if ids[k - 1] != rule[0]:
                before, k = k, after[k]
                continue
            places, last, at = [(before, k)], k, after[k]
            for want in rule[1:]:
                for _ in range(gap + 1):
                    if at > n or ids[at - 1] == want:
                        break
                    last, at = at, after[at]
                else:
                    at = n + 1
                if at > n:
                    break
                places.append((last, at))
                last, at = at, after[at]
            if len(places) < len(rule):
                before, k = k, after[k]
                continue
            names.add(name)
            for left, own in reversed(places):
                after[left] = after[own]
            k = after[before]
    return sorted(names)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, sentences array<string> (identifiers in order), licenses array<string> (sorted names)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t", SLICE_BYTES):
            ids = [sentence_ids(x or "") for x in part.column(1).to_pylist()]
            names = [licenses_of(x) if x else [] for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.string())), pa.array(names, pa.list_(pa.string()))], ["key", "sentences", "licenses"])

    found = docs.select(docs[key].alias("key"), docs[text].alias("t")).mapInArrow(lean(run), f"key {kind}, sentences array<string>, licenses array<string>")
    return found.withColumnRenamed("key", key)


#: The license lines that the synthetic tables hold are one sentence each, so SQL can look for them between boundaries.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, ' | ' || trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '\n|[.:;?!](\s|$)', ' | ', 'g'), '[^a-z0-9|]+', ' ', 'g')) || ' | ' AS t FROM documents),
n AS (SELECT doc_id, regexp_replace(t, '( \|)+ ', ' | ', 'g') AS t FROM d)
SELECT doc_id, array_to_string(list_sort(list_filter([
  CASE WHEN contains(t, '| licensed under the apache license version 2 0 |') THEN 'Apache-2.0' END,
  CASE WHEN contains(t, '| released under the mit license |') THEN 'MIT' END,
  CASE WHEN contains(t, '| licensed under cc by nc 4 0 |') THEN 'CC-BY-NC-4.0' END,
  CASE WHEN contains(t, '| this work is licensed under the gnu general public license version 3 |') THEN 'GPL-3.0-only' END], lambda x: x IS NOT NULL)), ',') AS licenses
FROM n
"""


def names_of(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, F.array_join("licenses", ",").alias("licenses"))
