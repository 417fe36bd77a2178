"""Licence recognition by sentence rules (operator 6).

A text is cut into sentences, a sentence is normalised and looked up among known licence sentences, and the sequence of
identifiers is matched against ordered rules. A rule is a sequence of sentence identifiers that have to follow one
another, with at most a few unknown sentences between; longer rules come first, and a sentence serves one match.

Known sentences are held as a tree of words. A sentence may begin behind a stop or colon or on a new line and end at a
stop, colon or line's end, so notices in comments, lists and headings are found; a look-up walks the tree from such a
beginning and ends with the first word that leads nowhere, so a scan takes time in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
TEXTS = {
    "apache2-title": "Apache License Version 2.0, January 2004",
    "apache2-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache2-copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "apache2-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-dedicated": "This work is dedicated to the public domain under CC0 1.0.",
    "wtfpl-do": "You just DO WHAT THE FUCK YOU WANT TO.",
}
# The notice of the GNU licences, what it may be about, and licence names with their versions.
GNU_NOTICE = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
GNU_ONLY = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} version {2} as published by the Free Software Foundation."
GNU_HOPE = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
GNU_THINGS = ("program", "library", "software", "file")
GNU = {"GPL": ("General Public License", ("2", "3")), "LGPL": ("Lesser General Public License", ("2.1", "3")), "AGPL": ("Affero General Public License", ("3",))}
# Names under which short notices state a licence, and the forms of these notices.
NAMES = {
    "MIT": ("MIT License", "MIT licence", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "Zlib"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "Unlicense": ("Unlicense",),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0-only"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GPLv2+", "GPL-2.0-or-later"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0-only"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GPLv3+", "GPL-3.0-or-later"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1-only"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0-only"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0-only"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"),
}
FORMS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "Published under {}.", "Available under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "This project is licensed under {}.", "This file is licensed under {}.", "This code is licensed under {}.", "This software is released under {}.")
TAG = "SPDX-License-Identifier: {}"
# Rules over the sentences of licence texts, each a licence, a kind and a sequence of identifiers.
TEXT_RULES = (
    ("BSD-4-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-endorse")),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-warranty", "mit-liable")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-3-Clause", "partial", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("Apache-2.0", "notice", ("apache2-grant", "apache2-copy", "apache2-basis", "apache2-see")),
    ("MIT", "partial", ("mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-2-Clause", "partial", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Zlib", "text", ("zlib-warranty", "zlib-liable", "zlib-grant")),
    ("Apache-2.0", "notice", ("apache2-grant", "apache2-copy")),
    ("Apache-2.0", "text", ("apache2-title", "apache2-terms")),
    ("ISC", "text", ("isc-grant", "isc-warranty")),
    ("ISC", "text", ("isc-grant-and", "isc-warranty")),
    ("0BSD", "text", ("0bsd-grant", "isc-warranty")),
    ("Unlicense", "text", ("unlicense-free", "unlicense-anyone")),
    ("MPL-2.0", "notice", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", "partial", ("mpl2-subject",)),
    ("Apache-2.0", "partial", ("apache2-grant",)),
    ("Apache-2.0", "partial", ("apache2-copyright",)),
    ("MIT", "partial", ("mit-grant",)),
    ("ISC", "partial", ("isc-grant",)),
    ("ISC", "partial", ("isc-grant-and",)),
    ("0BSD", "partial", ("0bsd-grant",)),
    ("Zlib", "partial", ("zlib-grant",)),
    ("BSL-1.0", "partial", ("boost-grant",)),
    ("Unlicense", "partial", ("unlicense-free",)),
    ("EPL-2.0", "notice", ("epl2-terms",)),
    ("CC0-1.0", "short", ("cc0-dedicated",)),
    ("WTFPL", "partial", ("wtfpl-do",)),
)


def table() -> tuple[dict[str, str], tuple[tuple[str, str, tuple[str, ...]], ...]]:
    """All known sentences and all rules, longer rules first: the texts above, the GNU notices and the short notices."""
    known, rules = dict(TEXTS), list(TEXT_RULES)
    for thing in GNU_THINGS:
        known[f"gnu-hope-{thing}"] = GNU_HOPE.format(thing)
        for family, (name, versions) in GNU.items():
            for v in versions:
                full = v if "." in v else f"{v}.0"
                for kind, form in (("or-later", GNU_NOTICE), ("only", GNU_ONLY)):
                    sentence = f"{family}-{v}-{kind}-{thing}".lower()
                    known[sentence] = form.format(thing, name, v)
                    rules += [(f"{family}-{full}-{kind}", "notice", (sentence, f"gnu-hope-{thing}")), (f"{family}-{full}-{kind}", "partial", (sentence,))]
    for licence, names in NAMES.items():
        known[f"tag-{licence}"] = TAG.format(licence)
        rules.append((licence, "tag", (f"tag-{licence}",)))
        for i, name in enumerate(names):
            for j, form in enumerate(FORMS):
                for article in ("", "the ", "a "):
                    sentence = f"{licence}-{i}-{j}-{article.strip() or 'no'}".lower()
                    known[sentence] = form.format(article + name)
                    rules.append((licence, "short", (sentence,)))
    return known, tuple(sorted(rules, key=lambda r: -len(r[2])))


SENTENCES, RULES = table()
#: Unknown sentences that may stand between two sentences of a rule.
GAP = 2
WORD = re.compile(r"[0-9A-Za-z.\-/+]+")
#: Where a sentence may begin: in the beginning, behind a stop or colon and white space, or on a new line, after any marks.
BEGIN = r"(?:\A|(?<=[.!?:])\s|\n)[^0-9A-Za-z\n]*"
#: Where a sentence may end, behind its last word: at a stop or colon before white space, or at the end of a line.
END = re.compile(r"[^0-9A-Za-z\s]*[ \t]*[^0-9A-Za-z\s]*(?:\r?\n|\Z)|[^0-9A-Za-z\s]*[.!?:;][^0-9A-Za-z\s]*(?=\s)")
#: What parts unknown sentences; a line break alone does not.
STOP = re.compile(r"(?<=[.!?:])\s+|\n\s*\n")


def plain(word: str) -> str:
    """A word in lower case without marks around it; ``https`` counts as ``http``."""
    word = word.lower().strip(".-/")
    return "http" if word == "https" else word


def normalise(sentence: str) -> str:
    """Lower case, comment marks and punctuation gone, white space single; stops inside words stay."""
    return " ".join(w for w in map(plain, WORD.findall(sentence)) if w)


class Recogniser:
    """Looks sentences up and matches the rules."""

    def __init__(self, known: Mapping[str, str] = SENTENCES, rules: Sequence[tuple] = RULES, gap: int = GAP):
        self.rules, self.gap = rules, gap
        self.tree: dict = {}
        same: dict[str, str] = {}  # sentences that are equal once normalised are one
        for name, text in known.items():
            words = normalise(text)
            same[name] = name
            node = self.tree
            for word in words.split(" "):
                node = node.setdefault(word, {})
            same[name] = node.setdefault("", name)
        self.rules = [(licence, kind, tuple(same[s] for s in sequence)) for licence, kind, sequence in rules]
        self.starts: dict[str, list[int]] = {}
        for n, (_, _, sequence) in enumerate(self.rules):
            self.starts.setdefault(sequence[0], []).append(n)
        firsts = sorted({w for w in self.tree if w}, key=lambda w: (-len(w), w))
        self.begin = re.compile(rf"{BEGIN}(?=(?:{'|'.join(map(re.escape, firsts))})(?![0-9A-Za-z]))", re.I)

    def _lookup(self, text: str, at: int) -> tuple[str | None, int]:
        """The longest known sentence that begins at a place, and its end."""
        node, name, end = self.tree, None, at
        for word in WORD.finditer(text, at):
            key = plain(word[0])
            if not key:
                continue
            node = node.get(key)
            if node is None:
                break
            if "" in node:
                tail = len(word[0]) - len(word[0].rstrip(".-/"))
                if END.match(text, word.end() - tail):
                    name, end = node[""], word.end()
        return name, end

    def _unknown(self, text: str, at: int, end: int) -> Iterator[int]:
        """Where the sentences between two places begin."""
        while word := WORD.search(text, at, end):
            if plain(word[0]):
                yield word.start()
                stop = STOP.search(text, word.end(), end)
                at = stop.end() if stop else end
            else:
                at = word.end()

    def identify(self, text: str) -> list[tuple[int, str, int, int]]:
        """``(sentence number, identifier, start, end)`` of the known sentences, in order; numbers tell how many unknown
        sentences are between, as far as the rules ask."""
        out: list[tuple[int, str, int, int]] = []
        at = 0
        while found := self.begin.search(text, at):
            name, end = self._lookup(text, found.end())
            if name is None:
                at = max(found.end(), at + 1)
                continue
            unknown = 0
            if out:
                unknown = sum(1 for _ in islice(self._unknown(text, out[-1][3], found.end()), self.gap + 1))
            out.append((out[-1][0] + 1 + unknown if out else 0, name, found.end(), end))
            at = end
        return out

    def recognise(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """``(licence, kind, start, end)`` of the matches, by position; longer rules are tried first."""
        found = self.identify(text or "")
        at: dict[str, list[int]] = {}
        for i, (_, name, _, _) in enumerate(found):
            at.setdefault(name, []).append(i)
        used: set[int] = set()
        out: list[tuple[str, str, int, int]] = []
        for n in sorted({n for name in at for n in self.starts.get(name, ())}):
            licence, kind, sequence = self.rules[n]
            for i in at[sequence[0]]:
                chain, j = [i], i
                if i in used:
                    continue
                for name in sequence[1:]:
                    last = found[chain[-1]][0]
                    j = next((k for k in range(chain[-1] + 1, min(len(found), chain[-1] + self.gap + 2)) if found[k][0] - last <= self.gap + 1 and k not in used and found[k][1] == name), -1)
                    if j < 0:
                        break
                    chain.append(j)
                if len(chain) == len(sequence):
                    used.update(chain)
                    out.append((licence, kind, found[chain[0]][2], found[chain[-1]][3]))
        return sorted(out, key=lambda m: (m[2], m[0]))


MATCHES = "array<struct<licence: string, kind: string, start: int, end: int>>"


def anchor(known: Mapping[str, str] = SENTENCES) -> str | None:
    """A cheap necessary condition: each known sentence contains one of these words, else there is no condition."""
    words = ("under ", "licen", "permi", "redistribut", "software", "warrant", "copyright", "public domain", "liable", "mpl", "terms and conditions", "advertising", "do what the")
    return "|".join(words) if all(any(w in text.lower() for w in words) for text in known.values()) else None


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Mapping[str, str] = SENTENCES, rules: Sequence[tuple] = RULES) -> DataFrame:
    """``(doc_id, licences, n_matches, matches)`` per row: the distinct licences in code-point order, and every match with
    its kind and its span in code points.

    One pass without a shuffle over whole texts, in time proportional to them, however long they are. Null and empty
    texts have no matches; repeated rows have equal results; an empty table gives no rows; extra columns are ignored.
    Matching ignores case, punctuation and line breaks.
    """
    known, rules = dict(known), tuple(rules)
    condition = anchor(known)
    possible = re.compile(condition) if condition else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = Recogniser(known, rules)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                found.append(recogniser.recognise(text) if text and (possible is None or possible.search(text.lower())) else [])
            kind = pa.list_(pa.struct([("licence", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            matches = pa.array([[dict(zip(("licence", "kind", "start", "end"), m, strict=True)) for m in ms] for ms in found], kind)
            names = pa.array([sorted({m[0] for m in ms}) for ms in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.array([len(m) for m in found], pa.int32()), matches], ["doc_id", "licences", "n_matches", "matches"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licences array<string>, n_matches int, matches {MATCHES}")
