"""Operator 4, license scans: template-markup matching by token automata.

A template is mandatory wording with marked regions: ``[[ ... ]]`` may be missing (regions may nest), a bar parts
alternatives in it, ``<<n>>`` stands for one to n words of any kind (names, years, titles). Each template is compiled
once into a token automaton whose transitions are words, any-word steps and jumps over optional regions; a text holds
the template where the automaton, started at some word, reaches its end, so every mandatory word matches exactly.
The fixed base phrases are searched first; the templates add labels of their own to them.

A text is run through a template's automaton once, from its first word to its last, all starting places at a time, so
the work is linear in the text; and only if it holds the template's longest stretch of mandatory words.

A null or empty text has no words, no labels and score 0. Texts are matched whole, of any length. Repeated and
overlapping places all count; labels are distinct and sorted. Rows are scanned each by itself, repeated ones too;
extra columns stay behind; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, release, tune

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Disclaimers that several licenses share.
BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY [[ THE COPYRIGHT HOLDERS AND CONTRIBUTORS | THE REGENTS AND CONTRIBUTORS | <<12>> ]]
 "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
 PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL [[ THE ]] [[ COPYRIGHT HOLDER | COPYRIGHT HOLDERS | COPYRIGHT OWNER | REGENTS | <<12>> ]]
 [[ OR CONTRIBUTORS ]] BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
 PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
 LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
 EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
 [[ 1 ]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 [[ 2 ]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
 documentation and/or other materials provided with the distribution."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of
 [[ this software and associated documentation files (the "Software"), | <<8>> ]] to deal in the Software without restriction, including without
 limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
 whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
 [[ (including the next paragraph) ]] shall be included in all copies or substantial portions of the Software."""
MIT_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
 MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL [[ THE ]] [[ AUTHORS OR COPYRIGHT HOLDERS | X CONSORTIUM | <<8>> ]]
 BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
 THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Public license wording, as templates.
TEMPLATES = {
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
 THE SOFTWARE IS PROVIDED "AS IS" AND""",
    "agpl-notice": """under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 [[ of the License ]]""",
    "apache-2-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this [[ <<2>> ]] file except in compliance with the License.
 You may obtain a copy of the License at [[ http www apache org licenses LICENSE 2 0 | https www apache org licenses LICENSE 2 0 | <<8>> ]]
 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
 WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "apache-2-short": "licensed under the Apache License [[ Version ]] 2 0",
    "apache-2-title": "Apache License Version 2.0, January 2004 [[ http www apache org licenses ]] TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "boost-1": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining
 a copy of the software and accompanying documentation covered by this license""",
    "bsd-2-clause": BSD_GRANT + " " + BSD_AS_IS,
    "bsd-3-clause": BSD_GRANT + """ [[ 3 ]] Neither the name of [[ the ]] [[ copyright holder | University | <<12>> ]] nor the names of [[ its | <<4>> ]] contributors may be
 used to endorse or promote products derived from this software without specific prior written permission. """ + BSD_AS_IS,
    "bsd-4-clause": """All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software
 developed by""",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "[[ licensed ]] under [[ a | the ]] Creative Commons Attribution <<2>> [[ International | Unported | Generic ]] License",
    "cc-by-nc-nd": "cc by nc nd",
    "cc-by-nc-sa": "cc by nc sa",
    "cc-by-sa": "[[ licensed ]] under [[ a | the ]] Creative Commons Attribution ShareAlike <<2>> [[ International | Unported | Generic ]] License",
    "cc0": """[[ the person who associated a work with this deed has | <<8>> ]] dedicated the work to the public domain by waiving all of his or her rights to the work
 worldwide under copyright law""",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License <<4>>",
    "gpl-notice": """under the terms of the GNU [[ Lesser | Library ]] General Public License as published by the Free Software Foundation [[ either ]] version <<2>>""",
    "gpl-warranty": """This [[ program | library | software ]] is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
 MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "isc": """Permission to use, copy, modify, and [[ or ]] distribute this software for any purpose with or without fee is hereby granted, provided that the above
 copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND [[ ISC | THE AUTHOR | THE AUTHORS | <<8>> ]] DISCLAIMS ALL WARRANTIES
 WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "mit-full": MIT_GRANT + " " + MIT_AS_IS,
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of
 [[ this software and associated documentation files [[ the Software ]] | <<8>> ]] to deal in the Software without restriction""",
    "mit-notice": "[[ released | licensed | distributed | available ]] under the [[ terms of the ]] MIT license",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
 [[ http | https ]] [[ www ]] mozilla org MPL 2 0""",
    "postgresql": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby
 granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.""",
    "spdx-apache-2": "SPDX license identifier Apache 2 0",
    "spdx-bsd": "SPDX license identifier BSD [[ 2 | 3 ]] clause",
    "spdx-gpl": "SPDX license identifier [[ LGPL | AGPL ]] [[ GPL ]] <<2>> [[ only | or later ]]",
    "spdx-mit": "SPDX license identifier MIT",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
 either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the [[ author | authors | <<6>> ]] be held liable for any damages arising from
 the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
 freely, subject to the following restrictions: [[ 1 ]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
#: A-Z to a-z; digits, letters and bytes of other characters stay; all else parts words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MARKS = ("[[", "|", "]]", "<<", ">>")


def tokens_of(template: str) -> list[str]:
    """Marks ``[[``, ``|``, ``]]``, ``<<n>>`` and words, these as texts' words are made."""
    for mark in ("[[", "]]", "|", "<<"):
        template = template.replace(mark, f" {mark}")
    template = template.replace("[[", "[[ ").replace("]]", "]] ").replace("|", "| ").replace(">>", ">> ")
    out = []
    for part in template.split():
        out += [part] if part.startswith(MARKS) else part.encode().translate(WORDS).decode().split()
    return out


class Automaton:
    """Nodes with word transitions, any-word transitions and free jumps; the last node accepts."""

    def __init__(self, template: str):
        self.words: list[dict[str, set[int]]] = [{}]
        self.any: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        tokens = tokens_of(template)
        self.end, rest = self._sequence(0, tokens)
        if rest:
            raise ValueError(f"unbalanced markup: {template}")
        self.starts = self._reach({0})
        self.first = {w for x in self.starts for w in self.words[x]}  # words that may begin a match
        self.any_first = any(self.any[x] for x in self.starts)
        # the longest stretch of mandatory wording: what a scan looks for first
        runs, deep = [[]], 0
        for t in tokens:
            deep += (t == "[[") - (t == "]]")
            if deep or t == "]]" or t.startswith("<<"):
                runs.append([])
            else:
                runs[-1].append(t)
        self.mandatory = max(runs, key=lambda r: len(" ".join(r)))
        if not self.mandatory:
            raise ValueError(f"no mandatory wording: {template}")

    def _node(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.words) - 1

    def _sequence(self, at: int, tokens: list[str]) -> tuple[int, list[str]]:
        """Append tokens up to a closing mark or bar; the node reached and the tokens left."""
        while tokens and tokens[0] not in ("]]", "|"):
            t, tokens = tokens[0], tokens[1:]
            if t == "[[":
                out = self._node()
                self.free[at].add(out)
                while True:
                    branch = self._node()
                    self.free[at].add(branch)
                    last, tokens = self._sequence(branch, tokens)
                    self.free[last].add(out)
                    if not tokens:
                        raise ValueError("an optional region has no end")
                    bar, tokens = tokens[0] == "|", tokens[1:]
                    if not bar:
                        break
                at = out
            elif t.startswith("<<"):
                out = self._node()
                for _ in range(int(t[2:-2])):
                    step = self._node()
                    self.any[at].add(step)
                    self.free[step].add(out)
                    at = step
                at = out
            else:
                step = self._node()
                self.words[at].setdefault(t, set()).add(step)
                at = step
        return at, tokens

    def _reach(self, nodes: set[int]) -> frozenset[int]:
        todo, seen = list(nodes), set(nodes)
        while todo:
            for n in self.free[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        return frozenset(seen)

    def _step(self, nodes: frozenset[int], word: str) -> frozenset[int]:
        to: set[int] = set()
        for x in nodes:
            to |= self.words[x].get(word, set()) | self.any[x]
        return self._reach(to) if to else frozenset()

    def holds(self, words: list[str]) -> bool:
        """Whether a match starts at any of the words: one pass, all starts together."""
        nodes: frozenset[int] = frozenset()
        for w in words:
            if w in self.first or self.any_first:
                nodes |= self.starts
            if nodes:
                nodes = self._step(nodes, w)
                if self.end in nodes:
                    return True
        return False


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        found = {label: Automaton(t) for label, t in templates.items()}
        self.templates = [(label, f" {' '.join(a.mandatory)} ".encode(), a) for label, a in sorted(found.items())]

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.encode().translate(WORDS).split()
        line = b" " + b" ".join(words) + b" "
        places, base = [], set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = line.find(phrase, at + 1)
        places = self._index(line, places)
        likely = [(label, a) for label, stretch, a in self.templates if stretch in line]
        texts = [w.decode() for w in words] if likely else []
        found = {label for label, a in likely if a.holds(texts)}
        return (len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base or found else 0.0)

    @staticmethod
    def _index(line: bytes, offsets: list[int]) -> list[int]:
        """The number of the word after each blank at ``offsets``, ascending."""
        out, at, n = [], 0, 0
        for x in sorted(offsets):
            n += line.count(b" ", at, x)
            at = x
            out.append(n)
        return out


def scan_licenses(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per document: words, base phrase places, base labels and all labels. No shuffle.

    ``score``: 1.0 if any base phrase or whole template is held, else 0.0 (mandatory wording is exact).
    """
    tune(documents.sparkSession)

    def run(batches):
        release()
        scanner = Scanner(phrases, templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = [scanner.scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    return only(documents, doc_id="long", text="string").mapInArrow(run, SCHEMA)
