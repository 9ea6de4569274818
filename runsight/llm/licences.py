"""License scans: matching statistics against a generalised suffix automaton of licence tokens.

The automaton holds every substring of the templates' token sequences; its size is bounded by the fixed
templates. Each text is streamed through it, which gives for every place the longest template substring that
ends there. Maximal matches are chained per template, in order in text and template, into covered spans.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z. Null and empty texts have no
words; repeated rows are treated alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from runsight.llm.common import lower_bytes, per_batch, texts_of

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases that name a licence wherever they stand.
PHRASES = {
    b"under the mit license": "mit",
    b"apache license version 2": "apache-2",
    b"cc by nc": "cc-by-nc",
}

# Licence texts, whole where they are short, and the notices by which long licences are applied to files
# (Apache, GPL, LGPL, AGPL, MPL, CC). All are public texts, by label.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
     and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
     PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
     MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
     HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
     ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
     with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
     by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
     WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
     governing permissions and limitations under the License."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"""),
    ("cc-by-sa", """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"""),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
     Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
     later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
     the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
     more details."""),
    ("bsd-3-clause", _BSD + """ Neither the name of the copyright holder nor the names of its contributors may be used to
     endorse or promote products derived from this software without specific prior written permission. """ + _DISCLAIMER),
    ("bsd-2-clause", _BSD + " " + _DISCLAIMER),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
     PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
     MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
     DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
     NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("lgpl-3", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
     General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
     option) any later version."""),
    ("agpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
     General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
     option) any later version."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
     not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"""),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("cc0", """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to
     this work to the public domain worldwide. This work is distributed without any warranty."""),
    ("all-rights-reserved", "All rights reserved"),
]


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences; ``ends[state]`` lists (template, end) of its substrings."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token, ends)
                ends[last].append((t, at))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] += ends[state]
        self.ends = [sorted(set(e)) for e in ends]

    def _state(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: bytes, ends: list) -> int:
        """The state of the longest substring of q's class that p + token spells."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, ends)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: bytes, ends: list) -> int:
        if token in self.next[last]:  # spelled by an earlier template
            return self._split(last, self.next[last][token], token, ends)
        new = self._state(self.length[last] + 1, ends)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        self.link[new] = 0 if p == -1 else self._split(p, self.next[p][token], token, ends)
        return new

    def matching(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Matching statistics: per place the length of the longest match that ends there, and its state."""
        state = length = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                length = 0
            out.append((length, state))
        return out


def maximal(stats: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(first word, words, state) of the matches that cannot be lengthened to the right."""
    out = []
    for i, (n, state) in enumerate(stats):
        if n >= least and (i + 1 == len(stats) or stats[i + 1][0] <= n):
            out.append((i - n + 1, n, state))
    return out


def chains(matches: list[tuple[int, int, int]], ends: list, gap: int) -> list[tuple[int, int, int, int]]:
    """(template, first word, word after the last, template words covered): best chains per template.

    A match may follow another if it starts later in text and template and at most ``gap`` words lie between.
    """
    pieces: dict[int, list[tuple[int, int, int]]] = {}
    for at, n, state in matches:
        for t, end in ends[state]:
            pieces.setdefault(t, []).append((at, end - n + 1, n))
    out = []
    for t, own in pieces.items():
        own.sort()
        best: list[tuple[int, int]] = []  # covered, start of the chain
        used = []
        for i, (at, tat, n) in enumerate(own):
            score = (n, at)
            for j in range(i - 1, -1, -1):
                a, ta, m = own[j]
                if a < at - gap - 1000:
                    break
                over = max(0, a + m - at, ta + m - tat)
                if a < at and ta < tat and over < n and at - (a + m) <= gap and best[j][0] + n - over > score[0]:
                    score = (best[j][0] + n - over, best[j][1])
            best.append(score)
        order = sorted(range(len(own)), key=lambda i: (-best[i][0], own[i]))
        for i in order:  # longest chains first; those that overlap a kept one are parts of it
            lo, hi = best[i][1], own[i][0] + own[i][2]
            k = bisect_left(used, (hi, hi))  # kept ones are apart, so the last that starts before the end decides
            if not k or used[k - 1][1] <= lo:
                used.insert(k, (lo, hi))
                out.append((t, lo, hi, best[i][0]))
    return sorted(out, key=lambda x: (x[1], x[0]))


class Scanner:
    """least: words of a match that counts; share: part of a template that a span must cover; gap: words between."""

    def __init__(self, least: int = 3, share: float = 0.7, gap: int = 8):
        self.sequences = [WORD.findall(lower_bytes(text)) for _, text in TEMPLATES]
        self.labels = [label for label, _ in TEMPLATES]
        self.automaton = SuffixAutomaton(self.sequences)
        self.known = {w for s in self.sequences for w in s}
        self.phrases = [(p.split(), label) for p, label in PHRASES.items()]
        self.known |= {w for p, _ in self.phrases for w in p}
        self.least, self.share, self.gap = least, share, gap
        self.run = re.compile(b"\x01{%d,}" % least)

    def spans(self, words: list[bytes], mask: bytes) -> list[tuple[int, int, int, int]]:
        """Covered template spans of a text. Words outside the templates end every match, so only the runs of
        template words are streamed."""
        matches = []
        for m in self.run.finditer(mask):
            lo, hi = m.span()
            matches += [(lo + at, n, s) for at, n, s in maximal(self.automaton.matching(words[lo:hi]), self.least)]
        if not matches:
            return []
        return chains(matches, self.automaton.ends, self.gap)

    def cover(self, span: tuple[int, int, int, int]) -> float:
        return min(1.0, span[3] / len(self.sequences[span[0]]))

    def decided(self, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Spans that cover enough of their template and do not lie inside one that covers more of both."""
        out = [x for x in spans if self.cover(x) >= self.share]
        return [x for x in out if not any(y[1] <= x[1] and x[2] <= y[2] and y[3] > x[3] and self.cover(y) > self.cover(x) for y in out)]

    def phrase_places(self, words: list[bytes], mask: bytes) -> list[tuple[int, str]]:
        out = []
        for m in self.run.finditer(mask):
            lo, hi = m.span()
            own = words[lo:hi]
            for phrase, label in self.phrases:
                n = len(phrase)
                out += [(lo + i, label) for i in range(len(own) - n + 1) if own[i] == phrase[0] and own[i:i + n] == phrase]
        return sorted(out)

    def scan(self, text: str) -> tuple:
        words = WORD.findall(lower_bytes(text))
        mask = bytes(map(self.known.__contains__, words))
        base, chained = self.phrase_places(words, mask), self.spans(words, mask)
        spans = self.decided(chained)
        own = sorted({label for _, label in base})
        every = sorted({*own, *(self.labels[x[0]] for x in spans)})
        return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own),
                ",".join(every), max(map(self.cover, chained), default=0.0),
                [{"label": self.labels[t], "first": a, "last": b - 1, "covered": c} for t, a, b, c in spans])


_SCANNER: list[Scanner] = []


def _scan(batch) -> dict:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    rows = [_SCANNER[0].scan(t) for t in texts_of(batch)]
    return {"doc_id": batch.column("doc_id").to_pylist()} | {n: [r[i] for r in rows] for i, n in enumerate(names)}


def scan_licences(docs: DataFrame) -> DataFrame:
    """A row per document: phrase counts, labels, the largest covered share of a template as score, and the spans behind the
    labels: those that cover ``share`` of a template."""
    return per_batch(docs.select("doc_id", "text"), _scan, (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,first:int,last:int,covered:int>>"))
