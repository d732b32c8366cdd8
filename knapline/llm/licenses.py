"""License scans by conditional compression.

Candidate blocks are neighbouring lines or sentences that speak of licensing. Each is compressed alone and with every
template as a raw zstandard dictionary; the templates by falling reduction are its candidates. In that order their exact
wording is looked for in and around the block, by its least word-by-word difference. Where the places of several
templates overlap, the one whose dictionary saves most bytes of its place wins, and the wording confirms it or calls it a
variant. Templates that rank low are compared as well, for a block may hold several notices of which one compresses it
best; none is left out but those that counts of shared words show to differ too much.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, rows, short_batches, texts

# Notices by which works are put under licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "EPL-2.0": "This program is made available under the terms of the Eclipse Public License 2.0.",
}

WARRANTY = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details. You should have received a copy of the {1} along with this {0}"
FREE = "This {0} is free software{2} you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
STREET = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
PAGE = ". If not, see <https://www.gnu.org/licenses/>."
GNU = {
    "GPL-3.0": ("program", "GNU General Public License", ":", ",", "3"),
    "GPL-2.0": ("program", "GNU General Public License", ";", ";", "2"),
    "LGPL-2.1": ("library", "GNU Lesser General Public License", ";", ";", "2.1"),
    "AGPL-3.0": ("program", "GNU Affero General Public License", ":", ",", "3"),
}
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
CREATIVE = "This work is licensed under {} Creative Commons {} 4.0 International License."
LETTER = " To view a copy of this license, visit http://creativecommons.org/licenses/{}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
CC = {"CC-BY-4.0": ("Attribution", "by"), "CC-BY-SA-4.0": ("Attribution-ShareAlike", "by-sa"), "CC-BY-NC-4.0": ("Attribution-NonCommercial", "by-nc")}
# Short texts and the headers that works carry, besides the notices; whole texts of the longer licenses are files.
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", BSD.format("")),
    ("BSD-3-Clause", BSD.format(NAMES)),
    ("BSD-3-Clause", BSD.format("3. " + NAMES)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *((name, FREE.format(*v)) for name, v in GNU.items()),
    *((name, f"{FREE.format(*v)} {WARRANTY.format(*v)}{end}") for name, v in GNU.items() for end in (PAGE, STREET)),
    *((name, CREATIVE.format(a, kind)) for name, (kind, _) in CC.items() for a in ("a", "the")),
    *((name, CREATIVE.format(a, kind) + LETTER.format(path)) for name, (kind, path) in CC.items() for a in ("a", "the")),
    *((name, f"SPDX-License-Identifier: {name}{end}") for name in (*TEMPLATES, "BSD-2-Clause") for end in (("", "-only", "-or-later") if name in GNU else ("",))),
]
FILES = ("Apache-2.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0")
# What follows the terms: advice on how to apply them, which copies often lack.
TAIL = re.compile(r"\n[^\n]*END OF TERMS AND CONDITIONS.*|\nExhibit A - .*", re.DOTALL)
SECTION_13 = re.compile(r"13\. Use with the GNU Affero General Public License\..*?(?=14\. Revised Versions)", re.DOTALL)
REMOTE = "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License. "

SPEAKS = re.compile(r"licen[sc]|copyright|warrant|public domain|hereby granted|spdx", re.IGNORECASE | re.ASCII)
HINTS = ("licen", "copyright", "warrant", "public domain", "hereby granted", "spdx")  # of SPEAKS in lower case
# A full stop before a number, as in "v. 2.0", ends no sentence.
SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=[ \t]+[^\d\s]|[ \t]*(?:\n|$))|(?=\n)|$)")
WORD = re.compile(r"[\w.+-]*\w")
# What closes a notice behind its last word.
CLOSE = re.compile(r"[.!?\"')\]]*")
LEVEL = 3
TOLERANCE = 0.25
NEAR = 0.1
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("reduction", pa.float64()), ("n_different", pa.int64()), ("verdict", pa.string())])


def blocks(text: str, gap: int = 2) -> Iterator[tuple[int, int]]:
    """Spans in code points: runs of sentences that speak of licensing, with at most `gap` others between."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return
    now, since = None, 0
    for m in SENTENCE.finditer(text):
        if SPEAKS.search(m[0]):
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            if now and since <= gap and since:
                now = (now[0], m.end())
            elif now and since == 0:
                now = (now[0], m.end())
            else:
                now = (begin, m.end())
            since = 0
        elif now:
            since += 1
            if since > gap:
                yield now
                now, since = None, 0
    if now:
        yield now


class Form:
    """A template as numbers of words, and the most words that a variant may differ by."""

    def __init__(self, name: str, body: str, numbers: dict[str, int], tolerance: float):
        self.name, self.body = name, body
        self.words = np.array([numbers.setdefault(w, len(numbers)) for w in _words(body)], np.int32)
        self.n = len(self.words)
        self.most = int(tolerance * self.n)
        self.kinds, self.counts = np.unique(self.words, return_counts=True)
        book = zstandard.ZstdCompressionDict(body.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=LEVEL)
        self.zip = zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_dict_id=False)

    def reduction(self, text: str) -> float:
        alone, saved = _alone(text), self.saved(text)
        return saved / alone

    def saved(self, text: str) -> int:
        """Bytes that the template spares as a dictionary."""
        return _alone(text) - len(self.zip.compress(text.encode()))

    def shared(self, x: np.ndarray, size: int) -> int:
        """How many words of the template x has too, repeats counted: the rest differ wherever it may stand in x."""
        return int(np.minimum(np.bincount(x[x >= 0], minlength=size)[self.kinds], self.counts).sum())

    def find(self, x: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """(start, end, words that differ) of places in x that don't overlap, the closest first."""
        out = []
        raw, own, at = x.tobytes(), self.words.tobytes(), 0
        while (at := raw.find(own, at)) >= 0:
            if at % 4:
                at += 1
                continue
            out.append((at // 4, at // 4 + self.n, 0))
            at += len(own)
        edges = [0, *(e for a, b, _ in out for e in (a, b)), len(x)]
        for a, b in list(zip(edges[::2], edges[1::2], strict=True)):
            if self.most and b - a >= self.n - self.most:
                out += [(a + i, a + j, d) for i, j, d in self._near(x[a:b], size)]
        return sorted(out, key=lambda o: (o[2], o[0]))

    def _near(self, x: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        if self.n - self.shared(x, size) > self.most:
            return []
        d = distances(self.words, x)
        # Where neighbouring ends are as close, the last one holds the word that was changed.
        ends = np.flatnonzero((d <= self.most) & np.append(d[:-1] != d[1:], True))
        out, free = [], np.ones(len(x) + 1, bool)
        for j in ends[np.argsort(d[ends], kind="stable")].tolist():
            if j == 0 or not free[j - 1]:
                continue
            used = np.flatnonzero(~free[max(0, j - self.n - self.most) : j])
            low = max(0, j - self.n - self.most) + (int(used[-1]) + 1 if len(used) else 0)
            if j - low < self.n - self.most:
                continue
            back = distances(self.words[::-1], x[low:j][::-1], anchored=True)
            least = int(back.min())
            if least <= self.most:
                i = j - int(np.flatnonzero(back == least)[-1])
                out.append((i, j, least))
                free[i:j] = False
        return out


@functools.lru_cache(maxsize=1_000)
def _alone(text: str) -> int:
    """Bytes of a text that is compressed without a dictionary."""
    return len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(text.encode()))


def distances(words: np.ndarray, x: np.ndarray, anchored: bool = False) -> np.ndarray:
    """For each end in x, 0 to its length: the fewest words to change, drop or add between `words` and a part of x that
    ends there; a part that starts where x does if anchored."""
    place = np.arange(len(x) + 1, dtype=np.int32)
    row = place.copy() if anchored else np.zeros_like(place)
    for k, w in enumerate(words, 1):
        new = np.minimum(row + 1, np.int32(2**30))
        np.minimum(new[1:], row[:-1] + (x != w), out=new[1:])
        new[0] = k
        row = np.minimum.accumulate(new - place) + place
    return row


@functools.lru_cache(maxsize=4)
def _forms(templates: tuple[tuple[str, str], ...], tolerance: float) -> tuple[list[Form], dict[str, int]]:
    numbers: dict[str, int] = {}
    return [Form(name, body, numbers, tolerance) for name, body in templates], numbers


def _words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _without(spans: list[tuple[int, int]], taken: list[tuple]) -> list[tuple[int, int]]:
    """spans (in order) less what is taken."""
    out = []
    taken = sorted(t[:2] for t in taken)
    for a, b in spans:
        for i, j in taken:
            if j > a and i < b:
                if i > a:
                    out.append((a, i))
                a = max(a, j)
        if a < b:
            out.append((a, b))
    return out


@functools.lru_cache(maxsize=20_000)
def ranked(block: str, templates: tuple[tuple[str, str], ...], tolerance: float) -> tuple[int, ...]:
    """The templates by falling size reduction of a block; equal ones in their order."""
    forms, _ = _forms(templates, tolerance)
    saved = [f.saved(block) for f in forms]
    return tuple(sorted(range(len(forms)), key=lambda k: -saved[k]))


def notices(x: np.ndarray, spans: list[tuple[int, int]], forms: list[Form], size: int, order: dict[int, list[int]], saved) -> list[tuple[int, int, int, Form]]:
    """(start, end, words that differ, form) of every notice in x that touches one of the spans (in words, in order).

    order: for each form its ranks in the blocks of the spans; saved(form, start, end): the bytes that it spares there. Of
    notices that overlap, those that spare most, up to a share of NEAR less, are the winners, and the wording confirms
    one: that with the fewest words that differ, of equal ones the one that spares more, then that which ranks higher. An
    exact wording of another license inside a variant stands too. What the rest of the words hold is looked for again
    until nothing more is found.
    """
    taken: list[tuple[int, int, int, Form]] = []
    best = {k: min(r) for k, r in order.items()}
    ranks = sorted(best, key=best.get)
    while True:
        found = []
        for rank, k in enumerate(ranks):
            form = forms[k]
            reach: list[tuple[int, int]] = []
            for a, b in spans:
                a, b = max(0, a - form.n - form.most), min(len(x), b + form.n + form.most)
                if reach and a <= reach[-1][1]:
                    reach[-1] = (reach[-1][0], max(b, reach[-1][1]))
                else:
                    reach.append((a, b))
            for a, b in _without(reach, taken):
                if b - a >= form.n - form.most:
                    found += [(a + i, a + j, d, form, rank) for i, j, d in form.find(x[a:b], size)]
        found = [f for f in found if any(f[0] < b and f[1] > a for a, b in spans)]
        before = len(taken)
        for f in _by_merit([(saved(f[3], f[0], f[1]), *f) for f in found]):
            over = [t for t in taken if t[0] < f[1] and t[1] > f[0]]
            if not over or f[2] == 0 and all(t[2] and t[3].name != f[3].name for t in over):
                taken.append(f)
        if len(taken) == before:
            return sorted(taken, key=lambda t: t[:3])


def _by_merit(found: list[tuple]) -> Iterator[tuple]:
    """Places (saved, start, end, words that differ, form, rank) in the order in which they are taken, without what they
    save and their rank."""
    found = sorted(found, key=lambda f: (-f[0], f[5], f[1]))
    while found:
        top = found[0]
        rivals = [f for f in found if f[1] < top[2] and f[2] > top[1] and f[0] >= (1 - NEAR) * top[0]]
        won = min(rivals or [top], key=lambda f: (f[3], -f[0], f[5], f[1]))
        found.remove(won)
        yield won[1:5]


def judge(text: str, templates: tuple[tuple[str, str], ...], tolerance: float = TOLERANCE) -> list[tuple[int, int, str | None, float, int, str]]:
    """(start, end, license, reduction, words that differ, verdict) of each notice, in code points, and of each block
    without one, compared with its nearest template."""
    places = list(blocks(text))
    if not places:
        return []
    forms, numbers = _forms(templates, tolerance)
    words = list(WORD.finditer(text))
    x = np.array([numbers.get(m[0].lower(), -1) for m in words], np.int32)
    begin, end = np.array([m.start() for m in words]), np.array([m.end() for m in words])
    spans = [(int(np.searchsorted(begin, a)), int(np.searchsorted(end, b, side="right"))) for a, b in places]
    order: dict[int, list[int]] = {}
    for a, b in places:
        for rank, k in enumerate(ranked(text[a:b], templates, tolerance)):
            order.setdefault(k, []).append(rank)

    def place(i: int, j: int) -> tuple[int, int]:
        a, b = int(begin[i]), int(end[j - 1])
        return a, b + len(CLOSE.match(text, b)[0])

    def saved(form: Form, i: int, j: int) -> int:
        a, b = place(i, j)
        return form.saved(text[a:b])

    taken = notices(x, spans, forms, len(numbers), order, saved)
    out = []
    for i, j, d, form in taken:
        a, b = place(i, j)
        out.append((a, b, form.name, form.reduction(text[a:b]), d, "variant" if d else "exact"))
    for (a, b), (i, j) in zip(places, spans, strict=True):
        if not any(t[0] < j and t[1] > i for t in taken):
            out.append((a, b, None, *_nearest(text[a:b], templates, tolerance), "other"))
    return sorted(out, key=lambda o: o[:2])


def _nearest(block: str, templates: tuple[tuple[str, str], ...], tolerance: float) -> tuple[float, int]:
    """(reduction, words that differ) of the template that ranks first."""
    forms, numbers = _forms(templates, tolerance)
    form = forms[ranked(block, templates, tolerance)[0]]
    x = np.array([numbers.get(w, -1) for w in _words(block)], np.int32)
    return form.reduction(block), int(distances(form.words, x).min())


def listed(templates: dict[str, str]) -> tuple[tuple[str, str], ...]:
    return tuple(sorted(templates.items()))


def _affero(text: str) -> str:
    """The GNU Affero license from the GNU GPL: another name and section 13."""
    name = re.compile(r"GNU(\s+)General(\s+)Public(\s+)License", re.IGNORECASE)
    parts = SECTION_13.split(text)
    return REMOTE.join(name.sub(r"GNU Affero\1General\2Public\3License", p) for p in parts)


@functools.cache
def everything() -> tuple[tuple[str, str], ...]:
    """The notices, headers and whole texts, the latter also without what follows their terms."""
    own = {name: (resources.files(__package__) / "license_texts" / f"{name}.txt").read_text(encoding="utf-8") for name in FILES}
    own["AGPL-3.0"] = _affero(own["GPL-3.0"])
    return tuple(sorted({*TEMPLATES.items(), *HEADERS, *own.items(), *((name, TAIL.sub("", t)) for name, t in own.items())}))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per notice: its place in code points, the license, the size reduction and the verdict; one row with
    verdict `other` and a null license per candidate block without any.

    A null or empty text has no blocks, so no rows. A block with several notices gives a row for each; repeated rows
    give repeated results.
    """
    short_batches(docs.sparkSession)
    own = listed(templates) if templates else everything()

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            found += [(doc, *row) for row in judge(text, own)]
        return rows(OUT, *(map(list, zip(*found, strict=True)) if found else [[]] * len(OUT)))

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(by_batch(search), "doc_id long, start long, end long, license string, reduction double, n_different long, verdict string")
