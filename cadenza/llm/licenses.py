"""License notices in texts by patience alignment.

A notice is compared with a stretch of a text word by word. Words that are
unique in both anchor the alignment: of the anchors, the longest increasing
subsequence is kept, and the gaps between them are aligned the same way. The
share of the notice's words that are aligned is its coverage. Words that tell
a license from its variants must agree, however high the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import slices

#: Short notices by which works name their license.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MPL-2.0": "This work is subject to the terms of the Mozilla Public License, version 2.0.",
}
#: More one-line notices of the same and of other licenses.
LINES = {
    "All-Rights-Reserved": ["All rights reserved."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0."],
    "MIT": ["Licensed under the MIT License."],
    "ISC": ["Released under the ISC License."],
}
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"""
_GNU = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation;
either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""
_CC = "This work is licensed under a Creative Commons {what} {version} International License."
#: The standard headers of files.
HEADERS = {
    "Apache-2.0": [_APACHE],
    "MPL-2.0": [_MPL],
    "GPL-2.0": [_GNU.format(what="program", kind="", version="2")],
    "GPL-3.0": [_GNU.format(what="program", kind="", version="3")],
    "AGPL-3.0": [_GNU.format(what="program", kind="Affero ", version="3")],
    "LGPL-2.0": [_GNU.format(what="library", kind="Library ", version="2")],
    "LGPL-2.1": [_GNU.format(what="library", kind="Lesser ", version="2.1")],
    "LGPL-3.0": [_GNU.format(what="library", kind="Lesser ", version="3")],
    "CC-BY-4.0": [_CC.format(what="Attribution", version="4.0")],
    "CC-BY-SA-4.0": [_CC.format(what="Attribution-ShareAlike", version="4.0")],
    "CC-BY-NC-4.0": [_CC.format(what="Attribution-NonCommercial", version="4.0")],
    "CC-BY-ND-4.0": [_CC.format(what="Attribution-NoDerivatives", version="4.0")],
    "CC-BY-NC-SA-4.0": [_CC.format(what="Attribution-NonCommercial-ShareAlike", version="4.0")],
    "CC-BY-NC-ND-4.0": [_CC.format(what="Attribution-NonCommercial-NoDerivatives", version="4.0")],
}
#: Whole license texts, a file for each.
TEXTS = Path(__file__).parent / "license_texts"
#: Lines that name licenses by identifier; every identifier of the expression counts.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*((?:\([ \t]*)*[A-Za-z0-9.+:-]+(?:[ \t)]+(?:AND|OR|WITH)[ \t(]+[A-Za-z0-9.+:-]+)*)", re.IGNORECASE)
ID = re.compile(r"[A-Za-z0-9.+:-]+")
COVERAGE = 0.75
WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")
#: Words that are written in several ways.
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense"} | {f"{v}{k}{z}": str(k) for k in range(1, 10) for v in ("", "v") for z in ("", ".0")}
SAME |= {f"v{k}.{j}": f"{k}.{j}" for k in range(1, 10) for j in range(1, 10)}
#: Words that tell variants of a license apart, beside numbers of versions.
VARIANT = re.compile(r"lesser|affero|endorse|advertising|[234]-clause|by(-(nc|nd|sa))*|nc|nd|sa|noncommercial|noderiv(ative)?s|sharealike|attribution(-[a-z]+)*")
NUMBER = re.compile(r"\d{1,2}(\.\d{1,2})*")
#: Names without which a line is no notice of their license; other names may stand beside them.
NAMES = frozenset(["apache", "bsd", "isc", "mit", "mozilla"])
#: Notices of up to so many words agree in every variant word, longer texts in as large a share as the coverage.
STRICT = 300
#: In notices of up to so many words every number is a version.
LINE = 30
#: The most common words, which don't tell where a notice might be.
COMMON = frozenset("the of and to or in a any this that is for by you with as under be not on are it its from an may such other if all which at no".split())


def every_notice() -> dict[str, list[str]]:
    """All notices by license: lines, headers and whole texts."""
    out = {name: [text] for name, text in NOTICES.items()}
    for more in (LINES, HEADERS, {p.stem: [p.read_text(encoding="utf-8")] for p in sorted(TEXTS.glob("*.txt"))}):
        for name, texts in more.items():
            out.setdefault(name, []).extend(texts)
    return out


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words, in one spelling, and where they stand, in code points."""
    found = list(WORD.finditer(text))
    return spelled([m[0] for m in found]), [m.span() for m in found]


def spelled(said: list[str]) -> list[str]:
    return [SAME.get(w, w) for w in map(str.lower, said)]


def variants(said: list[str], lo: int, hi: int, short: bool) -> list[int]:
    """Places from lo to before hi of the words that tell variants apart: names, and numbers, in longer notices those after "version"."""
    out = []
    for k in range(lo, hi):
        w = said[k]
        if w == "by" or w == "library":  # as a license's name only
            if (w == "by" and k and said[k - 1] == "cc") or (w == "library" and said[k + 1 : k + 2] == ["general"]):
                out.append(k)
        elif VARIANT.fullmatch(w) or (NUMBER.fullmatch(w) and (short or (k and said[k - 1] in ("version", "v")))):
            out.append(k)
    return out


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = top_at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[k], top_at[k] = v, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Pairs of places of equal words in a and b, increasing in both.

    Equal words at both ends are taken first, then anchors; a gap without
    anchors is left unaligned.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [(a0 + k, b0 + k) for k in range(lo)]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if x and y:
        in_x, in_y = Counter(x), Counter(y)
        place = {w: j for j, w in enumerate(y) if in_y[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(x) if in_x[w] == 1 and w in place]
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        i = j = 0
        for p, q in [*anchors, (len(x), len(y))] if anchors else []:
            out += align(x[i:p], y[j:q], a0 + lo + i, b0 + lo + j)
            if p < len(x):
                out.append((a0 + lo + p, b0 + lo + q))
            i, j = p + 1, q + 1
    return out + [(a0 + len(a) - k, b0 + len(b) - k) for k in range(hi, 0, -1)]


class Template:
    """A notice as words, with what a stretch of text needs to reach the coverage.

    ``rare`` are its words without the common ones, and ``hits`` is how many
    of them a covered stretch has at least; where it might have none, the
    common ones count as well.
    """

    def __init__(self, name: str, text: str):
        self.name, self.words = name, words(text)[0]
        n = len(self.words)
        self.need = -int(-COVERAGE * n // 1)
        common = sum(w in COMMON for w in self.words)
        self.rare = frozenset(w for w in self.words if w not in COMMON or common >= self.need)
        self.hits = self.need - (common if common < self.need else 0)
        self.variants = set(variants(self.words, 0, n, n <= LINE)) | {k for k, w in enumerate(self.words) if n <= LINE and w in NAMES}

    def agrees(self, said: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether the words that tell variants apart are the same in the notice and the stretch."""
        ours, theirs = {i for i, _ in pairs}, {j for _, j in pairs}
        there = variants(said, pairs[0][1], pairs[-1][1] + 1, len(self.words) <= LINE)
        share = 1.0 if len(self.words) <= STRICT else COVERAGE
        return len(self.variants & ours) >= share * len(self.variants) and sum(j in theirs for j in there) >= share * len(there)

    def stretches(self, said: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches that could reach the coverage, from every so many words, such that one holds each place of the notice with a quarter more words."""
        n = len(self.words)
        step = max(1, n // 8)
        before = np.concatenate([[0], np.cumsum(np.fromiter((w in self.rare for w in said), np.int64, len(said)))])
        lo = np.arange(-step + 1, len(said), step).clip(0)
        for more in (n // 4, 0):
            hi = np.minimum(lo + n + more + step, len(said))
            for k in np.flatnonzero(before[hi] - before[lo] >= self.hits):
                yield int(lo[k]), int(hi[k])


class Templates:
    """Notices by license, a text or several for each, with the words of all in a table of their counts."""

    def __init__(self, notices: dict[str, str | list[str]]):
        self.all = [Template(name, t) for name, texts in notices.items() for t in ([texts] if isinstance(texts, str) else texts)]
        self.place = {w: k for k, w in enumerate(sorted({w for t in self.all for w in t.words}))}
        self.counts = np.zeros((len(self.place), len(self.all)), np.int32)
        for k, t in enumerate(self.all):
            for w, c in Counter(t.words).items():
                self.counts[self.place[w], k] = c
        self.need = np.array([t.need for t in self.all])

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, start, end, coverage) of the notices in a text, by place; overlapping ones give way to the one with the most words, then to the best covered.

        No word of a notice has to be there: a notice is looked for if the
        text has enough of its words, in every stretch that has enough of
        them. Identifiers in SPDX lines come from their syntax.
        """
        found = []
        if "icense-" in text or "ICENSE-" in text:
            for m in SPDX.finditer(text):
                for n, x in enumerate(y for y in ID.finditer(m[1]) if y[0].upper() not in ("AND", "OR", "WITH")):
                    found.append((-2, (x[0], m.start() if n == 0 else m.start(1) + x.start(), m.start(1) + x.end(), 1.0)))
        known = [self.place[w] for w in set(spelled(WORD.findall(text))) & self.place.keys()]
        likely = np.flatnonzero(self.counts[known].sum(0) >= self.need) if known else []
        said, spans = words(text) if len(likely) else ([], [])
        for t in (self.all[k] for k in likely):
            for lo, hi in t.stretches(said):
                pairs = align(t.words, said[lo:hi])
                if len(pairs) >= t.need:
                    pairs = [(i, lo + j) for i, j in pairs]
                    if t.agrees(said, pairs):
                        found.append((-len(pairs), (t.name, spans[pairs[0][1]][0], spans[pairs[-1][1]][1], round(len(pairs) / len(t.words), 6))))
        kept: list[tuple[str, int, int, float]] = []
        for _, x in sorted(found, key=lambda y: (y[0], -y[1][3], y[1][2] - y[1][1], y[1][1], y[1][0])):
            at = bisect_left(kept, x[1], key=lambda y: y[1])
            if (at == 0 or kept[at - 1][2] <= x[1]) and (at == len(kept) or x[2] <= kept[at][1]):
                kept.insert(at, x)
        return kept


FOUND = "array<struct<license: string, start: bigint, end: bigint, coverage: double>>"


def scan(docs: DataFrame, notices: dict[str, str | list[str]] | None = None) -> DataFrame:
    """doc_id and licenses: the notices of every text, array<struct<license, start, end, coverage>>.

    Null and empty texts have none; whole texts are scanned however long.
    """
    templates = Templates(notices or every_notice())
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
    names = ("license", "start", "end", "coverage")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[dict(zip(names, x, strict=True)) for x in templates.find(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "licenses"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, licenses {FOUND}")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document's license notices."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        F.array_max(F.col("licenses.coverage")).alias("best_coverage"),
    )
