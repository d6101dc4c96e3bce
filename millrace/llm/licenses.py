"""License scans by patience alignment.

Where a window of a text has enough of a template's words, the two are aligned: equal words at both ends are paired, then words unique
to both become anchors, the longest increasing run of them is kept, and the gaps between are aligned in the same way. The share of the
template's words that are paired is its coverage, and the phrases that tell its license from others must be paired whole. Of matches
that overlap, the one that fits best stays; a notice within a whole text belongs to it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Slice, slices

COVERAGE = 0.8
#: A match spans this many times its template's words at most.
STRETCH = 1.25

#: Whole texts: file in license_texts, SPDX identifier.
_WHOLE = (
    ("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.2", "GFDL-1.2"), ("GFDL-1.3", "GFDL-1.3"), ("GPL-1", "GPL-1.0"), ("GPL-2", "GPL-2.0"),
    ("GPL-3", "GPL-3.0"), ("LGPL-2", "LGPL-2.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-1.1", "MPL-1.1"), ("MPL-2.0", "MPL-2.0"),
)
_TEXTS = {name: (Path(__file__).parent / "license_texts" / f"{file}.txt").read_text() for file, name in _WHOLE}
# BSD-2-Clause is the three-clause text less its last clause.
_BSD = _TEXTS["BSD-3-Clause"]
_TEXTS["BSD-2-Clause"] = _BSD[: _BSD.index("3. Neither")] + _BSD[_BSD.index("THIS SOFTWARE IS PROVIDED") :]
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = (("GPL", "1"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3"))
_GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
    "Foundation, {version}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
)
_CC = tuple((f"CC-{kind}-{v}", f"CC {kind} {v}") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0"))


def _gnu() -> Iterator[tuple[str, str]]:
    for kind, version in _GNU_VERSIONS:
        spdx = f"{kind}-{version if '.' in version else version + '.0'}"
        if spdx not in ("GPL-2.0", "GPL-3.0"):  # those stand below
            yield spdx, f"This work is licensed under the {_GNU[kind]}, version {version}."
        yield f"{spdx}-only", _GNU_NOTICE.format(name=_GNU[kind], version=f"version {version} of the License")
        if spdx != "GPL-3.0":
            yield f"{spdx}-or-later", _GNU_NOTICE.format(name=_GNU[kind], version=f"either version {version} of the License, or (at your option) any later version")


def _keys(spdx: str) -> tuple[str, ...]:
    """Phrases that tell a license from others; those that a template has must be paired without a gap at one place at least."""
    kind, _, rest = spdx.partition("-")
    if kind in _GNU:
        version = rest.split("-")[0].removesuffix(".0")
        return _GNU[kind], f"version {version}", f"{version} of the license", "any later version"
    if kind == "CC":
        return (spdx,)
    own = {"MIT": ("MIT License",), "Apache": ("Apache License", "Version 2.0"), "MPL": ("Mozilla Public License", f"v. {rest}", f"Version {rest}"), "CC0": ("CC0 1.0",), "GFDL": (f"Version {rest}",)}
    return {"BSD-3-Clause": ("Neither the name",), "BSD-4-Clause": ("All advertising materials",)}.get(spdx, own.get(kind, ()))


# Public license texts and notices, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *((spdx, f"Licensed under {name}.") for spdx, name in _CC),
    *_gnu(),
    *_TEXTS.items(),
)
#: ASCII letters in lower case and digits; other ASCII characters part words.
_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else (c + 32 if 65 <= c <= 90 else c) for c in range(256))


def folded(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass")


def template_words(text: str) -> np.ndarray:
    return Slice([folded(text).encode()], 0).hash


def increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing run (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[pile], last[pile] = v, i
    run, i = [], last[-1] if last else -1
    while i >= 0:
        run.append(i)
        i = back[i]
    return run[::-1]


def unique_places(words: list[int], first: int, end: int) -> dict[int, int]:
    """Words that occur once in words[first:end], with their places."""
    seen: dict[int, int] = {}
    for i in range(first, end):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def aligned(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Paired places of equal words, rising in both, by patience alignment."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = unique_places(text, a, b), unique_places(template, c, d)
        both = sorted((i, theirs[w]) for w, i in ours.items() if w in theirs)
        anchors = [both[i] for i in increasing([j for _, j in both])]
        pairs += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)] if anchors else []
        gaps += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(pairs)


def windows(words: np.ndarray, vocabulary: np.ndarray, last: np.ndarray, length: int, coverage: float) -> np.ndarray:
    """First words of windows of length * STRETCH words, within one text, that hold enough of a template's words to match it.

    last: the end of each word's text. Of starts close together (half a template), the fullest is taken.
    """
    span, need = int(length * STRETCH), int(np.ceil(length * coverage - 1e-9))
    sums = np.concatenate([[0], np.cumsum(np.isin(words, vocabulary))])
    full = sums[np.minimum(np.arange(len(words)) + span, last)] - sums[:-1]
    spots = np.flatnonzero((full >= need) & (np.diff(sums) > 0))
    if not len(spots):
        return spots
    group = np.cumsum(np.concatenate([[0], (np.diff(spots) > 1).astype(np.int64)])) * (len(words) + 1) + spots // max(1, length // 2)
    order = np.lexsort((spots, -full[spots], group))
    return np.sort(spots[order][np.concatenate([[True], np.diff(group[order]) != 0])])


def places(template: list[int], name: str) -> list[list[list[int]]]:
    """Where a template has each of its license's phrases: for each phrase, the places of its words at each occurrence."""
    out = []
    for phrase in _keys(name):
        words = template_words(phrase).tolist()
        at = [list(range(i, i + len(words))) for i in range(len(template)) if template[i : i + len(words)] == words]
        if at:
            out.append(at)
    return out


def holders(part: Slice, words: list[int], seen: dict[int, np.ndarray]) -> np.ndarray:
    """Which texts of a slice have all the words. seen: what is known of single words of this slice."""
    all_of = part.count > 0
    for w in words:
        if w not in seen:
            seen[w] = np.zeros(part.texts, dtype=bool)
            seen[w][part.doc[part.hash == np.uint64(w)]] = True
        all_of = all_of & seen[w]
    return all_of


def matches(part: Slice, templates: list[tuple[str, np.ndarray, list[list[list[int]]]]], coverage: float) -> list[list[dict]]:
    """For each text of a slice, its matches by place: license, coverage, likeness, first and end word."""
    out: list[list[dict]] = [[] for _ in range(part.texts)]
    seen: dict[int, np.ndarray] = {}
    for name, template, keys in templates:
        n, wanted = len(template), template.tolist()
        # The words of its phrases are needed in any case, so texts that lack one can't match.
        able = holders(part, sorted({wanted[j] for spots in keys for j in spots[0]}), seen) & (part.count >= coverage * n - 1e-9)
        if not able.any():
            continue
        chosen = able[part.doc]
        words, doc = part.hash[chosen], part.doc[chosen]
        count = np.where(able, part.count, 0)
        first_of = np.cumsum(count) - count
        last = (first_of + count)[doc]
        for at in windows(words, np.unique(template), last, n, coverage).tolist():
            pairs = aligned(words[at : min(at + int(n * STRETCH), int(last[at]))].tolist(), wanted)
            if len(pairs) < coverage * n - 1e-9:
                continue
            of = {j: i for i, j in pairs}
            if not all(any(all(j in of and of[j] - j == of[key[0]] - key[0] for j in key) for key in spots) for spots in keys):
                continue
            first, end = at + pairs[0][0], at + pairs[-1][0] + 1
            start = int(first_of[doc[at]])
            out[int(doc[at])].append({"license": name, "coverage": len(pairs) / n, "likeness": 2 * len(pairs) / (n + end - first), "words": n, "start": first - start, "end": end - start})
    for doc, found in enumerate(out):
        found = [m for m in found if not any(k["words"] >= 2 * m["words"] and k["start"] <= m["start"] and m["end"] <= k["end"] for k in found)]
        kept: list[dict] = []
        for m in sorted(found, key=lambda m: (-round(m["likeness"], 9), -m["words"], m["start"], m["license"])):
            if all(m["end"] <= k["start"] or m["start"] >= k["end"] for k in kept):
                kept.append(m)
        out[doc] = sorted(kept, key=lambda m: m["start"])
    return out


SCANNED = "doc_id long, n_words long, matches array<struct<license:string,coverage:double,start:int,end:int>>"


def _scan(templates: tuple[tuple[str, str], ...], coverage: float):
    prepared = [(name, words, places(words.tolist(), name)) for name, words in ((name, template_words(text)) for name, text in templates)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch.column(1).to_pylist(), fold=_FOLD):
                found = [[{k: m[k] for k in ("license", "coverage", "start", "end")} for m in x] for x in matches(part, prepared, coverage)]
                yield pa.record_batch({"doc_id": batch.column(0).slice(part.at, part.texts), "n_words": pa.array(part.count, pa.int64()), "matches": pa.array(found, kind)})

    return scan


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words (runs of letters and digits), matches (license, coverage, start and end word, by place) of each row of docs.

    A match covers `coverage` of its template's words at least, in a span of 1.25 times its length at most; a text may have many. A
    null text has no words and no match. Rows that repeat are scanned each on its own; other columns are ignored. No shuffle.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(templates, coverage), SCANNED)
