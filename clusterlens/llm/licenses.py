"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment of the candidates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach

#: Words of a fingerprint, and fingerprints in a winnowing window: shared runs of GRAM + WINDOW - 1 words are found.
GRAM, WINDOW = 3, 2
#: Share of a template's words that the alignment must match.
COVERAGE = 0.8
#: Words by which text and template may drift apart within one alignment, at least (long templates: all edits they allow).
BAND = 6
#: The band that is tried first; wider ones only where more edits are needed.
START_BAND = 8
#: Templates of more words are grants and full texts, which may cite numbers and other licenses beside their own.
NOTICE_WORDS = 100


def _notices() -> dict[str, str]:
    """Notices and headings as their licenses print them (fixed values)."""
    out = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0",
        "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                             "in compliance with the License. You may obtain a copy of the License at "
                             "http://www.apache.org/licenses/LICENSE-2.0",
        "MIT": "Released under the MIT License",
        "MIT-title": "The MIT License (MIT) Copyright (c)",
        "MIT-grant": _MIT_GRANT,
        "BSD-2-Clause": "Licensed under the BSD 2-Clause License",
        "BSD-3-Clause": "Licensed under the BSD 3-Clause License",
        "BSD-disclaimer": _BSD_DISCLAIMER,
        "ISC": "Licensed under the ISC License",
        "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0",
        "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                          "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "MPL-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may "
                          "not use this file except in compliance with the License. You may obtain a copy of the License at "
                          "http://www.mozilla.org/MPL/",
        "CC0-1.0": "This work is licensed under CC0 1.0",
        "AGPL-3.0-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation",
    }
    for short, name, versions in (("GPL", "", "1 2 3"), ("LGPL", "Library", "2"), ("LGPL", "Lesser", "2.1 3"), ("AGPL", "Affero", "3")):
        for v in versions.split():
            key = f"{short}-{v}" if "." in v else f"{short}-{v}.0"
            full = " ".join(f"GNU {name} General Public License".split())
            out[key] = f"This work is licensed under the {full}, version {v}"
            out[f"{key}-notice"] = (f"This program is free software: you can redistribute it and/or modify it under the terms of the {full} "
                                    f"as published by the Free Software Foundation, either version {v} of the License, or (at your "
                                    "option) any later version")
    for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                        ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for v, place in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            for spelled, key in {re.sub("(?<=[a-z])(?=[A-Z])", "-", name): "-spaced", name: ""}.items():
                out[f"CC-{short}-{v}{key}"] = f"This work is licensed under a Creative Commons {spelled} {v} {place} License"
            out[f"CC-{short}-{v}-short"] = f"Licensed under CC {short} {v}"
    # the two notices that have long been known by the plain name
    out["CC-BY-NC-4.0-long"], out["CC-BY-NC-4.0"] = out.pop("CC-BY-NC-4.0"), out.pop("CC-BY-NC-4.0-short")
    for spdx in ("Apache-2.0", "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-1.1", "MPL-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0",
                 "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
                 "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-ND-4.0"):
        out[f"{spdx}-tag"] = f"SPDX-License-Identifier: {spdx}"
    return out


_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
              "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
              "the Software, and to permit persons to whom the Software is furnished to do so")
_BSD_DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                   "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
                   "A PARTICULAR PURPOSE ARE DISCLAIMED")
_BSD_REST = (" IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
             "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
             "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
             "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
             "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_GRANT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
              "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
              "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
              "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
              "distribution. ")
_BSD_THIRD = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission. ")


def _texts() -> dict[str, str]:
    """Full texts: the short ones here, the long ones from the files beside this module (read on the driver)."""
    out = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files("clusterlens.llm").joinpath("license_texts").iterdir()
           if f.name.endswith(".txt")}
    out["MIT"] = (_MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be "
                  "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
                  "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
                  "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
                  "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
                  "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
    out["BSD-2-Clause"] = _BSD_GRANT + _BSD_DISCLAIMER + "." + _BSD_REST
    out["BSD-3-Clause"] = _BSD_GRANT + _BSD_THIRD + _BSD_DISCLAIMER + "." + _BSD_REST
    out["ISC"] = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                  "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
                  "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
                  "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
                  "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
                  "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
                  "PERFORMANCE OF THIS SOFTWARE.")
    return {f"{k}-text": v for k, v in out.items()}


TEMPLATES = {**_notices(), **_texts()}

#: Words that tell licenses apart.
NAMES = frozenset(b"""affero agpl alike apache artistic bsd cc cc0 commercial commons creative derivatives derivs gnu gpl isc lesser lgpl
library mit mozilla mpl nc nd noderivatives noderivs noncommercial sa sampling sharealike spdx""".split())

#: Letters and digits make words; all other ASCII separates; bytes over 127 belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """One number for each run of k word codes; -1 if one of them is in no template."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.int64)
    known = np.ones(n, bool)
    for i in range(k):
        part = codes[i:i + n]
        h = h * 1_000_003 + part + 1
        known &= part >= 0
    h = (h ^ (h >> 29)) * 0x1F83D9ABFB41BD6B & 0x7FFFFFFFFFFFFFFF
    return np.where(known, h, -1)


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest gram of each window (the last one of equals)."""
    if not len(grams):
        return np.zeros(0, np.int64)
    w = min(window, len(grams))
    view = np.lib.stride_tricks.sliding_window_view(grams, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(axis=1))


class TemplateIndex:
    """Inverted index: fingerprint -> (template, place). Bounded by the templates given."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.names, self.gram = sorted(templates), gram
        self.vocabulary: dict[bytes, int] = {}
        self.codes = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(templates[n].encode())], np.int64)
                      for n in self.names]
        for w in sorted(NAMES):  # also those that no template has: in a text they tell it from the templates
            self.vocabulary.setdefault(w, len(self.vocabulary))
        rows = sorted((int(g), t, int(p)) for t, c in enumerate(self.codes)
                      for g, p in ((gs[p], p) for gs in [_grams(c, gram)] for p in winnow(gs, window)))
        self.prints = np.array([r[0] for r in rows], np.int64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)

        self.printed = np.bincount(self.template, minlength=len(self.names))
        named = [(c, w) for w, c in self.vocabulary.items() if w in NAMES or w.isdigit()]
        self.telling = np.array(sorted(c for c, _ in named), np.int64)
        self.numbers = np.array(sorted(c for c, w in named if w.isdigit()), np.int64)
        self.own = [self.marks(c, len(c)) for c in self.codes]

    def marks(self, codes: np.ndarray, length: int):
        """What tells licenses apart among ``codes``, for a template of ``length`` words.

        For a notice its names and numbers in their order, for a longer template the number of each name.
        """
        told = codes[np.isin(codes, self.telling)]
        if length <= NOTICE_WORDS:
            return told
        return np.bincount(told[~np.isin(told, self.numbers)], minlength=len(self.vocabulary))

    def same_marks(self, t: int, codes: np.ndarray, coverage: float) -> bool:
        """Whether a stretch of text has the marks of a template; in longer ones each name as often, but for ``1 - coverage``."""
        own, there = self.own[t], self.marks(codes, len(self.codes[t]))
        if len(self.codes[t]) <= NOTICE_WORDS:
            return np.array_equal(own, there)
        return bool((np.abs(own - there) <= (1 - coverage) * np.maximum(own, there)).all())

    def edits(self, t: int, coverage: float) -> int:
        """Words that may be missing, added or exchanged in a text of the template."""
        return int((1 - coverage) * len(self.codes[t]) + 1e-9)

    def drift(self, t: int, band: int, coverage: float = COVERAGE) -> int:
        """The band for one template; shorter than the template, so that repeated notices stay apart."""
        return min(max(band, self.edits(t, coverage)), max(1, len(self.codes[t]) // 3))

    def candidates(self, codes: np.ndarray, band: int, coverage: float = COVERAGE) -> list[tuple[int, int, int]]:
        """(template, word of the text at which it would begin, least number of edits) of each place with like diagonals.

        All grams of the text are looked up; hits of a template whose diagonals differ by at most the band are one. An
        edit spoils at most ``gram`` fingerprints, so an acceptable place keeps all but those within the band.
        """
        grams = _grams(codes, self.gram)
        at = np.flatnonzero(grams >= 0)
        if not len(at):
            return []
        lo = np.searchsorted(self.prints, grams[at], "left")
        n = np.searchsorted(self.prints, grams[at], "right") - lo
        at = np.repeat(at, n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        span = 2 * (len(codes) + max(map(len, self.codes))) + 1
        keys, hits = np.unique(self.template[entry] * span + (at - self.place[entry]) + span // 2, return_counts=True)
        total = np.append(0, np.cumsum(hits))
        need = np.array([max(1, self.printed[t] - self.gram * self.edits(t, coverage)) for t in range(len(self.names))])
        drift = np.array([self.drift(t, band, coverage) for t in range(len(self.names))])
        near = (total[np.searchsorted(keys, keys + drift[keys // span], "right")]
                - total[np.searchsorted(keys, keys - drift[keys // span], "left")])
        enough = near >= need[keys // span]
        out: list[tuple[int, int]] = []
        first, most, firsts = (-1, 0), 0, []
        for t, diagonal, n in zip((keys[enough] // span).tolist(), (keys[enough] % span - span // 2).tolist(), hits[enough].tolist()):
            if first[0] != t or diagonal - first[1] > drift[t]:
                first, most = (t, diagonal), n
                firsts.append(first)
            elif n > most:  # the diagonal with most fingerprints stands for those within the band
                most, firsts[-1] = n, (t, diagonal)
        order = np.argsort(self.template[entry], kind="stable")
        sorted_t, place, diagonals = self.template[entry][order], self.place[entry][order], (at - self.place[entry])[order]
        out = []
        for t, begin in firsts:
            own = slice(*np.searchsorted(sorted_t, [t, t + 1]))
            kept = len(np.unique(place[own][np.abs(diagonals[own] - begin) <= drift[t]]))
            if kept >= need[t]:
                out.append((t, begin, max(0, -(-(int(self.printed[t]) - kept) // self.gram))))
        return out


def _strip(text: np.ndarray, begin: int, rows: int, band: int) -> np.ndarray:
    """The text from ``begin - band`` on as far as a band of ``rows`` rows sees it; -1 outside the text."""
    out = np.full(rows + 2 * band, -1, np.int64)
    a, b = max(begin - band, 0), min(begin + rows + band, len(text))
    if a < b:
        out[a - begin + band:b - begin + band] = text[a:b]
    return out


def edit_distance(text: np.ndarray, template: np.ndarray, begin: int, band: int, limit: int) -> int:
    """Fewest words to take out, put in or exchange to make some stretch of the text near ``begin`` the template.

    Drifts by at most ``band`` words; more than ``limit`` is given as ``limit + 1``.
    """
    width = 2 * band + 1
    ramp = np.arange(width)
    strip = _strip(text, begin, len(template), band)
    cost = np.zeros(width, np.int64)               # by drift, as in ``align``; the stretch may begin anywhere in the band
    for i, word in enumerate(template):
        new = cost + (strip[i:i + width] != word)
        np.minimum(new[:-1], cost[1:] + 1, out=new[:-1])
        cost = np.minimum.accumulate(new - ramp) + ramp
        if not i % 64 and cost.min() > limit:
            return limit + 1
    return min(int(cost.min()), limit + 1)


def align(text: np.ndarray, template: np.ndarray, begin: int, band: int) -> tuple[int, int, int]:
    """Longest common subsequence of the template with the text from ``begin``, drifting by at most ``band`` words.

    Returns matched words, and the first and the end (exclusive) of the text words that match.
    """
    width = 2 * band + 1
    ramp = np.arange(width)
    strip = _strip(text, begin, len(template), band)
    score = np.zeros(width, np.int64)              # by drift: text place = begin + template place + drift - band
    start = np.full(width, -1, np.int64)
    end = np.full(width, -1, np.int64)
    for i, word in enumerate(template):
        at = begin + i - band + ramp
        fits = strip[i:i + width] == word
        new, new_start, new_end = score.copy(), start.copy(), end.copy()
        new[fits] += 1
        new_end[fits] = at[fits] + 1
        new_start[fits] = np.where(start[fits] < 0, at[fits], start[fits])
        # skip the template word: drift grows by one relative to the text already used
        up = np.append(score[1:], -1)
        better = up > new
        new, new_start, new_end = (np.where(better, np.append(x[1:], -1), y) for x, y in ((score, new), (start, new_start), (end, new_end)))
        # skip text words: the last drift up to here with the best score
        last = np.maximum.accumulate(np.where(new == np.maximum.accumulate(new), ramp, 0))
        score, start, end = new[last], new_start[last], new_end[last]
    best = int(score.argmax())
    return int(score[best]), int(start[best]), int(end[best])


def scan_text(text: bytes, index: TemplateIndex, coverage: float, band: int) -> list[tuple[str, float, int, int]]:
    """(license, matched share, first word, end word) of every accepted alignment, by first word, then license.

    Accepted are alignments that match ``coverage`` of the template's words with no more edits than the rest, and whose
    names and numbers are the template's. Of alignments that overlap in the text, of whatever license, the one with most
    matched words less edits stays (ties: fewer edits, the earlier, the name).
    """
    tokens = words(text)
    get = index.vocabulary.get
    codes = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
    found = []
    best_first = sorted(index.candidates(codes, band, coverage), key=lambda c: (c[2] - len(index.codes[c[0]]), c))
    for t, begin, least in best_first:
        template, drift, limit = index.codes[t], index.drift(t, band, coverage), index.edits(t, coverage)
        low, high, room = begin - drift, begin + len(template) + drift, len(template) - limit
        most = least - len(template)
        if any((f[0] < most or f[0] == most and f[3] == index.names[t]) and f[2] - low < room and high - f[5] < room for f in found):
            continue  # whatever is found here overlaps a better one
        near = min(START_BAND, drift)
        while (edits := edit_distance(codes, template, begin, near, limit)) > near and near < drift:
            near = min(4 * near, drift)  # a text with few edits is settled in a narrow band
        if edits > limit:
            continue
        matched, a, b = align(codes, template, begin, near)
        share = matched / len(template)
        if share >= coverage and index.same_marks(t, codes[a:b], coverage):
            found.append((edits - matched, edits, a, index.names[t], share, b))
    kept: list[tuple[str, float, int, int]] = []
    for _, _, a, name, share, b in sorted(found):
        if not any(k[2] < b and a < k[3] for k in kept):
            kept.append((name, share, a, b))
    return sorted(kept, key=lambda f: (f[2], f[0]))


def find_licenses(df: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None,
                  coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """``df`` with ``licenses``: array of (license, coverage, start, end); word numbers, end exclusive.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Every gram of the whole text is looked up in the
    index of winnowed template fingerprints; each candidate place is aligned within a band, and kept if the alignment
    matches at least ``coverage`` of the template's words with no more edits than the rest allows, and shows the names and
    numbers that tell the license from others. Null and empty texts have none. The templates bound what is
    sent to tasks. Rows are kept one to one; an input column ``licenses`` is replaced; an empty table gives an empty
    result.
    """
    index = TemplateIndex(templates or TEMPLATES)
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "licenses"])
    columns = kept.columns
    column = columns.index(text_col)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(("license", "coverage", "start", "end"), f))
                     for f in scan_text((t.as_py() or "").encode(), index, coverage, band)] for t in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*columns, "licenses"])

    schema = kept.select(*columns, F.expr(
        "cast(array() as array<struct<license:string,coverage:double,start:int,end:int>>)").alias("licenses")).schema
    return kept.mapInArrow(run, schema)


def summary(found: DataFrame) -> DataFrame:
    """Best license (largest coverage, then earliest), its coverage, the number of spans and all spans as text."""
    best = F.sort_array(F.transform("licenses", lambda x: F.struct(
        (-x["coverage"]).alias("c"), x["start"].alias("s"), x["license"].alias("license"))))
    return attach(found, {
        "license": F.get(best, F.lit(0))["license"], "coverage": F.coalesce(-F.get(best, F.lit(0))["c"], F.lit(0.0)),
        "n_spans": F.size("licenses").cast("long"),
        "spans": F.array_join(F.transform("licenses", lambda x: F.concat_ws(
            ":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")}).drop("licenses")
