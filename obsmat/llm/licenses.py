"""License scans by conditional compression.

Candidate blocks (sentences with a licence cue, and runs of neighbouring sentences in licence vocabulary) are compressed
alone and with each template as a raw zstandard dictionary; templates are ranked by how much smaller they make the block,
and those that do not make it larger (a notice of a few words has nothing to save) are confirmed by their exact wording differences. Sentences much longer than any template
are searched in windows around their cues. Texts without a cue never leave the JVM; nothing is
shuffled; a worker remembers what it found for a block, so a notice that stands in a third of all documents is cheap.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wording of common public licence notices, {} standing for a year or a holder.
TEMPLATES = {
    "Apache-2.0 short": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "Apache-2.0 header": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "MIT short": ("MIT", "Released under the MIT License."),
    "MIT licensed": ("MIT", "Licensed under the MIT License."),
    "MIT used": ("MIT", "This project uses the MIT license."),
    "Apache-2.0 address": ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT grant": ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    "BSD three conditions": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "BSD conditions": ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "ISC grant": ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "GPL-3.0 short": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "GPL-2.0 short": ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    "LGPL-3.0 short": ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "AGPL-3.0 short": ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    "GPL-2.0 header": ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-3.0 header": ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-3.0 header": ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MPL-2.0 header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0 short": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "CC-BY-SA-4.0 short": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0 short": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "CC-BY-ND-4.0 short": ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    "CC-BY-NC-SA-4.0 short": ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    "CC-BY-4.0 long": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0 long": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0 long": ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0 short": ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "All rights reserved": ("proprietary", "All rights reserved."),
    "Copyright line": ("proprietary", "Copyright {} {}. All rights reserved."),
}
#: Names by which licences are referred to, as in "released under the terms of the ISC License".
NAMES = {
    "Apache-2.0": ("Apache License 2.0", "Apache License version 2.0", "Apache 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License version 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License version 2.0", "EPL 2.0"),
    "EUPL-1.2": ("EUPL 1.2", "EUPL version 1.2", "EUPL v1.2"),
    "ISC": ("ISC License",),
    "MIT": ("MIT License", "Expat License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License version 2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}
#: Families whose names follow a rule, with their versions.
GNU = {"GPL": ("GNU General Public License", ("2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}
CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")


def referred() -> dict[str, tuple[str, str]]:
    """Templates for tags and for bare names: "under", at most four words, and a name."""
    names = {k: list(v) for k, v in NAMES.items()} | {f"CC-{k}-4.0": [f"CC {k} 4.0"] for k in CC}
    tags = {k: [k] for k in names}
    for short, (long, versions) in GNU.items():
        for v in versions:
            forms, full = [f"{short} version {v}", f"GNU {short} version {v}", f"{short}v{v}", f"{long} version {v}", f"{long} v{v}"], f"{short}-{v if '.' in v else v + '.0'}"
            names |= {full: forms, f"{full}-or-later": [f"{f} or {{}} later" for f in forms]}
            tags |= {full: [full, f"{full}-only"], f"{full}-or-later": [f"{full}-or-later"]}
    return {f"{k} name {i}": (k, f"under {{}} {n}") for k, ns in names.items() for i, n in enumerate(ns)} | {f"{k} tag {i}": (k, f"SPDX-License-Identifier: {n}") for k, ns in tags.items() for i, n in enumerate(ns)}


TEMPLATES |= referred()
_HEADS = sorted({n.lower().split()[0] for ns in NAMES.values() for n in ns} | {"cc", "gnu"} | {f"{s.lower()}{v}" for s, (_, vs) in GNU.items() for v in ("", *(f"v{x}" for x in vs))})
CUE = r"(?i)licen[cs]e|copyright|rights reserved|public domain|permission (?:is hereby|to use)|redistribution|creative commons|free software|spdx|\bunder (?:[^ \n]+ ){0,4}?(?:" + "|".join(map(re.escape, _HEADS)) + r")\b"
_CUE = re.compile(CUE)
_GOES_ON = re.compile(r"-\w|\+")
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*|\{\}", re.UNICODE)
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?:;](?<!dentifier:)(?=[ \t\r]+\S)|(?=\n)|\Z)", re.UNICODE)
#: Words that name another licence if they differ.
DECISIVE = frozenset("nc nd sa by cc0 mit apache gnu lesser affero general mozilla bsd isc noncommercial noderivatives sharealike not no spdx only later gpl lgpl agpl gplv2 gplv3 lgplv3 agplv3 boost eclipse epl eupl mpl unlicense zlib expat".split())
SCHEMA = "doc_id long, start long, end long, template string, license string, reduction double, verdict string, missing long, extra long, differences string"


def decides(word: str) -> bool:
    return word in DECISIVE or any(ch.isdigit() for ch in word)


def normal(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Templates:
    def __init__(self, templates=None, level: int = 12):
        templates = templates or TEMPLATES
        self.words = {n: normal(t) for n, (_, t) in templates.items()}
        self.license = {n: i for n, (i, _) in templates.items()}
        self.vocabulary = {w for ws in self.words.values() for w in ws}
        self.longest = max(map(len, self.words.values()))
        plain = {"level": level, "write_content_size": False, "write_checksum": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        self.given = {n: zstandard.ZstdCompressor(**plain, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, w in self.words.items()}
        self.classify = lru_cache(maxsize=50_000)(self._classify)

    def ranked(self, block: list[str]) -> list[tuple[float, str]]:
        """(share by which the template as dictionary makes the block smaller, template), the best first."""
        raw = " ".join(block).encode()
        base = len(self.alone.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / base, n) for n, c in self.given.items()), key=lambda x: (-x[0], x[1]))

    def differences(self, name: str, block: list[str]) -> tuple[int, int, list[str], int, int]:
        """(words of the template that are missing, words between its first and last that aren't its own, the differences, first
        and last + 1 of the block's words that match), near the longest run of words that both have."""
        want = self.words[name]
        match = SequenceMatcher(None, want, block, autojunk=False)
        core = match.find_longest_match()
        if not core.size:
            return len(want), 0, [f"-{w}" for w in want], 0, 0
        lo = max(0, core.b - core.a - core.a // 5 - 4)
        near = block[lo : core.b + (len(want) - core.a) * 6 // 5 + 4]
        match.set_seq2(near)
        ops = match.get_opcodes()
        inner = [i for i, o in enumerate(ops) if o[0] == "equal"]
        missing, extra, said = 0, 0, []
        for i, (kind, a, b, c, d) in enumerate(ops):
            if kind == "equal":
                continue
            gone, new = [w for w in want[a:b] if w != "{}"], near[c:d] if inner[0] < i < inner[-1] else []
            new = new[4 * (b - a - len(gone)) :]  # a slot takes up to four words
            missing, extra = missing + len(gone), extra + len(new)
            said += [f"-{w}" for w in gone] + [f"+{w}" for w in new]
        return missing, extra, said, lo + ops[inner[0]][3], lo + ops[inner[-1]][4]

    def _classify(self, block: tuple[str, ...], tolerance: float = 0.15):
        """The confirmed winner for a block, of all templates that do not make it larger: (template, reduction, verdict, missing, extra,
        differences, first and last + 1 of its words), or None."""
        best, here = None, set(block)
        for gain, name in self.ranked(list(block)):
            if gain < 0:
                break
            n = len(self.words[name])
            absent = [w for w in self.words[name] if w not in here and w != "{}"]
            if len(absent) > tolerance * n or any(map(decides, absent)):
                continue  # these are missing wherever the rest stands
            missing, extra, said, first, last = self.differences(name, list(block))
            other = any(decides(w[1:]) for w in said)
            if missing + extra and (other or missing + extra > tolerance * n):
                continue
            key = ((missing + extra) / n, -n, -gain, name)
            if best is None or key < best[0]:
                best = (key, (name, gain, "modified" if missing + extra else "exact", missing, extra, " ".join(said), first, last))
        return best and best[1]

    def notices(self, text: str) -> list[tuple]:
        """(start, end, classification) of the notices of a text, in order. Of nested blocks the larger confirmed one stays."""
        parts = []
        for m in _SENTENCE.finditer(text):
            if m[0].strip():
                spans = [(m.start() + x.start(), m.start() + x.end()) for x in _WORD.finditer(m[0])]
                parts.append((spans, [text[a:b].lower() for a, b in spans], bool(_CUE.search(m[0]))))
        native = [cue or (len(w) > 0 and sum(x in self.vocabulary for x in w) >= 0.7 * len(w)) for _, w, cue in parts]
        found, i = [], 0
        while i < len(parts):
            if not native[i]:
                i += 1
                continue
            j = i
            while j < len(parts) and native[j]:
                j += 1
            if any(p[2] for p in parts[i:j]):
                found += self._in_run(text, parts[i:j])
            i = j
        return sorted(found, key=lambda f: f[:2])

    def _piece(self, text: str, spans: list, words: list) -> list[tuple]:
        """A run's part of some words of a sentence, if a cue stands among them."""
        return [(spans, words, True)] if spans and _CUE.search(text, spans[0][0], spans[-1][1]) else []

    def _windows(self, text: str, part: tuple) -> list[tuple]:
        """The parts of a run with long sentences, as many words around each cue as the longest template has; windows that meet are one."""
        spans, words, _ = part
        reach, starts, out = self.longest + 8, [a for a, _ in part[0]], []
        for m in _CUE.finditer(text, spans[0][0], spans[-1][1]):
            at = bisect_right(starts, m.start()) - 1
            lo, hi = max(0, at - reach), min(len(words), at + reach)
            if out and lo <= out[-1][1] and hi - out[-1][0] <= 4 * reach:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
        return [(spans[a:b], words[a:b], True) for a, b in out]

    def _in_run(self, text: str, parts: list[tuple]) -> list[tuple]:
        """Groups of neighbouring sentences are tried from the longest that a template can fill down to single ones. A notice ends
        where its words do: what stands before and after it in its sentences is searched too."""
        limit = 1.3 * self.longest + 8
        if any(len(p[1]) > 2 * limit for p in parts):
            parts = self._windows(text, ([s for p in parts for s in p[0]], [w for p in parts for w in p[1]], True))
        out, i = [], 0
        while i < len(parts):
            j, n = i, 0
            while j < len(parts) and (j == i or n + len(parts[j][1]) <= limit):
                n += len(parts[j][1])
                j += 1
            for k in range(j, i, -1):
                block = tuple(w for p in parts[i:k] for w in p[1])
                if not any(p[2] for p in parts[i:k]) or not (got := self.classify(block)):
                    continue
                if k > i + 1 and len(self.words[got[0]]) <= max(len(p[1]) for p in parts[i:k]):
                    continue
                spans, (first, last) = [s for p in parts[i:k] for s in p[0]], got[6:]
                end = spans[last - 1][1]
                if self.words[got[0]][0] == "spdx" and _GOES_ON.match(text, end):
                    continue  # another identifier that begins like this one
                out.append((spans[first][0], end + (text[end : end + 1] in tuple(".!?")), got[:6]))
                before, at = [], 0
                for p in parts[i:k]:  # whole sentences and parts of sentences before the notice's first word
                    cut = min(max(first - at, 0), len(p[1]))
                    before += [p] if cut == len(p[1]) else self._piece(text, p[0][:cut], p[1][:cut])
                    at += len(p[1])
                if any(p[2] for p in before):
                    out += self._in_run(text, before)
                after, at = [], 0
                for p in parts[i:k]:
                    cut = min(max(last - at, 0), len(p[1]))
                    after += [p] if cut == 0 else self._piece(text, p[0][cut:], p[1][cut:])
                    at += len(p[1])
                parts[i:k] = after
                break
            else:
                i += 1
        return out


_made: dict = {}


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """A row for each confirmed notice: doc_id, start and end (code points), template, license, reduction, verdict (exact or
    modified), missing, extra, differences. Texts without one have no row: null and empty ones, and an empty table.
    Repeated rows are scanned each; null doc_ids stay null; very long texts are read whole, sentence by sentence. Of templates
    that fit alike the longest is named. A notice is confirmed if at most 15 % of its template's words are missing or added (`tolerance`),
    none of them a number or a word that names another licence; templates that make a block larger are not looked at. Words inside a notice are its own: notices never overlap.
    """

    def each(batches):
        key = None if templates is None else tuple(sorted(templates.items()))
        known = _made.setdefault(key, Templates(templates))
        for b in batches:
            rows = [(doc_id, s, e, name, known.license[name], gain, verdict, missing, extra, said) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, e, (name, gain, verdict, missing, extra, said) in known.notices(text or "")]
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.where(F.col("text").rlike(CUE)).mapInArrow(each, SCHEMA)
