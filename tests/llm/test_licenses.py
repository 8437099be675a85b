"""Notices planted beside each other and in long lines, and winners against every template on every window."""

import random

from llm_helpers import prose

from obsmat.llm import licenses

KNOWN = licenses.Templates()


def found(text):
    return [(KNOWN.license[f[2][0]], text[f[0] : f[1]]) for f in KNOWN.notices(text)]


def test_neighbouring_notices_are_told_apart():
    apache = licenses.TEMPLATES["Apache-2.0 header"][1]
    assert [x for x, _ in found(apache + " Released under the MIT License.")] == ["Apache-2.0", "MIT"]
    got = found("Copyright 2021 Acme. All rights reserved. Licensed under the MIT License.")
    assert [x for x, _ in got] == ["proprietary", "MIT"] and got[1][1] == "Licensed under the MIT License."
    assert [x for x, _ in found("Code: Released under the MIT License, texts: Licensed under CC BY-SA 4.0")] == ["MIT", "CC-BY-SA-4.0"]


def test_clauses_and_versions():
    bsd3, bsd2 = licenses.TEMPLATES["BSD three conditions"][1], licenses.TEMPLATES["BSD conditions"][1]
    assert [x for x, _ in found(bsd3)] == ["BSD-3-Clause"] and [x for x, _ in found(bsd2)] == ["BSD-2-Clause"]
    for name in ("GPL-2.0 header", "GPL-3.0 header", "LGPL-3.0 header"):
        licence, text = licenses.TEMPLATES[name]
        assert [x for x, _ in found(text)] == [licence]
    assert [x for x, _ in found("see http://www.apache.org/licenses/LICENSE-2.0 for it")] == ["Apache-2.0"]


def test_a_grant_in_one_long_line_is_found():
    grant = licenses.TEMPLATES["MIT grant"][1].replace(".", "")
    text = f"{prose(900, 1)} {grant} {prose(900, 2)} released under the MIT License {prose(500, 3)}"
    got = found(text)
    assert [x for x, _ in got] == ["MIT", "MIT"] and len(got[0][1]) > 0.9 * len(grant) and got[1][1] == "released under the MIT License"


#: Notices that aren't made from the templates.
REFERENCES = {
    "SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "Released under the GPL, version 3.": "GPL-3.0", "licensed under GPLv3 or later": "GPL-3.0-or-later",
    "Licensed under the Boost Software License, Version 1.0.": "BSL-1.0", "Distributed under the Eclipse Public License 2.0.": "EPL-2.0", "Licensed under the EUPL, version 1.2.": "EUPL-1.2",
    "Released under the Unlicense.": "Unlicense", "This work is available under CC BY-SA 4.0.": "CC-BY-SA-4.0", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
    "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "You may use it under the terms of the GNU LGPL version 2.1.": "LGPL-2.1", "Data are shared under a CC BY-NC-ND 4.0 licence.": "CC-BY-NC-ND-4.0",
    "Everything here is made available under the terms of the GNU Affero General Public License v3 or any later version.": "AGPL-3.0-or-later", "Code under MPL 2.0, see COPYING.": "MPL-2.0", "It is free to use under the ISC License": "ISC",
}


def test_tags_and_names():
    for text, licence in REFERENCES.items():
        for around in ("{}", "Some prose here today.\n{}\nAnd more.", "Some prose here today. {} And more of it."):
            assert [x for x, _ in found(around.format(text))] == [licence], (around, text)


def test_other_licences_and_plain_words_are_not_named():
    for text in ("Released under the GPL, version 4.", "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: GPL-2.0+", "under the Software License, Version 1.0.", "We met under the MIT dome.", "Sie fuhr mit dem Bus.", "under CC BY-SA 3.0", "under the Eclipse we saw stars", "SPDX documents list packages."):
        assert found(text) == [], text


def by_brute_force(block):
    """The best of all templates by wording alone, without compression."""
    best = None
    for name, words in KNOWN.words.items():
        missing, extra, said, *_ = KNOWN.differences(name, block)
        other = any(w[1:] in licenses.DECISIVE or any(ch.isdigit() for ch in w) for w in said)
        if not missing + extra or (not other and missing + extra <= 0.15 * len(words)):
            key = ((missing + extra) / len(words), -len(words))
            best = min(best, (key, KNOWN.license[name])) if best else (key, KNOWN.license[name])
    return best and best[1]


def test_compression_ranks_no_winner_out():
    """Recall over notices with changed words, in all blocks: what compression lets through against every template."""
    rng, hits, n = random.Random(3), 0, 0
    for name, words in KNOWN.words.items():
        for change in range(6):
            block = [w if w != "{}" else "jo" for w in words]
            for _ in range(change * len(block) // 40):
                block[rng.randrange(len(block))] = rng.choice(["any", "our", "these"])
            block = prose(rng.randrange(6), change).split() + block + prose(rng.randrange(6), 9).split()
            want = by_brute_force(block)
            got = KNOWN.classify(tuple(block))
            n += want is not None
            hits += want is not None and got is not None and KNOWN.license[got[0]] == want
            assert want is not None or got is None, name
    assert n > 120 and hits >= 0.98 * n


def test_recall_of_planted_notices():
    rng, hits, n = random.Random(5), 0, 0
    for name, (licence, text) in licenses.TEMPLATES.items():
        for k in range(4):
            plant = text.format(2020, "Jo Doe")
            sep = rng.choice(["\n", " ", ". ", "\n\n"])
            whole = prose(rng.randrange(5, 60), k) + sep + plant + sep + prose(rng.randrange(5, 60), k + 50)
            n += 1
            hits += licence in [x for x, _ in found(whole)]
    assert hits >= 0.9 * n, (hits, n)
