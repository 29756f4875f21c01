"""Operators against plain versions of themselves, where a cut would lose something."""

import random
import textwrap

import pytest

pytest.importorskip("dossia.llm")
from dossia.llm import decontaminate, licenses, quality  # noqa: E402


def share(item, text):
    """Best Smith-Waterman score of two word lists as a share of a perfect one, and where it ends first, cell by cell."""
    best, end, before = 0, 0, [0] * (len(text) + 1)
    for x in item:
        now = [0]
        for k, y in enumerate(text):
            now.append(max(0, before[k] + (2 if x == y else -1), before[k + 1] - 1, now[k] - 1))
        top = max(now)
        if top and top >= best:
            end = min(now.index(top), end if top == best else len(text))
        best, before = max(best, top), now
    return best / (2 * len(item)), end


def held(spark, items, texts):
    """The matches of the operator, which must be those of all pairs."""
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.end_word) for r in decontaminate.contaminated(docs, bench).collect()}
    scores = {(d, i): share(item, text) for d, text in enumerate(texts) for i, item in enumerate(items)}
    assert got == {k: s for k, s in scores.items() if s[0] >= 0.6}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in got}
    return got


def surrounded(rng, words):
    around = [[f"o{rng.randint(0, 400)}" for _ in range(rng.randint(0, 90))] for _ in range(2)]
    return around[0] + words + around[1]


def test_decontaminate_changed_words(spark):
    """Every 4th or 5th word of a copy is another, or common words of the items are."""
    rng = random.Random(6)
    items = [[f"w{k}_{x}" if x % 3 else f"c{rng.randint(0, 6)}" for x in range(k)] for k in (1, 2, 3, 4, 5, 6, 7, 10, 20, 30, 40, 59)]
    texts = [surrounded(rng, [rng.choice(items[-1] + ["c1", "c2"]) for _ in range(60)]) for _ in range(5)]
    for item in items:
        for every in (3, 4, 5, 6):
            for first in range(0, every, 2):
                texts.append(surrounded(rng, ["x" if k % every == first else w for k, w in enumerate(item)]))
                texts.append(surrounded(rng, ["c1" if k % every == first else w for k, w in enumerate(item)]))
        texts += [surrounded(rng, item), surrounded(rng, item[: 2 * len(item) // 3]), surrounded(rng, item[len(item) // 3 :])]
    got = held(spark, items, texts)
    assert len({i for _, i in got}) == len(items)


def test_decontaminate_inserted_words(spark):
    """Words are inserted in one place, in many, or left out; copies are repeated with a few words between."""
    rng = random.Random(7)
    items = [[f"w{k}_{x}" for x in range(k)] for k in (1, 3, 6, 12, 40)]
    texts = []
    for item in items:
        half = len(item) // 2
        for more in sorted({0, 1, *(len(item) * x // 40 for x in (8, 16, 19, 20, 25, 30, 32, 33))}):
            texts.append(surrounded(rng, item[:half] + ["x"] * more + item[half:]))
            for every in (1, 2, 3):
                texts.append(surrounded(rng, [y for k, w in enumerate(item) for y in ([w, "x"] if k % every == 0 and k < more * every else [w])]))
        texts.append(surrounded(rng, [w for k, w in enumerate(item) if k % 6]))
        texts.append(surrounded(rng, [w for r in range(12) for w in (item[: half + r] + ["x"] * r + item[half + r + 1 :])]))
    got = held(spark, items, texts)
    assert len({i for _, i in got}) == len(items)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
LIABLE = """ IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
APACHE_REST = """

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software%s you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version %d of the License, or (at your option) any later version."""
GPL_REST = """

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program%s"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.%s"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_LIABLE = """ IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
OTHER_END = " IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
ISC_REST = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""


def gnu(kind, version, whole, thing="program"):
    """The notice of a GNU licence of another kind, whole or its first paragraph."""
    text = GPL % (":" if version == "3" else ";", 0)
    text = text.replace("version 0", f"version {version}").replace("GNU General", f"GNU {kind} General").replace("This program", f"This {thing}")
    return text + (GPL_REST % ".").replace("GNU General", f"GNU {kind} General").replace("This program", f"This {thing}").replace("this program", f"this {thing}") if whole else text


#: Identifiers of sentences whose rules are told by the sentences alone, a paragraph each.
ALONE = ("Zlib", "Boost", "UnlicenseFree", "CCBYSA4ref", "EPL2ref", "ISCref", "GPL2only", "LGPL2later", "tag:")
#: A public text for each other rule, in the rules' order.
PUBLIC = [
    MIT + LIABLE, MIT, MIT.split("\n\nTHE SOFTWARE")[0], ISC + ISC_REST, ISC, APACHE + APACHE_REST, APACHE, GPL % (":", 3) + GPL_REST % ".  If not, see <https://www.gnu.org/licenses/>.", GPL % (":", 3),
    GPL % (";", 2) + GPL_REST % "; if not, write to the Free Software Foundation, Inc.", GPL % (";", 2), gnu("Lesser", "3", True, "library"), gnu("Lesser", "3", False, "library"), gnu("Lesser", "2.1", True, "library"), gnu("Lesser", "2.1", False, "library"),
    gnu("Affero", "3", True), gnu("Affero", "3", False), BSD % (ENDORSE, BSD_LIABLE), BSD % (ENDORSE, OTHER_END), BSD % ("", BSD_LIABLE), BSD % ("", OTHER_END),
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "This project is licensed under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: BSD-3-Clause",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-NC 4.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "This is free and unencumbered software released into the public domain.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can ask for one.",
    "Copyright (c) 2020, Owner\n\nAll rights reserved.",
]


def wrapped(text, width, prefix, end="\n"):
    lines = [line for par in text.split("\n") for line in (textwrap.wrap(par, width, break_long_words=False) or [""])]
    return end.join((prefix + line).rstrip() for line in lines)


def test_licenses_wrapped(spark):
    """Every rule takes the whole public text, on one line a paragraph or wrapped, bare or in comments."""
    rows, want = [], {}
    of, texts = {i: s for s, i in licenses.SENTENCES.items()}, iter(PUBLIC)
    each = [(name, ids, "\n\n".join(of[i].capitalize() + "." for i in ids) if any(i.startswith(ALONE) for i in ids) or ("ApacheCopy" in ids and "ApacheURL" not in ids) else next(texts)) for name, ids in licenses.RULES]
    assert next(texts, None) is None
    for name, ids, text in each:
        for width in (10**6, 79, 50, 12):
            for prefix, end in (("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\n"), (";; ", "\n"), ("-- ", "\n"), ("REM ", "\r\n"), ("dnl ", "\n"), ("C     ", "\n"), ('.\\" ', "\n")):
                for before in ("", "First some prose.\n\n"):
                    want[len(rows)] = (name, ";".join(ids), 0)
                    rows.append((len(rows), before + wrapped(text, width, prefix, end)))
    got = {r.doc_id: (r.licenses, r.sentence_ids, r.n_unmatched) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(rows[k][1], got[k], want[k]) for k in want if got[k] != want[k]] == []


def test_licenses_left_alone(spark):
    """Sentences that only hold a known one, or are broken by an empty line, are none."""
    texts = ["It was released under the MIT License.", "Released under the MIT License in 2010.", "Released under the\n\nMIT License.", "# Released under the\n#\n# MIT License.", "Released under. The MIT License.", "Unreleased\nunder the MIT License", "." * 50000 + "licence" + " :" * 50000]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.doc_id, r.licenses) for r in got if r.n_sentences] == []


def test_near_duplicates_keep_one_row(spark):
    """One row of each component stays, with repeated and missing ids too, and the next stage keeps its text."""
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda: [f"{rng.randint(0, 10**9):09d}" for _ in range(90)]
    rows = []
    for k in range(24):
        base = text()
        near = base[:-1] + ["other"]
        ids = [[k, k], [None, None], [k, None], [k, k + 100], [k + 100, k, k], [k, k, None], [k], [None]][k % 8]
        for n, i in enumerate(ids):
            rows.append((i, " ".join(near if n and k >= 8 else base)))
    rows += [(500, " ".join(text())), (500, " ".join(text())), (None, "one  two"), (None, "One two"), (600, ""), (600, None), (None, ""), (None, " ")]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(r.n_chars for r in kept.collect())
    worded = [k for k in got if sets[k]]
    assert [k for k in got if not sets[k]] == [k for k in range(len(rows)) if not sets[k]]
    assert sorted(root[k] for k in worded) == sorted({r for r, s in zip(root, sets) if s})
    for k in worded:
        ids = [i for (i, _), r in zip(rows, root) if r == root[k] and i is not None]
        assert rows[k][0] == (min(ids) if ids else None)
    rest = corpus_pipeline.repeated_passages(spark, kept, "").collect()
    assert sorted((r.doc_id or -1, r.text) for r in rest) == sorted((rows[k][0] or -1, rows[k][1]) for k in worded)


def test_quality_base_columns(spark):
    """The base counts of random texts, against plain ones."""
    rng = random.Random(9)
    parts = ["a", "Bc", "de9", "é", "漢字", "#", "*|", "!", "?.", " ", "  ", "\t", "\n", "\n\n", "\r\n", "line of text\n", "x y z u v w "]
    texts = [None, "", " \n ", "a b c d e a b c d e"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    want = {}
    for i, t in enumerate(texts):
        t = t or ""
        words = t.encode().split()
        shown = lambda x: sum(not c.isspace() for c in x)
        lines = t.split("\n")
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        inside = {k + x for k, g in enumerate(grams) if grams.count(g) > 1 for x in range(5)}
        want[i] = (len(words), shown(t), sum(t.count(c) for c in "#*$%&|<>"), sum(shown(x) > 0 and x in lines[:k] for k, x in enumerate(lines)), len(inside))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    field = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judged(docs, field).collect()}
    assert got == want
