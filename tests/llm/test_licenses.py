import random

from vacantis.llm.licenses import MORE_TEMPLATES, SHORT_NAMES, TEMPLATES, Scanner, notices, patience, words_of


def test_patience_is_an_alignment():
    r = random.Random(9)
    for _ in range(400):
        a = [r.choice("abcdefghij") for _ in range(r.randrange(15))]
        b = [r.choice("abcdefghijk") for _ in range(r.randrange(20))]
        p = patience(a, b)
        assert all(a[i] == b[j] for i, j in p)
        assert all(x < x2 and y < y2 for (x, y), (x2, y2) in zip(p, p[1:]))
    unique = list("abcdefghij")
    moved = list("xabyczdqehij")
    assert [unique[i] for i, _ in patience(unique, moved)] == list("abcdehij")  # the longest run of unique words
    assert patience(unique, unique) == [(i, i) for i in range(10)]


def test_every_template_is_found_with_edits(spark, docs_of):
    r = random.Random(10)
    rows, want = [], set()
    for t, (name, _, text) in enumerate(TEMPLATES):
        w = text.split()
        edited = [x if r.random() > 0.06 or len(w) < 12 else "zzz" for x in w]
        rows.append("foo bar. " * 50 + " ".join(edited).upper() + "\n" + "baz " * 40)
        want.add((len(rows) - 1, t))
    rows.append("x " + TEMPLATES[-1][2] + " y " * 30 + TEMPLATES[-1][2] + " all the rights are his, reserved or not")
    rows += [None, "", " ".join(words for words in ["the", "license", "under", "of"] * 5000)]
    got = notices(docs_of(list(enumerate(rows)))).collect()
    assert want <= {(x.doc_id, x.template) for x in got}
    assert [(x.start, x.n_words, x.coverage) for x in sorted(got, key=lambda x: x.start) if x.doc_id == len(TEMPLATES)] == [(1, 3, 1.0), (34, 3, 1.0)]
    assert not [x for x in got if x.doc_id > len(TEMPLATES)]
    assert all(x.coverage >= 0.8 for x in got)


def test_scan_equals_trying_every_stretch():
    """The prefilters lose nothing: a plain loop over all starts gives the same notices."""
    scan, r = Scanner(), random.Random(11)
    for _ in range(60):
        t = r.randrange(len(TEMPLATES))
        own = words_of(TEMPLATES[t][2].encode())
        text = [r.choice([b"foo", *own]) for _ in range(30)] + [w for w in own if r.random() > 0.12] + [r.choice(own) for _ in range(10)]
        size, at, want = max(len(own), int(1.5 * len(own))), 0, []
        for b in range(len(text)):
            if b >= at:
                p = patience(own, text[b:b + size])
                if len(p) >= scan.needed[t] and p[0][1] == 0:
                    want.append((b, p[-1][1] + 1, len(p)))
                    at = b + p[-1][1] + 1
        assert [h[1:] for h in scan(b" ".join(text)) if h[0] == t] == want


def test_odd_tables(spark, docs_of):
    assert notices(docs_of([])).collect() == []
    got = notices(docs_of([(None, "All rights reserved"), (None, "All rights reserved"), (1, "w " * 300_000)])).collect()
    assert [(x.doc_id, x.license) for x in got] == [(None, "proprietary")] * 2


def test_each_line_yields_its_own_licence_only(spark, docs_of):
    lines = {
        "Licensed under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "Licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
        "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Licensed under CC BY-ND 4.0": None, "Licensed under the Zlib License.": None,
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "Released under the licensed under the MIT License.": "MIT",
    }
    got = notices(docs_of(list(enumerate(f"foo bar. {x} baz" for x in lines)))).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(i, name) for i, name in enumerate(lines.values()) if name]


def test_families_versions_tags_and_negations(spark, docs_of):
    body = {name: text for name, _, text in TEMPLATES + MORE_TEMPLATES if len(text.split()) > 15}
    cases = [(body["BSD-3-Clause"], ["BSD-3-Clause"]), (body["BSD-2-Clause"], ["BSD-2-Clause"]), (body["GPL-2.0"], ["GPL-2.0"]), (body["GPL-3.0"], ["GPL-3.0"]),
             (body["LGPL-3.0"], ["LGPL-3.0"]), (body["LGPL-2.1"], ["LGPL-2.1"]), (body["AGPL-3.0"], ["AGPL-3.0"]), (body["Unlicense"], ["Unlicense"]), (body["Zlib"], ["Zlib"]),
             (body["CC0-1.0"], ["CC0-1.0"]), (body["BSL-1.0"], ["BSL-1.0"]), (body["EPL-2.0"], ["EPL-2.0"]),
             (body["MIT"], ["MIT"]), (body["ISC"], ["ISC"]), (body["Apache-2.0"], ["Apache-2.0"]),
             ("Licensed under the MIT License or the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]), ("Licensed under the Apache License, Version 2.0 and the MIT License.", ["Apache-2.0", "MIT"]),
             ("Not all rights reserved.", []), ("This is not licensed under the MIT License.", []), ("All rights reserved.", ["proprietary"]), ("SPDX-License-Identifier: bogus", []),
             ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"])]
    cases += [(f"// SPDX-License-Identifier: {name}\n", [name]) for name, _ in SHORT_NAMES]
    got = {}
    for r in notices(docs_of([(i, f"foo bar; {x} baz") for i, (x, _) in enumerate(cases)])).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    for i, (x, want) in enumerate(cases):
        assert sorted(got.get(i, [])) == want, (x[:60], got.get(i))
