import re

import pytest

from stayline.llm import licenses

TEXTS = [
    None,
    "",
    "Released under the MIT License.",
    "UNDER the\nMIT, license under the mit license CC BY-NC 4.0",
    "Licensed under the Apache License, Version 2.0. Apache License Version 20",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception */",
    "SPDX-License-Identifier: MIT OR",
    "underthe mit license",
    "été under the mit licenseé",
    "word " * 40_000 + "under the mit license",
]


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    starts = [i for i, _ in places]
    return (
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
    )


def digest(found):
    base = [p for p in found.places if p.base]
    starts = [p.first_word for p in base]
    return (
        found.n_words,
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted({p.label for p in base})),
    )


def test_places_by_brute_force(rows):
    data = [(i, t, "x", 1.0) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], None, None), (None, None, None, None)]
    docs = rows(data, "doc_id long, text string, labels string, score double")
    found = licenses.scan_licenses(docs).collect()
    assert len(found) == len(data)
    for r in found:
        assert digest(r) == brute(TEXTS[r.doc_id] if r.doc_id is not None else None)
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in found}
    assert by_id[5].labels == ["apache-2", "gpl-2.0-only", "mit"]
    assert by_id[5].expressions[0].permissive
    assert not by_id[6].expressions[0].valid and by_id[6].labels == []
    assert licenses.scan_licenses(rows([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(
    ("text", "postfix", "permissive"),
    [
        ("mit", ["mit"], True),
        ("mit or gpl-2.0-only and apache-2.0", ["mit", "gpl-2.0-only", "apache-2.0", "and", "or"], True),
        ("(mit or gpl-2.0-only) and gpl-3.0-only", ["mit", "gpl-2.0-only", "or", "gpl-3.0-only", "and"], False),
        ("gpl-2.0-only with classpath-exception-2.0", ["gpl-2.0-only", "classpath-exception-2.0", "with"], False),
        ("mit */ trailing", ["mit"], True),
        ("mit)", ["mit"], True),
    ],
)
def test_expressions(text, postfix, permissive):
    assert licenses.to_postfix(licenses._TOKEN.findall(text)) == postfix
    assert licenses.evaluate(text).permissive == permissive


@pytest.mark.parametrize("text", ["", "or mit", "mit and", "(mit", "mit and or isc", "()"])
def test_what_is_no_expression(text):
    assert not licenses.evaluate(text).valid


@pytest.mark.parametrize(
    ("text", "identifiers", "unknown"),
    [
        ("see LICENSE file", [], ["see"]),
        ("foo", [], ["foo"]),
        ("MIT OR foo", ["mit"], ["foo"]),
        ("GPL-3.0-or-later WITH Bison-exception-2.2", ["gpl-3.0-or-later"], []),
        ("GPL-2.0+ WITH nothing", ["gpl-2.0+"], ["nothing"]),
        ("LGPL-2.1-only AND BSD-3-Clause", ["lgpl-2.1-only", "bsd-3-clause"], []),
        ("CC-BY-NC-SA-4.0 OR MPL-2.0 OR ISC", ["cc-by-nc-sa-4.0", "mpl-2.0", "isc"], []),
        ("LicenseRef-Own-1", ["licenseref-own-1"], []),
        ("mit-like", [], ["mit-like"]),
    ],
)
def test_names_that_are_no_licence(text, identifiers, unknown):
    found = licenses.evaluate(text)
    assert (found.valid, found.identifiers, found.unknown) == (True, identifiers, unknown)
    scanned = licenses.scan(f"SPDX-License-Identifier: {text}".encode())
    phrases = {p[0] for p in scanned.places}  # "cc by nc" is one in itself
    assert scanned.labels == sorted({licenses.SAME_LABEL.get(i, i) for i in identifiers} | phrases)
    assert scanned.score == (0.3 if unknown else 1.0)
