from tests.llm.conftest import ODD

from blockloom.llm.licences import CC_FORMS, MARKS, RULES, SENTENCES, known_sentences, licences

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def found(docs_of, *texts):
    rows = licences(docs_of([(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    return [list(r.licences) for r in rows]


def test_rules(spark, docs_of):
    texts = [
        "Words.\nLicensed under the Apache License, Version 2.0.",
        "Words without an end\nLicensed under CC BY-NC 4.0. More words.",
        MIT,
        "All rights reserved. Released under the MIT License.",
        "Licensed  UNDER the\tapache license - version 2.0!",
        "We are licensed to sell; the MIT License is mentioned in passing here.",
        "This work is licensed under the GNU General Public License, version 3.\nThis work is licensed under the GNU General Public License, version 3.",
    ]
    assert found(docs_of, *texts) == [["Apache-2.0"], ["CC-BY-NC-4.0"], ["MIT"], ["MIT", "LicenseRef-all-rights-reserved"], ["Apache-2.0"], [], ["GPL-3.0-only"]]


def test_longer_rule_first(spark, docs_of):
    bsd = [SENTENCES[i][0] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")]
    assert found(docs_of, " ".join(bsd), " ".join(bsd[:3])) == [["BSD-3-Clause"], ["BSD-2-Clause"]]


def test_every_form_has_a_mark():
    assert all(any(m in form.lower() for m in MARKS) for listed in SENTENCES.values() for form in listed)
    assert all(any(m in form.lower() for m in MARKS) for form in CC_FORMS)


GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""


def test_standard_headers(docs_of):
    assert found(docs_of, GPL3, MPL, APACHE) == [["GPL-3.0-or-later"], ["MPL-2.0"], ["Apache-2.0"]]


def test_every_rule_is_found_in_its_own_text(docs_of):
    """Each rule's sentences, in each of their forms, one after the other, in lines and wrapped, name the rule's licence."""
    texts, want = [], []
    for licence, ids in RULES:
        for k in range(max(len(SENTENCES[i]) for i in ids)):
            parts = [SENTENCES[i][min(k, len(SENTENCES[i]) - 1)] for i in ids]
            whole = "Some words.\n" + "\n\n".join(parts) + "\n\nOther words."
            for text in (whole, whole.replace(" the ", " the\n  ")):
                texts.append(text)
                want.append(licence)
    got = found(docs_of, *texts)
    wrong = [(w, g, t) for w, g, t in zip(want, got, texts) if w not in g]
    assert not wrong, wrong


def test_wrapped_only_sentence(spark, docs_of):
    texts = [
        "Words. Released\nunder CC BY 4.0. More.",
        "Released  under CC BY-SA 3.0.",
        "Released\tunder CC0 1.0.",
        "RELEASED\u00a0under CC BY 2.0.",
        "This work is released into the public\n  domain under CC0 1.0.",
        "This work is released into the public - domain under CC0 1.0.",
    ]
    assert found(docs_of, *texts) == [["CC-BY-4.0"], ["CC-BY-SA-3.0"], ["CC0-1.0"], ["CC-BY-2.0"], ["CC0-1.0"], ["CC0-1.0"]]
    assert all(m.isalnum() for m in MARKS)


def test_every_form_in_every_wrapping(spark, docs_of):
    known = sorted(known_sentences())
    for gap in ("\n", "  ", "\u00a0", " \r\n\t"):
        # A mark before each, as a piece of a sentence need not hold one.
        rows = licences(docs_of([(i, "Licence.\n" + s.replace(" ", gap), "s") for i, s in enumerate(known)])).orderBy("doc_id").collect()
        assert [known_sentences()[s] in r.sentence_ids for s, r in zip(known, rows, strict=True)] == [True] * len(known)


def test_odd_rows(spark, docs_of):
    assert [r.licences for r in licences(docs_of(ODD)).collect()] == [[]] * len(ODD) and licences(docs_of([])).collect() == []
