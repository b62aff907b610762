"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences twice: with every line break as an end, and with lines joined (for wrapped licence
texts). Known sentences are written down as they are usually printed and cut by the same rule, so one that is printed
with a colon or "v. 2.0." inside is known by its pieces. Normalised pieces that are known get their identifier; the others are left out. The sequence of identifiers is
then read by ordered rules: a rule that finds its identifiers one after the other names a licence and uses them up, so
a longer rule goes before those it contains.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, by identifier.
SENTENCES = {
    "all-rights": ["All rights reserved."],
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "The MIT License (MIT)", "MIT License"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-notice-kept": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is-mit": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "liability-mit": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "mit0-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'
    ],
    "isc-notice": ["ISC License", "Released under the ISC License.", "Licensed under the ISC License."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "as-is-isc": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "bsd2-notice": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License."],
    "bsd3-notice": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd-names": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-liability": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-free-only": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."],
    "gpl-free2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "lgpl-notice": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-notice": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl21-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-notice": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-named": ["Licensed under the Mozilla Public License, Version 2.0.", "Mozilla Public License Version 2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "mpl11-notice": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");'],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0", "Licensed under the Eclipse Public License, Version 2.0.", "Eclipse Public License - v 2.0"],
    "epl1-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", "Eclipse Public License - v 1.0"],
    "cddl-notice": ["The contents of this file are subject to the terms of the Common Development and Distribution License.", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"],
    "artistic2-notice": ["Licensed under the Artistic License 2.0.", "The Artistic License 2.0"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "psf2-notice": ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2", "Licensed under the Python Software Foundation License, Version 2."],
    "ofl-notice": ["This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007"],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "wtfpl-notice": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"],
    "eupl-notice": ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0-notice": ["Released under CC0 1.0.", "This work is released into the public domain under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal"],
    "public-domain": ["This work is in the public domain.", "This file is in the public domain."],
}
#: Endings of sentences that name a Creative Commons licence, combined with its parts and versions.
CC_FORMS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This work is licensed under a {} license."]
CC_PARTS, CC_VERSIONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"], ["2.0", "3.0", "4.0"]
# Rules in order, each a licence and the identifiers that tell of it.
RULES = [
    ("MIT", ["mit-notice", "mit-grant", "mit-notice-kept", "as-is-mit"]),
    ("MIT", ["mit-grant", "mit-notice-kept", "as-is-mit"]),
    ("MIT", ["mit-grant", "mit-notice-kept"]),
    ("MIT-0", ["mit0-grant"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-as-is", "zlib-liability", "zlib-grant", "zlib-origin"]),
    ("Zlib", ["zlib-grant"]),
    ("Apache-2.0", ["apache-notice", "apache-copy"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl-free-only"]),
    ("GPL-2.0-or-later", ["gpl-free2"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("ISC", ["isc-notice", "isc-grant", "as-is-isc"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "as-is-isc"]),
    ("0BSD", ["0bsd-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("EPL-1.0", ["all-rights", "epl1-notice"]),
    ("MIT", ["mit-notice"]),
    ("ISC", ["isc-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("LGPL-3.0-only", ["lgpl-notice"]),
    ("LGPL-2.1-only", ["lgpl21-notice"]),
    ("AGPL-3.0-only", ["agpl-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("MPL-2.0", ["mpl-named"]),
    ("MPL-1.1", ["mpl11-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("EPL-1.0", ["epl1-notice"]),
    ("CDDL-1.0", ["cddl-notice"]),
    ("Artistic-2.0", ["artistic2-notice"]),
    ("BSL-1.0", ["boost-notice"]),
    ("PSF-2.0", ["psf2-notice"]),
    ("OFL-1.1", ["ofl-notice"]),
    ("WTFPL", ["wtfpl-notice"]),
    ("EUPL-1.2", ["eupl-notice"]),
    ("Unlicense", ["unlicense"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("LicenseRef-public-domain", ["public-domain"]),
]
LAST = [("LicenseRef-all-rights-reserved", ["all-rights"])]
#: Every known sentence holds one of these, so texts without any are not cut up. Each is within one word, as raw texts
#: may have anything between two words.
MARKS = ["licen", "eupl", "mpl", "acknowledg", "misrepresent", "liab", "creative", "reserved", "permi", "redistribut", "warrant", "software", "released", "copyright", "domain"]


#: Words that the first piece of a sentence has at least (before it may stand a number of a list).
LEAST_WORDS = 3


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def pieces(sentence: str) -> list[str]:
    """The normalised pieces into which the scan cuts this sentence, from the first that tells something."""
    cut = [p for p in (_plain(p) for p in re.split(r"(?<=[.!?:;])[ \t\r\n]+", sentence)) if p]
    first = next((k for k, p in enumerate(cut) if len(p.split()) >= LEAST_WORDS), 0)
    return cut[first:]


def _spoken(name: str) -> str:
    return f"{_plain(name).replace(' ', '-')}-notice"


def forms() -> dict[str, list[list[str]]]:
    """The pieces of each form of each known sentence, by identifier."""
    cc = {_spoken(f"CC {p} {v}"): [form.format(f"CC {p} {v}") for form in CC_FORMS] for p in CC_PARTS for v in CC_VERSIONS}
    return {name: [pieces(f) for f in listed] for name, listed in {**SENTENCES, **cc}.items()}


def known_sentences() -> dict[str, str]:
    """Identifier by normalised piece. A piece is named after the sentence that has it first, and numbered in it."""
    out: dict[str, str] = {}
    for name, listed in forms().items():
        for form in listed:
            for k, piece in enumerate(form):
                out.setdefault(piece, name if k == 0 else f"{name}.{k + 1}")
    return out


def rules() -> list[tuple[str, str]]:
    """Licence and the text its identifiers make in a sequence, in order.

    Forms of a sentence that are cut differently make a rule each, those of more pieces first.
    """
    known, cut = known_sentences(), forms()
    named = [(f"CC-{p}-{v}", [_spoken(f"CC {p} {v}")]) for p in CC_PARTS for v in CC_VERSIONS]
    out: dict[tuple[str, str], None] = {}
    for licence, ids in [*RULES, *named, *LAST]:
        ways = [sorted({"".join(f"<{known[p]}>" for p in form) for form in cut[i]}, key=lambda w: (-w.count("<"), w)) for i in ids]
        for way in itertools.product(*ways):
            out[licence, "".join(way)] = None
    return list(out)


def _sentences(text: Column) -> Column:
    ends = F.regexp_replace(text, "([.!?:;])[ \t\r\n]+", "$1\n")
    # A blank line ends a sentence here too; U+0001 stands for it meanwhile.
    joined = F.regexp_replace(F.regexp_replace(text, "\n[ \t\r]*\n", "\u0001"), "[ \t\r]*\n[ \t\r]*", " ")
    joined = F.regexp_replace(F.regexp_replace(joined, "([.!?:;])[ \t\r]+", "$1\n"), "\u0001", "\n")
    plain = lambda t: F.split(F.regexp_replace(F.lower(t), "[^a-z0-9\n]+", " "), "\n")
    return F.transform(F.concat(plain(ends), F.array(F.lit("")), plain(joined)), lambda s: F.trim(s))


def licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (known sentences in order, as lines and then with lines joined) and ``licences``.

    ``licences`` are the distinct licences found, in the order of the rules. A null or empty text, and one of any length
    without known sentences, has none; every row is judged by itself, so repeated rows agree. Columns of the two names
    are replaced. No shuffle, no Python.
    """
    value, marks = F.coalesce(F.col(text), F.lit("")), "|".join(MARKS)
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    ids = F.filter(F.transform(_sentences(value), lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    found = F.when(value.rlike(f"(?i){marks}"), ids).otherwise(F.expr("array()").cast("array<string>"))
    table = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(p).alias("ids")) for n, p in rules()])
    start = F.struct(F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("left"), F.expr("array()").cast("array<string>").alias("found"))

    def apply(a: Column, r: Column) -> Column:
        hit = F.contains(a["left"], r["ids"])
        return F.when(hit, F.struct(F.replace(a["left"], r["ids"], F.lit("|")).alias("left"), F.array_union(a["found"], F.array(r["licence"])).alias("found"))).otherwise(a)

    named = F.aggregate(table, start, apply, lambda a: a["found"])
    out = docs.drop("sentence_ids", "licences").withColumn("sentence_ids", found)
    return out.withColumn("licences", F.when(F.size("sentence_ids") > 0, named).otherwise(F.expr("array()").cast("array<string>")))


def licence_sql() -> str:
    """The same result of ``documents``, in DuckDB's SQL: doc_id, n_sentences, sentence_ids, licences."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(s)}, {q(i)})" for s, i in known_sentences().items())
    steps, hits = ["s0"], []
    columns = []
    for k, (licence, ids) in enumerate(rules()):
        columns.append(f"contains(s{k}, {q(ids)}) AS h{k}, replace(s{k}, {q(ids)}, '|') AS s{k + 1}")
        hits.append((licence, f"h{k}"))
        steps.append(f"s{k + 1}")
    groups: dict[str, list[str]] = {}
    for licence, h in hits:
        groups.setdefault(licence, []).append(h)
    # The order of a licence is that of its first rule that applied.
    named = ", ".join(f"CASE WHEN {h} {''.join(f'AND NOT {e} ' for e in groups[licence][: groups[licence].index(h)])}THEN {q(licence)} END" for licence, h in hits)
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
texts AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT rn, string_split(regexp_replace(lower(regexp_replace(t, '([.!?:;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g')), '[^a-z0-9\\n]+', ' ', 'g'), chr(10))
      || [''] || string_split(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\n[ \\t\\r]*\\n', chr(1), 'g'), '[ \\t\\r]*\\n[ \\t\\r]*', ' ', 'g'), '([.!?:;])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(1), chr(10), 'g')), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS parts
  FROM texts),
each AS (SELECT rn, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
ids AS (SELECT rn, string_agg(id, ',' ORDER BY pos) AS sentence_ids, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY pos) AS s0 FROM each JOIN known ON trim(part) = sentence GROUP BY rn),
ruled AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n, 0) AS n_sentences, coalesce(ids.s0, '') AS s0 FROM texts LEFT JOIN ids USING (rn)),
steps AS (SELECT *, {", ".join(columns)} FROM ruled)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_filter([{named}], lambda x: x IS NOT NULL), ',') AS licences FROM steps
"""
