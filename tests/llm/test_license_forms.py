"""Every licence rule against its standard text as it stands in files: hard-wrapped, indented, in comments."""

import random
import re
import textwrap

import duckdb
import pytest

from scorelens.llm.licenses import RULES, SENTENCES, SPDX_TAGS, license_scan, license_sql, rule_pattern

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. """
APACHE_END = """You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
HOPE = "\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
LGPL21 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
LGPL_HOPE = HOPE.replace("This program", "This library").replace("GNU General", "GNU Lesser General")
AGPL = GPL3.replace("GNU General", "GNU Affero General")
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

#: One standard text for each of RULES, in its order.
STANDARD = (
    "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
    MIT, "The MIT License\n\nCopyright (c) 2020 A. Person\n\n" + MIT, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + MIT,
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", APACHE, APACHE + APACHE_END,
    "This work is licensed under the GNU General Public License version 3.",
    "Licensed under the GNU General Public License, version 3.", GPL3, GPL3 + HOPE, GPL2, GPL2 + HOPE,
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    BSD2, BSD2 + BSD3,
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "This is free and unencumbered software released into the public domain.",
    APACHE + APACHE_END.replace("http:", "https:"),
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    LGPL21, LGPL21 + LGPL_HOPE, LGPL21.replace("version 2.1", "version 3"), LGPL21.replace("version 2.1", "version 3") + LGPL_HOPE,
    AGPL, AGPL + HOPE.replace("GNU General", "GNU Affero General"),
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Distributed under the Boost Software License, Version 1.0.",
    """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    *[f"SPDX-License-Identifier: {tag}" for tag in SPDX_TAGS],
)


def _wrap(text, width, end="\n", prefix=""):
    lines = [line for p in text.split("\n\n") for line in [*textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False), ""]]
    return end.join((prefix + line).rstrip() for line in lines)


FORMS = {"one line a paragraph": lambda t: t, "wrapped": lambda t: _wrap(t, 72), "narrow": lambda t: _wrap(t, 28),
         "crlf": lambda t: _wrap(t, 60, "\r\n"), "hash": lambda t: _wrap(t, 70, prefix="# "),
         "block": lambda t: "/*\n" + _wrap(t, 64, prefix=" * ") + "\n */\nint main() { return 0; }"}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_every_rule_finds_its_standard_text(spark, form):
    assert len(STANDARD) == len(RULES)
    docs = spark.createDataFrame([(i, FORMS[form](t)) for i, t in enumerate(STANDARD)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in license_scan(docs).collect()}
    for i, (lic, seq) in enumerate(RULES):
        assert got[i][0] == lic, (form, i, got[i])
        assert "," + ",".join(seq) + "," in f",{got[i][1]},", (form, i, got[i])


def test_every_known_sentence_is_found_wrapped(spark):
    docs = spark.createDataFrame([(n, t.replace(" ", "\n")) for n, t in SENTENCES], "doc_id string, text string")
    assert {r.doc_id: r.sentence_ids for r in license_scan(docs).collect()} == {n: n for n, _ in SENTENCES}


def test_a_sentence_ends_at_its_mark_and_its_paragraph(spark):
    rows = [(1, "Released under the.\nMIT License", 2), (2, "Released under the\n \nMIT License", 2),
            (3, "SPDX-License-Identifier: MIT OR Apache-2.0", 2), (4, "we released under the\nMIT license", 2),
            (5, "released under the\nMIT licenses", 2), (6, "Is it MIT? License\n\n\nReleased! under the MIT\nlicense", 5)]
    got = {r.doc_id: (r.licenses, r.n_sentences) for r in license_scan(
        spark.createDataFrame(rows, "doc_id long, text string, n long").drop("n")).collect()}
    assert got == {i: ("", n) for i, _, n in rows}


@pytest.mark.parametrize("order", [(BSD2, BSD2 + BSD3), (BSD2 + BSD3, BSD2), (BSD2, BSD2, BSD2 + BSD3)])
def test_a_notice_beside_a_longer_one_stays(spark, order):
    docs = spark.createDataFrame([(1, "\n\n".join(order)), (2, BSD2 + BSD3)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan(docs).collect()}
    assert got == {1: "BSD-2-Clause,BSD-3-Clause", 2: "BSD-3-Clause"}


def test_covered_matches_equal_a_plain_loop():
    rules = (("A", ("x",)), ("B", ("x", "y")), ("C", ("y", "x")), ("D", ("x", "y", "x", "y")), ("E", ("y",)), ("F", ("z", "x", "x")))
    rnd = random.Random(3)
    for _ in range(2000):
        ids = [rnd.choice("xyz") for _ in range(rnd.randrange(9))]
        seen = [(lic, p, p + len(seq)) for lic, seq in rules for p in range(len(ids)) if tuple(ids[p:p + len(seq)]) == seq]
        want = {lic for lic, a, b in seen if not any(c <= a and d >= b and d - c > b - a for _, c, d in seen)}
        text = "," + ",".join(ids) + ","
        assert {lic for lic, seq in rules if re.search(rule_pattern(seq, rules), text)} == want, ids


def test_sql_finds_the_same_in_every_form(spark):
    texts = [f(t) for f in FORMS.values() for t in STANDARD]
    rnd = random.Random(5)
    texts += [rnd.choice(["\n\n", "\n", " ", "; "]).join(rnd.choice(texts) for _ in range(rnd.randrange(2, 6))) for _ in range(150)]
    texts += [None, "", "...", "v. 2v. 3", "Mozilla Public License,\tv. 2.0", "SPDX-License-Identifier: MIT OR Apache-2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in license_scan(docs).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert got == sorted(con.execute(license_sql()).fetchall())
    assert len({r[4] for r in got}) > 30
