"""License scans by sentence rules, with DataFrame functions only (no Python on the executors).

A text is cut into sentences (line ends, or sentence marks before white space),
each sentence is normalised (A-Z lower-cased, every run of other characters
than a-z and 0-9 one space) and looked up among the known licence sentences.
A known sentence may also go on over single line ends, over ``:`` and ``;`` and
inside ``v. 2``, as notices are wrapped and written in files, but not over a
blank line or another sentence mark; where several start, the longest counts.
The identifiers found, in text order, form the document's sequence; a licence
rule matches where its ordered identifiers occur in it one after another.  A
match is dropped only where a longer rule's match covers the same identifiers:
a whole notice beside a longer one of the same words stays.  A tag with an
expression (``MIT OR Apache-2.0``) is no known sentence.  Everything happens in
the document's row: no shuffle, no join.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

#: Known licence sentences in normalised form, by identifier.
SENTENCES = (
    ("mit-released", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-title", "the mit license"),
    ("mit-title-short", "mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache2-licensed", "licensed under the apache license version 2 0"),
    ("apache2-licensed-the", "licensed under the apache license version 2 0 the license"),
    ("apache2-compliance", "you may not use this file except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at"),
    ("apache2-url", "http www apache org licenses license 2 0"),
    ("apache2-as-is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-licensed", "licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-details", "see the gnu general public license for more details"),
    ("ccbync4-licensed", "licensed under cc by nc 4 0"),
    ("ccby4-licensed", "licensed under cc by 4 0"),
    ("ccbysa4-licensed", "licensed under cc by sa 4 0"),
    ("ccby4-work", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0-waiver", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl2-form", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("spdx-mit", "spdx license identifier mit"),
    ("spdx-apache2", "spdx license identifier apache 2 0"),
    ("all-rights", "all rights reserved"),
    ("apache2-url-https", "https www apache org licenses license 2 0"),
    ("gpl2-only-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("lgpl21-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-details", "see the gnu lesser general public license for more details"),
    ("agpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-details", "see the gnu affero general public license for more details"),
    ("epl2-terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("bsl1-distributed", "distributed under the boost software license version 1 0"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-event", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("0bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("wtfpl-copy", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
)

#: Further identifiers read from a tag ``SPDX-License-Identifier: <identifier>``.
SPDX_TAGS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
    "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
SENTENCES += tuple(("spdx-" + tag.lower(), "spdx license identifier " + re.sub("[^a-z0-9]+", " ", tag.lower()))
                   for tag in SPDX_TAGS)

#: Licence rules as (licence, ordered sentence identifiers).
RULES = (
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("spdx-mit",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-title-short", "mit-grant", "mit-notice", "mit-warranty")),
    ("Apache-2.0", ("apache2-licensed",)),
    ("Apache-2.0", ("spdx-apache2",)),
    ("Apache-2.0", ("apache2-licensed-the", "apache2-compliance")),
    ("Apache-2.0", ("apache2-licensed-the", "apache2-compliance", "apache2-copy", "apache2-url", "apache2-as-is")),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-licensed",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("CC-BY-NC-4.0", ("ccbync4-licensed",)),
    ("CC-BY-4.0", ("ccby4-licensed",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC-BY-SA-4.0", ("ccbysa4-licensed",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("Unlicense", ("unlicense-free",)),
    ("Apache-2.0", ("apache2-licensed-the", "apache2-compliance", "apache2-copy", "apache2-url-https", "apache2-as-is")),
    ("GPL-2.0-only", ("gpl2-only-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-details")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-details")),
    ("EPL-2.0", ("epl2-terms",)),
    ("BSL-1.0", ("bsl1-distributed",)),
    ("Zlib", ("zlib-as-is", "zlib-event", "zlib-grant")),
    ("0BSD", ("0bsd-grant",)),
    ("WTFPL", ("wtfpl-copy",)),
)
RULES += tuple((tag, ("spdx-" + tag.lower(),)) for tag in SPDX_TAGS)

#: Every cut becomes H (a sentence ends) or S (it may go on), in this order; texts have no capitals by then.
MARKS = (
    (r"\r\n?", "\n"),
    (r"\n[ \t]*\n", " H "),
    (r"(?<![a-z0-9])v\.[ \t\n]+(?=[0-9])", "v S "),
    (r"[.!?][ \t\n]+", " H "),
    (r"[:;][ \t\n]+", " S "),
    (r"\n", " S "),
    (r"[^a-z0-9HS]+", " "),
)


def rule_pattern(seq: tuple, rules) -> str:
    """Regular expression of ``seq`` in ",id,id,...," at a place that no longer rule's match covers."""
    body, longer = ",".join(seq) + ",", ""
    for other in sorted({other for _, other in rules}):
        for at in range(len(other) - len(seq) + 1):
            if len(other) > len(seq) and other[at:at + len(seq)] == seq:
                before = "".join(name + "," for name in other[:at])
                after = "".join(name + "," for name in other[at + len(seq):])
                longer += f"(?!(?<=,{before}){body}{after})"
    return "(?<=,)" + longer + body


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 sentences=SENTENCES, rules=RULES) -> DataFrame:
    """One row per input row: id, n_sentences, sentence_ids, n_known, licenses, n_licenses.

    ``sentence_ids``: identifiers of the known sentences in text order, joined by
    commas.  ``licenses``: matched licences, sorted and distinct, joined by commas;
    both empty when nothing is found.  Null and empty texts have no sentence.
    Ids are passed on as they are (null, repeated); extra columns are ignored.
    """
    known = F.array(*[F.lit(text) for _, text in sentences])
    names = F.array(*[F.lit(name) for name, _ in sentences])
    longest = sorted((text for _, text in sentences), key=len, reverse=True)
    whole = "(?<=[HS] )(?:" + "|".join(text.replace(" ", "(?: S)* ") for text in longest) + ")(?= [HS])"

    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    text = F.concat(F.lit("H "), text, F.lit(" H"))
    for pattern, mark in MARKS:
        text = F.regexp_replace(text, pattern, mark)
    cut = docs.select(F.col(id_col), text.alias("_marked"))
    found = cut.select(
        F.col(id_col), F.regexp_count("_marked", F.lit("[HS] [a-z0-9]")).cast("long").alias("n_sentences"),
        F.transform(F.regexp_extract_all("_marked", F.lit(whole), F.lit(0)),
                    lambda s: F.element_at(names, F.array_position(known, F.replace(s, F.lit(" S"), F.lit(""))).cast("int"))
                    ).alias("_ids"))
    seq = found.select("*", F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(",")).alias("_seq"))
    hits = F.array_compact(F.array(*[F.when(F.col("_seq").rlike(rule_pattern(seq, rules)), F.lit(lic)) for lic, seq in rules]))
    lic = F.when(F.size("_ids") > 0, F.array_sort(F.array_distinct(hits))).otherwise(F.array().cast("array<string>"))
    return seq.select("*", lic.alias("_lic")).select(
        F.col(id_col), "n_sentences", F.array_join("_ids", ",").alias("sentence_ids"),
        F.size("_ids").cast("long").alias("n_known"), F.array_join("_lic", ",").alias("licenses"),
        F.size("_lic").cast("long").alias("n_licenses"))


def license_sql(sentences=SENTENCES, rules=RULES) -> str:
    """The same scan in DuckDB SQL over the table documents.

    Its expressions know no lookaround: marks are doubled, so that the one that ends a sentence
    and the one that begins the next are two, and the covered matches go by their positions.
    """
    known = ", ".join(f"'{t}'" for _, t in sentences)
    names = ", ".join(f"'{n}'" for n, _ in sentences)
    longest = sorted((text for _, text in sentences), key=len, reverse=True)
    whole = "[HS] (?:" + "|".join(text.replace(" ", "(?: S S)* ") for text in longest) + ") [HS]"
    table = ", ".join("{'lic': '%s', 'seq': [%s]}" % (lic, ", ".join(f"'{n}'" for n in seq)) for lic, seq in rules)
    marked = "'H ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' H'"
    for pattern, mark in ((r"\r\n?", r"\n"), (r"\n[ \t]*\n", " H "), (r"([^a-z0-9])v\.[ \t\n]+([0-9])", r"\1v S \2"),
                          (r"[.!?][ \t\n]+", " H "), (r"[:;][ \t\n]+", " S "), (r"\n", " S "), ("[^a-z0-9HS]+", " ")):
        to = "chr(10)" if mark == r"\n" else f"'{mark}'"
        marked = f"regexp_replace({marked}, '{pattern}', {to}, 'g')"
    return rf"""
WITH marked AS (SELECT doc_id, {marked} AS m FROM documents),
found AS (
  SELECT doc_id, len(regexp_extract_all(m, '[HS] [a-z0-9]')) AS n_sentences,
         list_transform(regexp_extract_all(regexp_replace(m, '([HS])', '\1 \1', 'g'), '{whole}'),
                        lambda s: list_extract([{names}], list_position([{known}], replace(s[3:-3], ' S S', '')))) AS ids
  FROM marked),
hit AS (
  SELECT *, flatten(list_transform([{table}], lambda r: list_transform(
      list_filter(range(1, len(ids) + 1), lambda p: ids[p:p + len(r.seq) - 1] = r.seq),
      lambda p: {{'lic': r.lic, 'a': p, 'b': p + len(r.seq)}}))) AS hits
  FROM found),
top AS (
  SELECT *, list_sort(list_distinct(list_transform(list_filter(hits, lambda r: len(list_filter(hits,
      lambda s: s.a <= r.a AND s.b >= r.b AND s.b - s.a > r.b - r.a)) = 0), lambda r: r.lic))) AS lic
  FROM hit)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(lic, ','), '') AS licenses, CAST(len(lic) AS BIGINT) AS n_licenses
FROM top"""
