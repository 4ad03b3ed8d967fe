import hashlib

import duckdb
import pytest

from scorelens.llm.exact_dedup import drop_exact_copies, exact_dedup
from scorelens.llm.licenses import license_scan
from scorelens.llm.queries import ORACLES, QUERIES

from conftest import SF

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    cols = sorted(d[0] for d in want.description)
    order = [d[0] for d in want.description]
    want = sorted((tuple(r[order.index(c)] for c in cols) for r in want.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want


@pytest.mark.parametrize("salts", [1, 4])
def test_exact_dedup_odd_rows(spark, odd_docs, salts):
    rows = odd_docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(UP), []).append(r.doc_id)
    want = []
    for r in rows:
        norm = (r.text or "").translate(UP)
        ids = [i for i in groups[norm] if i is not None]
        keep = max(ids) if ids else None
        want.append((r.doc_id, keep, len(groups[norm]), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(odd_docs, salts=salts).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_drop_exact_copies_keeps_one_row_and_all_columns(spark, odd_docs):
    kept = drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r.text or "").translate(UP) for r in kept.collect()]
    assert sorted(texts) == sorted({(r.text or "").translate(UP) for r in odd_docs.collect()})
    assert drop_exact_copies(odd_docs.limit(0)).count() == 0


def test_drop_exact_copies_moves_no_row_for_repeats(spark, odd_docs):
    """Salted merge, global merge, kept ids and rows: the repeats need no exchange of their own."""
    plan = drop_exact_copies(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4


def test_exact_dedup_hot_group(spark):
    docs = spark.range(0, 3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'Same TEXT', concat('text ', id)) AS text")
    got = exact_dedup(docs).where("text_sha256 = sha2('same text', 256)").collect()
    assert len(got) == 1000 and {(r.keep_id, r.group_size) for r in got} == {(2997, 1000)}
    assert sum(r.kept for r in got) == 1


def test_license_rules_need_their_order(spark):
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
           "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
           "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    end = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [(1, "\n".join(bsd)), (2, "\n".join([*bsd, end])), (3, "\n".join(bsd[::-1])), (4, None), (5, ""),
            (6, "x.\nReleased under the MIT License.\n// Licensed under the Apache License, Version 2.0."),
            (7, "we talked about the MIT license yesterday"), (None, "RELEASED UNDER THE MIT LICENSE"), (7, "...")]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, licenses string, _ids int")
    got = sorted(((r.doc_id, r.licenses, r.n_known) for r in license_scan(docs).collect()), key=repr)
    want = [(1, "BSD-2-Clause", 3), (2, "BSD-3-Clause", 4), (3, "", 3), (4, "", 0), (5, "", 0),
            (6, "Apache-2.0,MIT", 2), (7, "", 0), (7, "", 0), (None, "MIT", 1)]
    assert got == sorted(want, key=repr)
    assert license_scan(docs.limit(0)).count() == 0
