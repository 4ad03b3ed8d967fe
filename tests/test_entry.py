"""Driver contract: every query runs at sf0.001 and agrees with its DuckDB oracle."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from scorelens.sources.tables import TABLES

from conftest import SF

FAST = ["stratified_folds", "metrics_fold", "metrics_lineitem", "validity_counts", "label_encode",
        "fingerprint_r3", "fingerprint_table", "descriptors", "linear_attr", "topn_per_model",
        "top_bit_fragments", "importance_merge", "roc_points_reduced", "csv_roundtrip"]


def _canon(pdf):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False):
        rows.append(tuple(None if (v is None or (isinstance(v, float) and math.isnan(v)))
                          else (round(float(v), 6) if isinstance(v, float) else v)
                          for v in (x.item() if hasattr(x, "item") else x for x in rec)))
    return cols, sorted(rows, key=repr)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = _canon(E.queries()[name](spark, SF).toPandas())
    want = _canon(con.execute(E.oracle_sql()[name]).fetchdf().astype(object).where(lambda d: d.notna(), None))
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_runs_and_names_match(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cheap = {"stratified_folds", "metrics_fold", "linear_attr", "label_encode", "confusion",
             "roc_points", "validity_split", "class_weights", "token_graph", "attr_long"}
    for name, sql in E.oracle_sql().items():
        cols = [d[0] for d in con.execute(sql).description]
        if name in cheap:  # planning only on the Spark side: schema, no job
            assert sorted(cols) == sorted(E.queries()[name](spark, SF).columns), name
