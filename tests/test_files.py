"""Dataset discovery, latin-1 CSV, partitioned results, recursive scan, params JSON."""

import json

import pytest
from pyspark.sql import functions as F

from scorelens.session import scratch_path
from scorelens.sources import files as IO


def test_discover_datasets_by_file_stem(spark, tmp_path):
    (tmp_path / "alpha.csv").write_bytes("name,smiles,label\ncaf\xe9,CCO,1\nb,CC,0\n".encode("latin-1"))
    (tmp_path / "beta.csv").write_bytes(b"name,smiles,label\nx,c1ccccc1,1\n")
    df = IO.discover_datasets(spark, str(tmp_path), "name string, smiles string, label int")
    got = sorted((r["dataset"], r["name"]) for r in df.collect())
    assert got == [("alpha", "b"), ("alpha", "caf\xe9"), ("beta", "x")]


def test_no_dataset_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        IO.discover_datasets(spark, str(tmp_path), "name string")


def test_partitioned_results_round_trip(spark):
    path = scratch_path(spark, "results")
    rows = [("d", "ECFP", "rf", f, i, i % 2, 0.1 * i) for f in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "dataset string, feature_set string, model string, fold long, "
                                     "doc_id long, y_true int, y_prob double")
    IO.write_partitioned(df, path)
    # re-running one fold replaces only that fold's folder
    IO.write_partitioned(df.filter("fold = 2").withColumn("y_prob", F.lit(0.5)), path)
    back = IO.scan_predictions(spark, path)
    assert back.count() == 10
    assert back.filter("fold = 2").agg(F.max("y_prob")).first()[0] == 0.5
    assert back.filter("fold = 1").agg(F.max("y_prob")).first()[0] == pytest.approx(0.4)


def test_params_json_strips_prefix(spark):
    df = spark.createDataFrame([({"clf__C": "1.0"}, 0.75)],
                               "best_params map<string,string>, inner_cv_best_score double")
    doc = json.loads(IO.best_params_json(df).first()["params_json"])
    assert doc == {"best_params": {"C": "1.0"}, "inner_cv_best_score": 0.75}


def test_quick_results_are_isolated():
    assert IO.results_base("results", True) == "results_quicktest"
    assert IO.results_base("results/", False) == "results"


def test_keys_from_plain_folder_layout(spark, tmp_path):
    for fs, model, fold in [("ECFP", "RF", "fold1"), ("Descriptors", "LogReg", "fold2")]:
        d = tmp_path / fs / model / fold
        d.mkdir(parents=True)
        (d / "predictions.csv").write_text("Fold,SampleID,y_true,y_prob,y_pred\n1,a,1,0.9,1\n")
    df = spark.read.option("header", True).option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "predictions.csv").csv(str(tmp_path))
    keys = {tuple(r) for r in df.select(*IO.keys_from_path()).collect()}
    assert keys == {("fold1", "RF", "ECFP"), ("fold2", "LogReg", "Descriptors")}
