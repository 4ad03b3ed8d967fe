"""The guard that aborts, the filter at the head of the job, the failure list."""

import pytest
from pyspark.sql import functions as F

from scorelens.operators.combine import aligned_join
from scorelens.plans import job as JOB
from scorelens.sources import files as JOB_FILES


def test_aligned_join_keeps_every_row_or_aborts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, a string")
    b = spark.createDataFrame([(2, 0.5), (1, 0.25)], "doc_id long, b double")
    assert sorted(map(tuple, aligned_join(a, b, "doc_id").collect())) == [(1, "x", 0.25), (2, "y", 0.5)]
    for left, right, side in ((a, b.where("doc_id = 1"), "right"), (a.where("doc_id = 1"), b, "left")):
        with pytest.raises(Exception, match=f"not aligned: doc_id 2 is missing on the {side}"):
            aligned_join(left, right, "doc_id").agg(F.count("b")).collect()
    with pytest.raises(Exception, match="not aligned"):
        aligned_join(a.unionByName(spark.createDataFrame([(None, "z")], a.schema)), b, "doc_id").collect()
    assert aligned_join(a.limit(0), b.limit(0), "doc_id").count() == 0


def test_job_filters_first_and_counts(spark):
    texts = ["one two three", "bad (bracket", "", None, "four five", "six seven (8)", "wrong length"]
    rows = [(i, t, len(t or "") + (t == "wrong length"), i % 2) for i, t in enumerate(texts)]
    lab = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, label int")
    feats, counts = JOB.job_features(lab)
    assert counts == {"n_total": 7, "n_valid": 3, "n_dropped": 4}
    assert sorted(r["doc_id"] for r in feats.collect()) == [0, 4, 5]
    failed = {r["doc_id"]: r["reason"] for r in JOB.feature_failures(lab).collect()}
    assert failed == {1: "invalid", 2: "invalid", 3: "invalid", 6: "invalid"}
    odd = spark.createDataFrame([(9, " \n x", 4), (10, "\t​", 2)], "doc_id long, text string, n_chars long")
    assert {r["doc_id"] for r in JOB.feature_failures(odd).collect()} <= {10}


def test_run_folder_covers_each_dataset_by_itself(spark, tmp_path):
    words = ["one", "two two", "three (3)", "four", "a b c", "long words here", "x", "y z"]
    for name, n in (("first set", 16), ("second", 10), ("small", 3)):
        rows = [f'{i},"{words[i % 8]}",{len(words[i % 8])},{int(i % 3 == 0)}' for i in range(n)]
        rows.append('99,"bad (",5,1')
        (tmp_path / f"{name}.csv").write_text("doc_id,text,n_chars,label\n" + "\n".join(rows) + "\n")
    out = JOB.scratch_path(spark, "folder")
    infos, left_out = JOB.run_folder(spark, str(tmp_path), out, ("Descriptors",), ("logreg",),
                                     tuner=lambda train, feature_set, model: ({"C": 1.0}, None))
    assert left_out == {"small": 3}
    assert sorted((i["dataset"], int(i["fold"])) for i in infos) == [(d, f) for d in ("first set", "second") for f in range(1, 6)]
    got = JOB.scan_predictions(spark, out).groupBy("dataset").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).collect()
    assert {r["dataset"]: r["ids"] for r in got} == {"first set": list(range(16)), "second": list(range(10))}
    assert {r["dataset"] for r in JOB.summary_from_predictions(spark, out).collect()} == {"first set", "second"}


def test_a_dataset_may_be_a_folder_of_part_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f" t{i} ", 4, 1) for i in range(6)], JOB.DATASET_SCHEMA)
    JOB_FILES.write_csv(df.repartition(3), f"{tmp_path}/parts.csv", trim=False)
    JOB_FILES.write_csv(df.limit(1), f"{tmp_path}/other.csv")
    back = JOB.discover_datasets(spark, str(tmp_path), JOB.DATASET_SCHEMA)
    assert {r["dataset"]: r["count"] for r in back.groupBy("dataset").count().collect()} == {"parts": 6, "other": 1}
    assert sorted(r["text"] for r in back.where("dataset = 'parts'").collect()) == [f" t{i} " for i in range(6)]
