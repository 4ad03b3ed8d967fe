"""Slots leave the task as masks, features are read by column, fits side by side take the partitions their values fill."""

from scorelens.operators import fingerprint as FP
from scorelens.operators import importance as I
from scorelens.operators import tuning as T
from scorelens.plans import job as JOB

TEXTS = [(1, "a b c a"), (1, "x y"), (2, ""), (3, None), (None, "one two"), (4, " \n "), (5, "Z z Z " * 40)]


def test_masks_hold_the_slots_of_all_environments(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for n_bits in (40, 1024):
        rows = [tuple(r) for r in FP.fingerprint_bits(FP.environments(docs, 2, n_bits, masks=True)).collect()]
        plain = {(r["doc_id"], r["bit"]) for r in FP.environments(docs, 2, n_bits).collect()}
        assert len(rows) == len(plain) and set(rows) == plain


def test_bit_sets_are_sorted_and_empty_without_slots(spark):
    bits = spark.createDataFrame([(1, 70), (1, 3), (1, 70), (1, 31), (1, 32), (2, None), (None, 5)], "doc_id long, bit long")
    ents = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, name string")
    got = {r["name"]: r["bits"] for r in FP.fingerprint_table(ents, bits).collect()}
    assert got == {"a": [3, 31, 32, 70], "b": [], "c": []}


def test_slots_are_counted_without_a_sort(spark):
    bits = spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "doc_id long, bit long")
    labels = spark.createDataFrame([(1, "m", 1), (2, "m", 0), (3, "m", 0)], "doc_id long, model string, label int")
    imp = I.bit_importance(bits, labels, group_cols=["model"])
    assert "ShuffledHashJoin" in imp._jdf.queryExecution().executedPlan().toString()
    assert {(r["bit"], r["n1"], r["n0"]) for r in imp.collect()} == {(5, 1, 1), (6, 0, 1)}


def test_a_fit_on_descriptors_leaves_the_fingerprints_unread(spark):
    rows = [(i, f"w{i} v{i % 3} u", len(f"w{i} v{i % 3} u"), i % 2) for i in range(12)]
    feats, _ = JOB.job_features(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, label int"))
    plan = feats.select("doc_id", "mol_wt")._jdf.queryExecution().executedPlan().toString()
    assert "mol_wt" in plan and "ecfp" not in plan
    assert {len(r["ecfp"]) for r in feats.collect()} == {FP.N_BITS}


def test_fits_side_by_side_take_few_partitions(spark):
    rows = spark.range(100).repartition(7)
    assert T.narrowed(rows, 20_598, "Descriptors").rdd.getNumPartitions() == 1
    assert T.narrowed(rows, 20_598, "Combined_Naive").rdd.getNumPartitions() == 4
    assert T.narrowed(rows, 1_200_000, "Combined_Naive").rdd.getNumPartitions() == 7
    assert T.narrowed(rows, 0, "ECFP").count() == 100
