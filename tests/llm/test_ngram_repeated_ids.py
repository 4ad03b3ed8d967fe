import pytest

from scorelens.llm.ngram_join import drop_near_copies, jaccard_components

from test_ngram_join import brute, corpus


@pytest.mark.parametrize("ids,cell", [(1, 4_000_000), (6, 4_000_000), (6, 300)])
def test_ids_on_several_sets_of_a_block(spark, ids, cell):
    """Ids outside the corpus are unique; within it each stands on many different texts that link."""
    rows = [(1000 + i % ids, t) for i, (_, t) in enumerate(corpus(21))]
    extra = [(5 + i, t + " one two") for i, (_, t) in enumerate(corpus(21)[::9])]
    rows += extra
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_components(df, 3, 80, 100, cell_shingles=cell).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 3, 80, 100))


def test_another_text_under_the_id_of_a_copy_stays(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(1, a, 0), (2, a + " tail", 1), (2, b, 2), (3, None, 3), (None, a, 4)], "doc_id long, text string, n int")
    assert sorted(r["n"] for r in drop_near_copies(df).collect()) == [0, 2, 3, 4]
