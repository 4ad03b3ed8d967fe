import re

import corpus_pipeline
import pytest

from scorelens.llm import toxicity
from scorelens.llm.packing import encoding, token_ids
from scorelens.llm.queries import held_out, vocabulary

from conftest import SF
from test_codec_packing import check_packed
from test_dedup_licenses import UP
from test_ngram_join import brute as near
from test_window_dedup import brute as windows


def test_stages_are_the_ones_dealt():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(5, 0)))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id not in toxic]
    last = {}
    for d, t in sorted(rows):
        last[t.translate(UP)] = (d, t)
    rows = sorted(last.values())
    rows = [(d, t) for (d, t), (_, _, c) in zip(rows, near(rows, 5, 80, 100), strict=True) if d == c]
    texts = {d: kept if n else t for (d, t), (_, _, n, kept) in zip(rows, windows(rows, 13), strict=True)}
    enc = encoding(vocabulary("byte_bpe_50k.tiktoken"))
    got = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    check_packed(got, {d: token_ids(enc, t, 1).tolist() for d, t in texts.items()}, 2048)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_keeps_columns_and_takes_odd_rows(spark, name, stage):
    rows = [(1, "some clean words here", "en", "s", 21), (2, None, None, None, None), (3, "", "de", "s", 0),
            (4, "Some clean WORDS here", "en", "s", 21), (5, "long " * 9000, "en", None, 45000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        out = stage(spark, part, SF)
        out.collect()
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert re.match("[a-z_]+$", name)
