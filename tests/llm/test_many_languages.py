import pytest

from scorelens.llm import language


def test_every_language_is_learned(spark):
    """230 values of lang with their own words, of three documents each; the last ten have one, which is learned but too little to demand predictions."""
    word = lambda k: "".join(chr(97 + (k * 7919 // 26 ** d) % 26) for d in range(4))
    rows = [(k * 10 + c, " ".join(word(1000 + k * 5 + w) for w in range(5)), f"l{k:03d}") for k in range(230)
            for c in range(1 if k >= 220 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == [f"l{k:03d}" for k in range(230)]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert [r for r in rows if r[0] < 2200 and got[r[0]] != r[2]] == []
    with pytest.raises(ValueError):
        language.train(docs, most_languages=229)
