"""Every token can be rebuilt; a top slot that no entity sets gets one warning row."""

import hashlib

import pandas as pd

from scorelens.plans import explain as X


def slot(word: bytes) -> int:
    return int(hashlib.md5(word).hexdigest()[:8], 16) % 1024


def test_letter_free_tokens_resolve_and_absent_slots_warn(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": [1, 2], "text": ["123 456", "123"], "lang": ["en", "en"],
                         "source": ["s1", "s2"], "n_chars": [7, 3]})
    labels = pd.DataFrame({"doc_id": [1, 2], "quality": [1, 0], "toxic": [1, 0]})
    docs.to_parquet(tmp_path / "documents.parquet")
    labels.to_parquet(tmp_path / "labels.parquet")
    held, absent = slot(b"123"), slot(b"never there")
    top = spark.createDataFrame([("toxic", held), ("toxic", absent)], "model string, feature_idx long")
    frame = X.fragment_rows(spark, str(tmp_path), top)
    rows = frame.collect()
    assert sorted((r["doc_id"], r["name"], r["fragment"], r["note"]) for r in rows if r["bit"] == held) == [
        (1, "s1", "123", X.NOTE_RESOLVED), (2, "s2", "123", X.NOTE_RESOLVED)]
    assert [(r["doc_id"], r["fragment"], r["note"]) for r in rows if r["bit"] == absent] == [(None, None, X.NOTE_UNRESOLVED)]
    dictionary = {r["bit"]: r["fragment"] for r in X.fragment_dictionary(spark.createDataFrame(rows, frame.schema)).collect()}
    assert dictionary == {held: "123", absent: None}  # present with a null value: not "N/A"
