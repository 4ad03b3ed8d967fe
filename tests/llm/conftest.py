import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scorelens.session import get_spark

    return get_spark(shuffle_partitions=8)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ids without text, clashing names."""
    rows = [
        (1, "Hello World, this is a TEST of a text.", "en", 1, "x"),
        (2, "hello world, this is a test of a text.", None, 2, None),
        (2, "hello world, this is a test of a text.", None, 2, None),
        (3, None, "en", None, "k"), (4, "", "de", 4, "k"), (5, " \n\t ", "fr", 5, None),
        (None, "lost id text " * 40, "en", 6, "z"), (None, None, None, None, None),
        (7, "word " * 30000, "en", 7, "z"), (8, "x" * 70000, "en", 8, "z"),
        (9, "é ü ñ ▁ mark <|endoftext|> 　 \U0001F600 <s> end", "es", 9, "z"),
        (10, "ab" * 3000 + " tail", "en", 10, "z"), (11, "a\x00b", "en", 1, "n"),
        (12, "日本語のテキスト 日本語のテキスト", "ja", 2, "j"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, keep_id string")
