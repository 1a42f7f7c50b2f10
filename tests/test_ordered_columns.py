import pytest

from poseweave.llm import tokens
from poseweave.operators.ordered import number_rows


def test_numbered_rows_keep_only_the_columns_asked_for(spark):
    rows = spark.createDataFrame([(0, 3, "c"), (0, 1, "a"), (1, 2, "b"), (0, 2, "d")], "run bigint, at bigint, name string")
    found = number_rows(rows, ["run"], ["at"], "n", "total", keep=["name"])
    assert sorted(found.columns) == ["n", "name", "run", "total"]
    assert sorted(map(tuple, found.select("run", "n", "name", "total").collect())) == [
        (0, 0, "a", 3), (0, 1, "d", 3), (0, 2, "c", 3), (1, 0, "b", 1)]


def test_words_beyond_the_cache_have_the_same_ids(monkeypatch):
    pytest.importorskip("tokenizers")
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    encoder = tokens.Encoder(tokens.default_vocabulary())
    text = "one two one three four two one\n  five don't one"
    whole = b"".join(i.to_bytes(4, "little") for i in encoder.library.encode(text, add_special_tokens=False).ids)
    assert encoder.ids(text) == whole and encoder.ids(text) == whole and len(encoder.known) == 2
