"""Steps that moved words."""

from __future__ import annotations

from codexloom.operators import chunks as K


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_blocks_are_not_moved(spark):
    rows = [("a", "1", "One two  one"), ("a", "1", "two three"), ("b", "1", "four"), ("b", "2", ""), ("b", "3", None)]
    words = K.block_words(spark.createDataFrame(rows, "book_id string, block_id string, text string"))
    assert sorted(map(tuple, words.collect())) == [("a", "1", "one"), ("a", "1", "three"), ("a", "1", "two"), ("b", "1", "four")]
    plan = _plan(words)
    assert plan.index("Generate") < plan.index("Aggregate")  # nothing is grouped above the words
