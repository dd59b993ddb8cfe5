"""Replacement of whole books, files of notes, and clients of text hooks."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from codexloom.functions import hooks
from codexloom.sources import exports, store
from codexloom.sources.versions import BookStore

BLOCK, WORD = "book_id string, ord int, text string", "book_id string, word string"


def ids(spark, *books):
    return spark.createDataFrame([(b,) for b in books], "book_id string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def shelf(spark):
    st = BookStore(spark, store.scratch(spark))
    st.replace(ids(spark, "a", "b"), blocks=spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], BLOCK), words=spark.createDataFrame([("a", "x"), ("b", "z")], WORD))
    return st


def test_a_failed_write_leaves_the_old_book(spark, shelf):
    old = rows(shelf.read("blocks", BLOCK))
    broken = spark.createDataFrame([("a", 0, "new")], BLOCK).withColumn("text", F.raise_error(F.lit("torn")).cast("string"))
    with pytest.raises(Exception, match="torn"):
        shelf.replace(ids(spark, "a"), words=spark.createDataFrame([("a", "new")], WORD), blocks=broken)
    # the words had been written before the blocks failed
    assert rows(shelf.read("blocks", BLOCK)) == old and rows(shelf.read("words", WORD)) == [("a", "x"), ("b", "z")]
    assert shelf.vacuum() >= 1 and rows(shelf.read("blocks", BLOCK)) == old


def test_an_empty_book_clears_its_index(spark, shelf):
    before = shelf.read("words", WORD)
    shelf.replace(ids(spark, "a"), blocks=spark.createDataFrame([], BLOCK), words=spark.createDataFrame([], WORD))
    assert rows(shelf.read("blocks", BLOCK)) == [("b", 0, "z")] and rows(shelf.read("words", WORD)) == [("b", "z")]
    # a frame that was read before the commit still shows the state of then
    assert rows(before) == [("a", "x"), ("b", "z")]
    shelf.replace(ids(spark, "a"), blocks=spark.createDataFrame([("a", 5, "again")], BLOCK))
    assert rows(shelf.read("blocks", BLOCK)) == [("a", 5, "again"), ("b", 0, "z")] and rows(shelf.read("words", WORD)) == [("b", "z")]


def test_rows_of_other_books_and_second_writers_are_refused(spark, shelf, monkeypatch):
    with pytest.raises(ValueError, match="not replaced"):
        shelf.replace(ids(spark, "a"), blocks=spark.createDataFrame([("b", 0, "stray")], BLOCK))
    known = shelf._commits()
    late = BookStore(spark, shelf.path)
    monkeypatch.setattr(late, "_commits", lambda: known)
    shelf.replace(ids(spark, "a"), blocks=spark.createDataFrame([("a", 9, "first")], BLOCK))
    with pytest.raises(RuntimeError, match="another writer"):
        late.replace(ids(spark, "a"), blocks=spark.createDataFrame([("a", 9, "second")], BLOCK))
    assert rows(shelf.read("blocks", BLOCK)) == [("a", 9, "first"), ("b", 0, "z")]


def test_an_empty_store(spark):
    st = BookStore(spark, store.scratch(spark))
    assert rows(st.read("blocks", BLOCK)) == [] and rows(st.current()) == [] and st.vacuum() == 0


def test_notes_become_files(spark, tmp_path):
    notes = spark.createDataFrame([("session_1", "# é\n\nText"), ("session_2", None)], "filename string, note string")
    for _ in range(2):  # a second run puts the same files in the same places
        exports.write_notes(notes, f"file://{tmp_path}/notes")
    assert {n: open(f"{tmp_path}/notes/{n}", encoding="utf-8").read() for n in os.listdir(f"{tmp_path}/notes")} == {"session_1.md": "# é\n\nText", "session_2.md": ""}
    exports.write_notes(notes.where("false"), f"file://{tmp_path}/none")
    with pytest.raises(Exception, match="not a file name"):
        exports.write_notes(spark.createDataFrame([("../x", "y")], "filename string, note string"), f"file://{tmp_path}/notes")


def test_a_client_is_set_up_once_per_partition(spark, tmp_path):
    def client():
        with open(f"{tmp_path}/set-ups", "a") as f:
            f.write("x")
        seen = {}

        def call(texts):
            if len(texts) > 1:
                raise ConnectionError
            seen[texts[0]] = seen.get(texts[0], 0) + 1
            if texts[0] == "never":
                raise TimeoutError
            if seen[texts[0]] < 3:
                raise ConnectionError
            return [f"{texts[0]} {seen[texts[0]]}"]

        return call

    df = spark.createDataFrame([(i, "never" if i == 3 else f"t{i}") for i in range(40)], "id int, text string").repartition(2)
    seen = Observation()
    got = {r["id"]: (r["out"], r["out_error"]) for r in hooks.map_text(df, "text", None, "out", "-", client=client, retries=2, audit=seen).collect()}
    assert got == {i: ("-", "TimeoutError") if i == 3 else (f"t{i} 3", None) for i in range(40)}
    assert seen.get == {"n_rows": 40, "n_failed": 1}
    assert len(open(f"{tmp_path}/set-ups").read()) == 2
    # one try less is not enough
    assert all(r["out_error"] for r in hooks.map_text(df, "text", None, "out", "-", client=client, retries=1).collect())
