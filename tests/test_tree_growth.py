"""What the summary tree moves: no book's texts meet in one task (F16)."""

from __future__ import annotations

import re

from codexloom.functions.hooks import lead_sentences, lead_words
from codexloom.operators import tree as T
from codexloom.operators.blocks import emit_blocks
from codexloom.sources import corpus as S
from pyspark.sql import functions as F


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _blocks(spark):
    rows = [(f"b{d % 2}", d, p, f"line {d} {p} " + "é漢😀x" * (d * p % 7 * 9)) for d in range(9) for p in range(d % 4 + 1)]
    return emit_blocks(spark.createDataFrame(rows, "book_id string, doc_id long, pos int, text string"))


def test_windows_of_a_book_hold_no_text(spark):
    windows = re.findall(r"Window \[.*", _plan(S.fixed_chunks(_blocks(spark))))
    of_books = [w for w in windows if re.search(r"\], \[book_id#\d+L?\]", w)]
    assert of_books and not any("win#" in w or "text#" in w for w in of_books)
    # below a book's window there are sizes, no texts
    plan = _plan(S.fixed_chunks(_blocks(spark)))
    for line in plan.splitlines():
        if "Window" in line and re.search(r"\], \[book_id#\d+L?\]", line):
            below = plan.splitlines()[plan.splitlines().index(line) + 1]
            assert "win#" not in below and "text#" not in below


def test_chunks_cover_their_sections_in_order(spark):
    b = _blocks(spark)
    sections = {}
    for r in sorted(b.collect(), key=lambda r: r["order_idx"]):
        sections.setdefault((r["book_id"], r["doc_id"]), []).append(r["text"])
    want, n = [], {}
    for (book, doc), lines in sorted(sections.items()):
        whole = "\n".join(lines)
        for at in range(0, len(whole), 50):
            want.append((book, doc, at, min(at + 50, len(whole)), whole[at:at + 50], n.setdefault(book, 0)))
            n[book] += 1
    got = S.fixed_chunks(b, 50)
    assert sorted(tuple(r) for r in got.select("book_id", "doc_id", "start", "stop", "text", "chunk_ord").collect()) == sorted(want)
    ranges = S.chunk_ranges(b, 50).select("book_id", "doc_id", "start", "stop", "chunk_ord")
    assert sorted(tuple(r) for r in ranges.collect()) == sorted((*w[:4], w[5]) for w in want)


def test_nodes_meet_their_books_count_by_book_and_salt(spark):
    rows = [(b, f"n{i}", i) for b, n in (("few", 4), ("many", 5), ("more", 300)) for i in range(n)]
    got = T._of_large_books(spark.createDataFrame(rows, "book_id string, node_id string, chapter int"), 4)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] != "few")
    joins = re.findall(r"Join LeftSemi, .*", _plan(got))
    assert any("_salt" in j for j in joins)


def test_lead_splits_no_more_than_it_takes(spark):
    texts = ["", " ", "one", " one  two\tthree\nfour ", "one two three", "one two three four five", "\n\n one two three four", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [r["lead"] for r in df.select("i", lead_sentences(F.col("text"), 3).alias("lead")).orderBy("i").collect()]
    assert [x or "" for x in got] == lead_words(texts, 3) and got[-1] is None
    assert "-1)" not in _plan(df.select(lead_sentences(F.col("text"), 3).alias("lead")))
