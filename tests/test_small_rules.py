"""Single cases of rules that the registered queries meet seldom."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from codexloom.functions import hooks
from codexloom.operators import attribution as A
from codexloom.operators import blocks as B
from codexloom.operators import ledgers as G
from codexloom.operators import retrieval as R
from codexloom.operators import tree as T
from codexloom.sources import store


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_bands_round_halves_to_even(spark):
    df = spark.createDataFrame([(y,) for y in (0.0, 1.9, 2.0, 2.1, 6.0, 10.0, 14.0, -2.0)], "y double")
    assert [r[0] for r in df.select(B.band(F.col("y"))).collect()] == [0.0, 0.0, 0.0, 4.0, 8.0, 8.0, 16.0, 0.0]


def test_headings_of_the_second_level_count_where_there_is_no_first(spark):
    data = [(1, 0, None, "x"), (1, 1, 1, "A" * 100), (1, 2, 2, "B"), (2, 0, 2, "C"), (2, 3, 2, "D"), (2, 4, 3, "E"), (3, 5, None, "only text"), (3, 7, 3, "F")]
    got = rows(B.infer_dom_sections(spark.createDataFrame(data, "book_id int, pos int, heading_level int, text string")), "book_id", "pos", "label", "kind")
    assert got == [(1, 1, "A" * 80, "heading"), (2, 0, "C", "heading"), (2, 3, "D", "heading"), (3, 5, "Body", "other")]


def test_blocks_outside_sections_are_counted(spark):
    df = spark.createDataFrame([(1, None, "p"), (1, "s", "p"), (1, "s", None)], "book_id int, section_id string, kind string")
    assert rows(B.ingestion_histograms(df), "measure", "name", "n") == [("kind", "<none>", 1), ("kind", "p", 2), ("section", "<none>", 1), ("section", "s", 2)]


def test_unknown_export_formats_fail_the_call(spark):
    said = [{"kind": "export_notes", "export_format": f} for f in ("pdf", "markdown", "docx", None)]
    df = spark.createDataFrame([(i, f"message {i}", json.dumps(x)) for i, x in enumerate(said)], "key int, message string, response string")
    assert rows(A.coerce_intents(df), "key", "kind", "search_query", "export_format") == [(0, "export_notes", None, "pdf"), (1, "export_notes", None, "markdown"), (2, "search", "message 2", None), (3, "export_notes", None, "markdown")]


def test_malformed_prices_are_skipped(spark):
    text = json.dumps({"a": {"input_per_1m_tokens": "0.5", "output_per_1m_tokens": 2}, "b": {"input_per_1m_tokens": "x", "output_per_1m_tokens": 2}, "c": 3, "d": None, "e": {"input_per_1m_tokens": 1}, "f": [1, 2], "g": {"input_per_1m_tokens": "NaN", "output_per_1m_tokens": 1}})
    got = G.read_prices(spark.createDataFrame([(text,), ("[]",), ("{torn",), (None,), ("",)], "text string"))
    assert [(r["model"], float(r["input_per_1m"]), float(r["output_per_1m"])) for r in got.collect()] == [("a", 0.5, 2.0)]


def test_dependents_go_with_their_rows(spark):
    df = spark.createDataFrame([("t", i) for i in range(5)] + [("u", 0)], "thread string, step int")
    writes = spark.createDataFrame([("t", i % 5, f"w{i}") for i in range(10)] + [("u", 0, "w"), ("t", 99, "orphan")], "thread string, step int, write string")
    kept, (rest,) = G.retain_with_dependents(df, "thread", ["step"], [writes], ["thread", "step"], n=2)
    assert rows(kept, "thread", "step") == [("t", 3), ("t", 4), ("u", 0)]
    assert rows(rest, "thread", "step", "write") == [("t", 3, "w3"), ("t", 3, "w8"), ("t", 4, "w4"), ("t", 4, "w9"), ("u", 0, "w")]
    assert G.retain_with_dependents(df, "thread", ["step"], [writes], ["thread", "step"], n=0)[1][0].count() == writes.count()


def test_last_edit_of_a_note_wins(spark):
    notes = spark.createDataFrame([(1, "old", "fact"), (2, "kept", "interest")], "id int, text string, type string")
    edits = spark.createDataFrame([(1, 1, " new ", "interest"), (1, 2, "newer", "odd"), (1, 3, "  ", "fact"), (7, 1, "none", "fact")], "id int, seq int, text string, type string")
    assert rows(G.edit_notes(notes, edits), "id", "text", "type") == [(1, "newer", "fact"), (2, "kept", "interest")]


def test_refusals(spark):
    answers = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False)], "query_id int, refused boolean")
    r = R.refusal_metrics(answers, spark.createDataFrame([(2,), (3,)], "query_id int")).first()
    assert tuple(r) == (4, 2, 0.5, 0.5, 0.5)
    none = R.refusal_metrics(answers.where("not refused and query_id = 3"), spark.createDataFrame([(3,)], "query_id int")).first()
    assert tuple(none) == (1, 0, None, None, 1.0)


def test_chapters_fall_back_to_nearness(spark):
    requests = spark.createDataFrame([(1, "b", "s", [1.0, 0.0], [0.0, 1.0]), (2, "b", "lost", [1.0, 0.0], [0.0, 1.0])], "query_id int, book_id string, section_id string, vector array<double>, chapter_vector array<double>")
    nodes = spark.createDataFrame([("b", "s", "top", 1), ("b", "s", "x", 0), ("b", "s", "y", 0)], "book_id string, section_id string, chunk_id string, raptor_level int")
    vectors = spark.createDataFrame([("b", "s", "x", [0.0, 1.0]), ("b", "s", "y", [1.0, 0.0])] + [("b", "lost", f"z{i}", [0.0, float(i)]) for i in range(9)], "book_id string, section_id string, chunk_id string, vector array<double>")
    got = rows(R.chapter_docs_by_relevance(requests, nodes, vectors, budget=2), "query_id", "rank", "chunk_id", "origin")
    assert got == [(1, 1, "top", "summary"), (1, 2, "y", "relevance"), *[(2, i + 1, f"z{8 - i}", "fallback") for i in range(6)]]


def test_books_without_sections_start_from_their_chunks(spark):
    schema = "book_id string, node_id string, raptor_level int, chapter int, text string"
    text = lambda i: " ".join([f"topic{i % 4}"] * 30 + [f"own{i}"])
    chunks = [("bare", f"chk_{i:02d}", 0, i % 3, text(i)) for i in range(30)] + [("tiny", f"chk_{i}", 0, 0, f"few {i}") for i in range(4)] + [("whole", f"chk_{i}", 0, 0, "unused") for i in range(9)]
    sections = [("whole", f"raptor_l1_{i:02d}", 1, i % 3, text(i)) for i in range(23)]
    nodes, links = T.build_tree(spark.createDataFrame(sections, schema), lambda df, c: hooks.embed(df, c, 64), chunks=spark.createDataFrame(chunks, schema))
    got, links = [r.asDict() for r in nodes.collect()], links.collect()
    levels = lambda book: {k: sorted(r["node_id"] for r in got if r["book_id"] == book and r["raptor_level"] == k) for k in (0, 1, 2, 3)}
    bare, whole, tiny = levels("bare"), levels("whole"), levels("tiny")
    assert not bare[0] and 2 <= len(bare[1]) <= 7 and all(n.startswith("raptor_l1_c") for n in bare[1]) and not any(tiny.values())
    assert whole[1] == [s[1] for s in sections] and whole[2]
    # every chunk of the bare book is under exactly one level-1 cluster, none of the others' is
    under = [(r["book_id"], r["child_id"]) for r in links if r["child_id"].startswith("chk_")]
    assert sorted(under) == sorted(("bare", c[1]) for c in chunks[:30])


def test_records_of_ids(spark):
    nodes = spark.createDataFrame([("b", "chk_a", 0, 3, "s1"), ("b", "chk_b", 0, 0, "s2"), ("b", "raptor_l1_s1", 1, 9, "s1"), ("b", "raptor_l2_c000", 2, None, None), ("b", "raptor_l2_c001", 2, None, None)], "book_id string, node_id string, raptor_level int, page int, section_id string")
    blocks = spark.createDataFrame([("b", "k1", "s2", 5), ("b", "k2", "s1", 1), ("b", "k3", "s1", 2)], "book_id string, block_id string, section_id string, order_idx int")
    cover = spark.createDataFrame([("b", "raptor_l2_c000", k) for k in ("k1", "k2", "k3", "k3")] + [("b", "raptor_l1_s1", "k2")], "book_id string, node_id string, block_id string")
    ids = spark.createDataFrame([("b", x) for x in (" a ", "chk_b", "raptor_l1_s1", "raptor_l2_c000", "raptor_l2_c001", "raptor_l9_x", "  ")], "book_id string, raw string")
    got = {r["node_id"]: (r["raptor_level"], r["page"], r["section_id"], r["section_ids"], r["n_blocks"]) for r in T.node_records(ids, nodes, cover, blocks).collect()}
    assert got == {"chk_a": (0, 3, "s1", None, None), "chk_b": (0, None, "s2", None, None), "raptor_l1_s1": (1, None, "s1", None, 1), "raptor_l2_c000": (2, None, None, ["s1", "s2"], 3),
                   "raptor_l2_c001": (2, None, None, [], 0), "raptor_l9_x": (None, None, None, None, None)}


def test_an_index_is_written_once_for_each_state_of_its_table(spark, tmp_path, monkeypatch):
    source, written = f"{tmp_path}/t.parquet", []
    own = R.write_keyword_index
    monkeypatch.setattr(R, "write_keyword_index", lambda *a: written.append(1) or own(*a))

    def asked(rows):
        spark.createDataFrame(rows, "book_id string, block_id string, order_idx int, text string").write.mode("overwrite").parquet(source)
        return [R.kept_keyword_index(spark.read.parquet(source), source).postings.count() for _ in range(2)]

    assert asked([("b", "k", 0, "one two")]) == [2, 2] and len(written) == 1
    assert asked([("b", "k", 0, "one two three"), ("b", "l", 1, "four")]) == [4, 4] and len(written) == 2


def test_folders_of_a_run_are_released(spark):
    before = store.n_taken()
    made = store.stage(spark.range(3))
    path = made.inputFiles()[0]
    store.release(spark, before)
    assert store.n_taken() == before and not store.exists(spark, path)
