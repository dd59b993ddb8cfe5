"""Cases of single operators on small tables."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexloom.functions import hooks
from codexloom.functions import labels as L
from codexloom.operators import attribution as A
from codexloom.operators import blocks as B
from codexloom.operators import chunks as K
from codexloom.operators import ledgers as G
from codexloom.operators import retrieval as R
from codexloom.operators import tree as T
from codexloom.operators.dom import parse_blocks
from codexloom.plans import registry
from codexloom.sources import store
from tests.compare import SF


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_bands_and_page_numbers(spark):
    lines = [("b", p, 0, 30.0, "HEADER") for p in range(5)] + [("b", p, 1, 50.0, f"body {p}") for p in range(5)] + [("b", 1, 2, 90.0, "12"), ("b", 2, 3, 30.0, "other")]
    kept, audit = B.drop_repeating_bands(table(spark, lines, "book_id string, page int, pos int, y double, text string"), ["y", "text"], "page")
    assert {r["text"] for r in kept.collect()} == {f"body {p}" for p in range(5)} | {"other"}
    assert got(audit, "n_lines", "n_boilerplate", "n_page_numbers") == [(12, 5, 1)]


@pytest.mark.parametrize("pieces, texts", [
    (["the univer-", "sal law"], ["the universal law"]),
    (["first, and", "then more"], ["first, and then more"]),
    (["it ended.", "then more"], ["it ended.", "then more"]),
    (["all of it", "Chapter two"], ["all of it", "Chapter two"]),
    (["he took", "part of the bread"], ["he took part of the bread"]),
    (["he took,", "section by section"], ["he took, section by section"]),
    (["in all of it", "2.1.3 more"], ["in all of it", "2.1.3 more"]),
    (["free at open.org", "CHAPTER 2"], ["free at open.org", "CHAPTER 2"]),
    (["all of it", "1.1 more"], ["all of it", "1.1 more"]),
    (["all of it", "第三章"], ["all of it", "第三章"]),
    (["lower", "Upper"], ["lower", "Upper"]),
    (["a long", "way to", "go on"], ["a long way to go on"])])
def test_heal_page_breaks(spark, pieces, texts):
    df = table(spark, [("b", i, i, t) for i, t in enumerate(pieces)], "book_id string, page int, ord int, text string")
    assert [r["text"] for r in B.heal_page_breaks(df).orderBy("ord").collect()] == texts


def test_heal_records_pages(spark):
    df = table(spark, [("b", i, i, t) for i, t in enumerate(["a long", "way to", "go"])], "book_id string, page int, ord int, text string")
    r = B.heal_page_breaks(df).first()
    assert (r["pages"], r["n_merged"], r["dehyphenated"]) == ([0, 1, 2], 2, False)


def test_sections_from_nested_outline(spark):
    toc = table(spark, [("b", 0, 1, None, "CHAPTER I."), ("b", 1, 2, 0, "The Whale"), ("b", 2, 1, None, "Two"), ("b", 3, 1, None, "Three")],
                "book_id string, pos int, level int, parent_pos int, title string")
    assert [r["label"] for r in B.sections_from_outline(toc, nested=True).orderBy("pos").collect()] == ["CHAPTER I. The Whale", "Two", "Three"]
    few = table(spark, [("b", 0, 1, None, "One"), ("b", 1, 2, 0, "Inner")], "book_id string, pos int, level int, parent_pos int, title string")
    assert B.sections_from_outline(few, nested=True).count() == 2


def test_emit_blocks_offsets(spark):
    b = B.emit_blocks(table(spark, [("b", 1, 0, "abc"), ("b", 1, 1, "é漢😀x"), ("b", 2, 0, "z")], "book_id string, doc_id int, pos int, text string"))
    assert got(b, "order_idx", "start_off", "end_off") == [(0, 0, 3), (1, 4, 8), (2, 9, 10)]


def test_assign_sections(spark):
    blocks = table(spark, [("b", p) for p in range(5)] + [("c", 0)], "book_id string, pos int")
    secs = table(spark, [("b", 1, "s1", 0), ("b", 3, "s2", 1), ("b", 3, "s3", 2)], "book_id string, start int, section_id string, order_idx int")
    assert [r[1] for r in got(B.assign_sections(blocks, secs).where("book_id = 'b'"), "pos", "assigned_section")] == [None, "s1", "s1", "s3", "s3"]
    assert [r[1] for r in got(B.assign_sections(blocks, secs, clamp=True).where("book_id = 'b'"), "pos", "assigned_section")][0] == "s1"


def test_dom_blocks():
    kept, nav, empty = parse_blocks("<nav><p>menu</p></nav><h1>A\n b</h1><p>one<p>two <b>x</p><p> </p><blockquote><p>in</p> out</blockquote><figcaption>c</figcaption>")
    assert kept == [("h1", "A b"), ("p", "one"), ("p", "two x"), ("blockquote", "in out"), ("p", "in"), ("figcaption", "c")]
    assert (nav, empty) == (1, 1)
    assert parse_blocks(None) == ([], 0, 0)


def test_split_points_cover_and_bound():
    rng = np.random.default_rng(0)
    for _ in range(60):
        words = ["".join(rng.choice(list("abcdefg"), rng.integers(1, 12))) for _ in range(rng.integers(1, 120))]
        text = "".join(w + rng.choice([" ", ".", "\n", "\n\n"], p=[0.8, 0.1, 0.07, 0.03]) for w in words)
        spans = K.split_points(text, 60, 15)
        covered = np.zeros(len(text), bool)
        for a, z in spans:
            assert z - a <= 60 and a < z
            covered[a:z] = True
        assert covered.all()
        assert all(x[1] <= y[1] and x[0] <= y[0] for x, y in zip(spans, spans[1:]))


def test_chunks_do_not_cross_sections(spark):
    rows = [("b", s, i, f"block {i} " + "w " * 30) for i, s in enumerate(["s1"] * 3 + ["s2"] * 3 + ["s1"] * 2 + [None])]
    b = table(spark, [*rows, ("b", "s3", 9, " ")], "book_id string, section_id string, order_idx int, text string")
    c = K.chunk_blocks(b, 100, 20)
    assert c.select("window").distinct().count() == 4
    assert {r["window"]: r["section_id"] for r in c.collect()} == {0: "s1", 3: "s2", 6: "s1", 8: None}
    assert [r[0] for r in got(c, "chunk_ord")] == list(range(c.count()))


@pytest.mark.parametrize("label, number", [
    ("Chapter 12", 12), ("CHAPTER 3. Home", 3), ("chapter 5", 5), ("Chapter 5: The Mill", 5), ("5. The Mill", 5), ("Chapter 108", 108), ("Chapter5", 5), ("Part 2: Title", 2),
    ("Chapter IV", 4), ("Chapter iv", 4), ("PART ii", 2), ("CHAPTER V. Pigs and Pepper", 5), ("Chapter XIV", 14), ("V.", 5), ("IX", 9), ("XII. A Tale", 12), ("XIV. The End", 14),
    ("第三章", 3), ("第十二章", 12), ("第二十章", 20), ("第二十一章", 21), ("第一百零五章", 105), ("第一百零八章", 108), ("第两百章", 200), ("第12章 家", 12), ("第五章 新家", 5), ("第一二章", 12),
    ("Chapter Twenty-One", 21), ("Chapter twenty one", 21), ("Chapter Two", 2), ("CHAPTER FIVE", 5), ("Chapter Ninety", 90), ("7: Again", 7), ("7", 7),
    ("第三节", None), ("第三回", None), ("第〇章", None), ("第千章", None), ("第零章 Chapter 3", None), ("Chapter IIII", None), ("Chapter VV", None), ("Chapter LL", None), ("iv.", None), ("v", None),
    ("12 Grimmauld Place", None), ("8 MILL LANE, OLD TOWN, N.E.", None), ("I am", None), ("In the beginning", None), ("Preface", None), ("Chapter 0", None), ("Chapter Five The", None),
    ("Chapter Ten Five", None), ("mix", None), ("   ", None), (None, None), ("", None)])
def test_printed_number(spark, label, number):
    assert table(spark, [(label,)], "l string").select(L.printed_number(F.col("l"))).first()[0] == number


@pytest.mark.parametrize("kind, labels", [
    ("chapter", ["Chapter 1", "Chapter V", "CHAPTER VI. Pigs", "第五章", "第十二章", "Chapter Twenty-One", "5. The Mill", "XI", "CHAPTER I. INTRODUCTION.", "Chapter 3: Notes on Method", "Chapter 2: Index of lies"]),
    ("prologue", ["Prologue", "PROLOGUE", "Prologue: The Start", "引子", "楔子"]), ("epilogue", ["Epilogue", "EPILOGUE", "尾声", "终章"]),
    ("front_matter", ["Cover", "Title Page", "Half Title", "Copyright Page", "Contents", "Table of Contents", "Dedication", "Foreword", "Preface to the Third Edition", "Introduction", "Acknowledgments",
                      "List of Figures", "Frontispiece", "目录", "前言", "序言", "自序", "译者序", "版权", "扉页"]),
    ("back_matter", ["Appendix", "Appendix A", "Appendix B: Notes on the Text", "Afterword", "Glossary", "Index", "Bibliography", "Colophon", "Notes", "References", "Further Reading", "About the Author",
                     "附录", "索引", "参考文献", "后记", "作者简介"]),
    ("other", ["", "   ", None, "Some words", "The First Monday", "8 MILL LANE, OLD TOWN, N.E.", "第三节"])])
def test_section_kind(spark, kind, labels):
    df = table(spark, [(x,) for x in labels], "l string").select("l", L.section_kind(F.col("l")).alias("k"))
    assert {(r["l"], r["k"]) for r in df.collect()} == {(x, kind) for x in labels}


@pytest.mark.parametrize("tokens, kind", [
    ("part", "chapter"), ("acknowledgments", "front_matter"), ("foreword", "foreword"), ("unknown  TOC", "toc"), ("HalfTitlePage", "titlepage"), ("landmarks", "front_matter"), ("loi", "front_matter"),
    ("lot", "front_matter"), ("preamble", "front_matter"), ("subchapter", "chapter"), ("bodymatter", "chapter"), ("colophon", "back_matter"), ("index", "index"), ("nothing", None), (None, None)])
def test_structural_kind(spark, tokens, kind):
    assert table(spark, [(tokens,)], "t string").select(L.structural_kind(F.col("t"))).first()[0] == kind


def test_sanitize_label(spark):
    df = table(spark, [("  A\x00b ", "x.epub"), ("", "dir/My%20Book.pdf"), ("\x01", "%00%00.epub"), ("x" * 300, "f")], "t string, f string")
    assert [len(r[0]) if len(r[0]) > 50 else r[0] for r in df.select(L.sanitize_label(F.col("t"), F.col("f"))).collect()] == ["Ab", "My Book", "Untitled", 200]


def _index(spark, rows):
    return R.write_keyword_index(table(spark, rows, "book_id string, block_id string, order_idx int, text string"))


def test_keyword_search_needs_all_words(spark):
    index = _index(spark, [("b", "x", 0, "The white whale swims"), ("b", "y", 1, "A white sail"), ("c", "z", 0, "Wale, whale! Éclair")])
    q = lambda *t: R.keyword_search(table(spark, [(1, list(t))], "query_id int, tokens array<string>"), index)
    assert got(q("white", "whale"), "block_id") == [("x",)]
    assert got(q("whale"), "block_id") == [("x",), ("z",)]
    assert got(q("eclair"), "block_id") == [("z",)]
    assert q("absent").count() == 0 and q().count() == 0
    assert R.keyword_search(table(spark, [(1, ["white"])], "query_id int, tokens array<string>"), index, k=1).count() == 1


def test_written_index_is_the_lazy_one(spark):
    blocks = table(spark, [("b", "x", 0, "The white whale swims"), ("b", "y", 1, "A white sail, white"), ("c", "z", 0, "- !")], "book_id string, block_id string, order_idx int, text string")
    path = store.scratch(spark)
    R.write_keyword_index(blocks, path)
    for a, b in zip(R.keyword_index(blocks), R.read_keyword_index(spark, path)):
        assert a.columns == b.columns and got(a, *a.columns) == got(b, *a.columns)
    none = R.write_keyword_index(blocks.limit(0))
    assert R.keyword_search(table(spark, [(1, ["white"])], "query_id int, tokens array<string>"), none).count() == 0


def test_snippet(spark):
    df = table(spark, [("one two three four five whale six seven eight nine ten eleven twelve thirteen whale", ["whale"])], "t string, q array<string>")
    s = df.select(R.snippet(F.col("t"), F.col("q"), 5)).first()[0]
    assert s == "… two three four five [whale] …"


def test_vector_topk_ties_and_filters(spark):
    nodes = table(spark, [(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "a")], "node_id long, vector array<float>, s string")
    q = table(spark, [(9, [1.0, 0.0], "a")], "query_id long, vector array<float>, s string")
    assert got(R.vector_topk(q, nodes, 2), "rank", "node_id") == [(1, 1), (2, 2)]
    assert got(R.vector_topk(q, nodes, 3, on=["s"]), "rank", "node_id") == [(1, 1), (2, 3)]
    assert R.vector_topk(q.where("false"), nodes, 2).count() == 0


def test_codes_recall(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    nodes = table(spark, [(i, x.tolist()) for i, x in enumerate(v)] + [(400, v[0].tolist()), (401, None)], "node_id long, vector array<float>")
    q = nodes.where("node_id % 40 = 0 and node_id < 400").select(F.col("node_id").alias("query_id"), "vector")
    exact = set(got(R.vector_topk(q, nodes.where("node_id < 401"), 3), "query_id", "node_id"))
    near = set(got(R.vector_topk_codes(q, R.vector_codes(nodes), 3), "query_id", "node_id"))
    assert len(exact & near) >= 0.9 * len(exact)
    assert exact == set(got(R.vector_topk_codes(q, R.vector_codes(nodes), 3, share=1), "query_id", "node_id"))
    assert R.vector_topk_codes(q, R.vector_codes(nodes.where("false"))).count() == 0 and R.vector_topk_codes(q.where("false"), R.vector_codes(nodes)).count() == 0


def test_few_nodes_are_compared_exactly(spark, monkeypatch):
    """At 2,000 nodes and more a query's float work is that of under a tenth of the nodes."""
    rng, work = np.random.default_rng(3), []
    v = rng.normal(size=(4000, 32))
    index = R.vector_codes(table(spark, [(i, x.tolist()) for i, x in enumerate(v / np.linalg.norm(v, axis=1, keepdims=True))], "node_id long, vector array<float>").coalesce(1))
    batch = index.nodes.toArrow().combine_chunks()
    words = np.frombuffer(b"".join(batch.column("code").to_pylist()), "<u8").reshape(4000, -1)
    for i in range(0, 4000, 400):
        apart = np.bitwise_count(words ^ words[i]).sum(1)
        work.append((apart <= np.quantile(apart[::4], 0.05, method="higher")).mean())
    assert max(work) < 0.1


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_registered_ivf_recall(spark, size):
    exact, near = (set(got(registry.QUERIES[n](spark, f"{os.path.dirname(SF)}/{size}"), "query_id", "node_id")) for n in ("vector_topk", "vector_topk_ivf"))
    assert len(exact & near) >= 0.9 * len(exact)


def test_multi_query_origins(spark):
    legs = [(1, "v", 0, 1, "1"), (1, "v", 0, 2, "2"), (1, "hyde", 0, 1, "2"), (1, "hyde", 0, 2, "3")]
    m = R.multi_query_merge(table(spark, legs, "query_id int, leg string, leg_no int, rank int, chunk_id string"))
    assert got(m, "chunk_id", "origin") == [("1", "multi_query"), ("2", "both"), ("3", "hyde")]


@pytest.mark.parametrize("n, limit", [(5, 8), (20, 8), (9, 1), (7, 7), (13, 2)])
def test_stride_sample(spark, n, limit):
    c = table(spark, [("b", i) for i in range(n)], "book_id string, o int")
    want = list(range(n)) if n <= limit else sorted({round(i * (n - 1) / (limit - 1)) for i in range(limit)}) if limit > 1 else [0]
    assert [r[0] for r in got(R.stride_sample(c, ["book_id"], "o", limit), "o")] == want


def test_merge_evidence(spark):
    legs = [(1, 0, 1, "a", "keyword"), (1, 0, 2, "a", "hyde"), (1, 0, 3, "b", "hyde"), (1, 0, 4, "b", "multi_query"), (1, 1, 1, "b", "keyword"), (1, 1, 2, None, "hyde")]
    m = R.merge_evidence(table(spark, legs, "query_id int, sub_no int, pos int, chunk_id string, origin string"))
    assert {(r["sub_no"], r["chunk_id"], r["origin"]) for r in m.collect()} == {(0, "a", "both"), (0, "b", "hyde"), (1, None, "hyde")}


def test_balance(spark):
    e = [(1, 0, "x", 1), (1, 0, "x", 2), (1, 0, "y", 3), (1, 1, "z", 4)]
    b = R.balance(table(spark, e, "query_id int, sub_no int, section_id string, pos int"))
    assert [r["pos"] for r in b.orderBy("rank").collect()] == [1, 4, 3, 2]


def test_cluster_nodes(spark):
    rng = np.random.default_rng(3)
    rows = [("b", f"n{i}", rng.normal(size=8).tolist()) for i in range(20)] + [("c", f"n{i}", [1.0] * 8) for i in range(2)]
    nodes = table(spark, rows, "book_id string, node_id string, embedding array<float>")
    c = T.cluster_nodes(nodes)
    assert {r["book_id"] for r in c.collect()} == {"b"} and c.count() == 20 and c.select("cluster").distinct().count() <= 5
    assert got(c, "node_id", "cluster") == got(T.cluster_nodes(nodes), "node_id", "cluster")


def test_tree_links(spark):
    ch = table(spark, [("b", "x", "1"), ("b", "x", "2"), ("b", "y", "3")], "book_id string, node_id string, block_id string")
    roots = table(spark, [("b", "r", "1"), ("b", "r", "2"), ("b", "q", "1")], "book_id string, node_id string, block_id string")
    assert {(r["node_id"], r["root_id"]) for r in T.tree_links(ch, roots).collect()} == {("x", "r"), ("y", None)}


def test_mapping_drops_what_is_not_a_whole_number(spark):
    facts = table(spark, [("k", i) for i in (1, 2, 3)], "key string, fact_no int")
    text = '{"mappings": [{"fact": 1, "passages": [9, true, "2", 3, 3, 1, 2]}, {"fact": 2, "passages": [1]}, {"fact": 2, "passages": []}]}'
    m = A.apply_mapping(facts, table(spark, [("k", 5, text)], "key string, n int, response string"))
    assert got(m, "fact_no", "picks") == [(1, [3, 1]), (2, []), (3, [])]
    assert all(r["picks"] == [] for r in A.apply_mapping(facts, table(spark, [("k", 5, "{")], "key string, n int, response string")).collect())


def test_quote_guard(spark):
    passages = table(spark, [("k", 1, 0, "It was  RED here"), ("k", 2, 1, "a red summary"), ("k", 3, 0, "blue was the sea")], "key string, passage_no int, raptor_level int, text string")
    facts = [("k", 1, ["was red"], [3]), ("k", 2, ["not there"], [1]), ("k", 3, [], [2]), ("k", 4, ["red"], [2]), ("k", 5, ["a red"], [])]
    g = A.quote_guard(table(spark, facts, "key string, fact_no int, quotes array<string>, picks array<int>"), passages)
    assert got(g, "fact_no", "picks") == [(1, [1]), (2, []), (3, [2]), (4, [2]), (5, [2])]


def test_quote_spans(spark):
    df = table(spark, [('He said "The  White Whale," and “so be it” or "abc"',), (None,)], "t string")
    assert [r[0] for r in df.select(A.quote_spans(F.col("t"))).collect()] == [["the white whale", "so be it"], None]


@pytest.mark.parametrize("text, clean", [
    ("<fact>a <fact>b</fact> c</fact>", "<fact>a b</fact> c"), ("x </fact> y", "x  y"), ("<fact>open", "<fact>open</fact>"), ("plain", "plain"), (None, None)])
def test_clean_answer(text, clean):
    assert A.clean_answer(text)[0] == clean


def test_doubled_answer():
    half = "A sentence that is long enough to be told apart, " * 3
    assert A.clean_answer(half + half)[:2] == (half.rstrip(), True)
    assert A.clean_answer("short short")[1] is False


def test_ledger_keeps_first(spark):
    old = table(spark, [("s", "c", 5)], "session_id string, chunk_id string, ts long")
    new = table(spark, [("s", "c", 1), ("s", "d", 3), ("s", "d", 2)], "session_id string, chunk_id string, ts long")
    assert got(G.record_ledger(old, new, ["session_id", "chunk_id"], ["ts"]), "chunk_id", "ts") == [("c", 5), ("d", 2)]


def test_progress_of_empty_and_overfull_books(spark):
    cited = table(spark, [("a", str(i)) for i in range(5)], "book_id string, chunk_id string")
    books = table(spark, [("a", 4), ("b", 0), ("c", None)], "book_id string, total_chunks int")
    assert got(G.progress(cited, books, ["book_id"]), "book_id", "n_cited", "percent") == [("a", 5, 100.0), ("b", 0, 0.0), ("c", 0, 0.0)]


def test_usage_cost(spark):
    usage = table(spark, [("s", "m", 1000, 500), ("t", "other", 200, 50)], "session_id string, model string, input_tokens long, output_tokens long")
    prices = spark.sql("SELECT 'm' AS model, CAST(0.6 AS DECIMAL(18,9)) AS input_per_1m, CAST(2.4 AS DECIMAL(18,9)) AS output_per_1m")
    r = {x["session_id"]: x for x in G.usage_cost(usage, prices, "session_id").collect()}
    assert float(r["s"]["cost"]) == 0.0018 and float(r["t"]["cost"]) == 0 and r["t"]["n_unpriced"] == 1


def test_match_catalog_prefers_the_book(spark):
    wanted = table(spark, [(1, "Moby Dick", "Melville")], "pick_id int, title string, author string")
    cols = "volume_id int, title string, subtitle string, publisher string, author string, description string"
    vols = [(1, "Summary of Moby Dick", None, "Quick", "X", "d"), (2, "Moby Dick", "Study Guide", "Y", "Melville", "d"), (3, "Moby-Dick", None, "Z", "Herman Melville", None), (4, "Moby Dick!", None, "Z", "Melville", "d")]
    assert got(G.match_catalog(wanted, table(spark, vols, cols)), "volume_id", "score") == [(4, 13.5)]
    assert got(G.match_catalog(wanted, table(spark, vols[:1], cols)), "volume_id") == [(1,)]


def test_match_catalog_cases(spark):
    cols = "volume_id int, title string, subtitle string, publisher string, author string, description string"

    def best(author, *vols):
        rows = [(i, *v) for i, v in enumerate(vols)]
        return got(G.match_catalog(table(spark, [(1, "Tiny Habits, Big Gains", author)], "pick_id int, title string, author string"), table(spark, rows, cols)), "volume_id", "score")

    title = "Tiny Habits, Big Gains"
    assert best("James Clay", ("Summary of " + title, None, None, "Reader Publishing", "A summary."), (title, None, None, "James Clay", "The book.")) == [(1, 13.5)]
    assert best("James Clay", (title, "A Study Guide and Workbook", None, "Notes House", None), (title, None, None, "James Clay", "x")) == [(1, 13.5)]
    assert best("James Clay", (title, None, None, "James Clay", None), (title, None, None, "James Clay", "x")) == [(1, 13.5)]
    assert best("Real Author", ("Summary of " + title, None, None, "X Publishing", None)) == [(0, -3.0)]
    for mark in ("Key Takeaways", "Conversation Starters", "SparkNotes", "CliffsNotes", "Cliffnotes", "Quicklet", "Sidekick", "Instaread", "Blinkist", "Summaries", "Trivia", "Analysis"):
        assert best(None, (title, None, f"by {mark} Inc", "A", None)) == [(0, 2.0)]
    # companions and quizzes are books like any other; an author counts by whole words
    assert best("Clay", (title, "A Companion Quiz", None, "Claymore", None)) == [(0, 10.0)]
    assert best("Clay", (None, None, None, "Clay", "x"), (" ", None, None, "Clay", "x")) == []


@pytest.mark.parametrize("text, keep", [
    ("What drives the captain?", True), ("hello there old friend", False), ("short", False), ("为什么船长要追那条白鲸呢", True), ("twowords only", False), ("tell me", False),
    ("How much have I read?", False), ("how far have I read so far", False), ("Summarise this book for me.", False), ("So what's this book about?", False), ("Hi! Nice to meet you. What are you?", False),
    ("please export these notes as pdf", False), ("Show my progress please", False), ("你好，以后请叫我小李吧", False), ("请给我介绍下这本书好吗", False), ("No country for the old men?", True),
    ("Thanks, and who kills the whale?", True), ("tell me about the King of Spades", True), ("我最近在思考习惯对认知的影响", True)])
def test_is_interest(spark, text, keep):
    assert table(spark, [(text,)], "t string").select(G.is_interest(F.col("t"))).first()[0] is keep


def test_retain_last(spark):
    df = table(spark, [("a", i) for i in range(5)] + [("b", 1)], "thread string, i int")
    assert got(G.retain_last(df, "thread", ["i"], 2), "thread", "i") == [("a", 3), ("a", 4), ("b", 1)]
    assert G.retain_last(df, "thread", ["i"], 0).count() == 6


def test_replace_books(spark):
    path = f"{store.scratch(spark)}/t"
    df = table(spark, [("a", 1), ("b", 2), ("c", 3)], "book_id string, n int")
    store.replace_books(df, path)
    store.replace_books(table(spark, [("a", 9)], "book_id string, n int"), path, ["a", "b"])
    read = spark.read.schema("book_id string, n int").parquet(path)
    assert got(read, "book_id", "n") == [("a", 9), ("c", 3)]


def test_status_transitions(spark):
    recs = table(spark, [(1, "suggested"), (2, "suggested")], "id int, status string")
    moves = table(spark, [(1, "added", 1, 0), (1, "seen", 2, 0), (1, "read", 3, 0), (1, "bogus", 4, 0), (7, "added", 1, 0)], "id int, status string, ts int, seq int")
    now, missing = store.apply_status(recs, moves)
    assert got(now, "id", "status") == [(1, "seen"), (2, "suggested")] and got(missing, "id") == [(7,)]


def test_map_text_survives_failures(spark):
    def shout(texts):
        if any(t is None for t in texts):
            raise ValueError("no text")
        return [t.upper() for t in texts]

    df = table(spark, [(1, "a"), (2, None)], "id int, t string").coalesce(1)
    assert got(hooks.map_text(df, "t", shout, "out", "-"), "id", "out", "out_error") == [(1, "A", None), (2, "-", "ValueError")]


def test_intents(spark):
    import json

    responses = [
        {"kind": "chapter_summary", "chapter_number": 5, "search_query": None, "export_format": None}, {"kind": "search", "search_query": None}, {"kind": "export_notes"},
        {"kind": "export_notes", "export_format": "pdf"}, {"kind": "reading_progress", "search_query": None}, {"kind": "book_overview", "search_query": ""}, {"kind": "smalltalk"}, None,
        {"kind": "search", "search_query": "fate", "ambiguous": True, "clarify_question": "Who?", "clarify_options": ["Ann", "Bob"]},
        {"kind": "smalltalk", "ambiguous": True, "clarify_question": "which one?", "clarify_options": ["a", "b"]},
        {"kind": "search", "search_query": "x", "ambiguous": True, "clarify_question": None},
        {"kind": "search", "search_query": "x", "ambiguous": True, "clarify_question": "who?", "clarify_options": ["a", "b", "c", "d", "e", 6], "clarify_multi": True},
        {"kind": "smalltalk", "memory_note": " is called Li ", "memory_note_type": "fact"}, {"kind": "search", "search_query": "q", "memory_note": "likes whales"},
        {"kind": "search", "search_query": "q", "memory_note": " ", "memory_note_type": "fact"}, {"kind": "chapter", "memory_note": "lost"}, {"kind": "chapter_summary", "chapter_number": "five"}]
    df = table(spark, [(i, f"message {i}", json.dumps(r) if r else "broken") for i, r in enumerate(responses)], "key int, message string, response string")
    r = {x["key"]: x for x in A.coerce_intents(df).collect()}
    first = lambda *names: [tuple(r[i][n] for n in names) for i in range(len(r))]
    assert first("kind", "chapter_number", "search_query", "export_format") == [
        ("chapter_summary", 5, None, None), ("search", None, "message 1", None), ("export_notes", None, None, "markdown"), ("export_notes", None, None, "pdf"), ("reading_progress", None, None, None),
        ("book_overview", None, "message 5", None), ("smalltalk", None, None, None), ("search", None, "message 7", None), ("search", None, "fate", None), ("smalltalk", None, None, None),
        ("search", None, "x", None), ("search", None, "x", None), ("smalltalk", None, None, None), ("search", None, "q", None), ("search", None, "q", None), ("search", None, "message 15", None),
        ("chapter_summary", None, None, None)]
    unclear = {8: ("Who?", ["Ann", "Bob"], False), 11: ("who?", ["a", "b", "c", "d"], True)}
    assert {i: (x["clarify_question"], x["clarify_options"], x["clarify_multi"]) for i, x in r.items() if x["ambiguous"]} == unclear
    assert all((x["clarify_question"], x["clarify_options"], x["clarify_multi"]) == (None, [], False) for i, x in r.items() if i not in unclear)
    assert {i: (x["memory_note"], x["memory_note_type"]) for i, x in r.items() if x["memory_note"]} == {12: ("is called Li", "fact"), 13: ("likes whales", "interest")}
