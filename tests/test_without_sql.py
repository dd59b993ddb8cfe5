"""Library queries that SQL cannot express, against plain Python over the same tables."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from codexloom.functions import hooks
from codexloom.functions.columns import chunk_id
from codexloom.operators import attribution as A
from codexloom.operators import tree as T
from codexloom.operators.chunks import split_points
from codexloom.operators.dom import KINDS
from codexloom.plans import registry
from tests.compare import SF, by_sql

CHECKED = {"dom_blocks", "chunk_blocks", "keyword_snippet", "vector_topk_ivf", "cluster_nodes", "build_tree", "annotate_answers", "clean_answers", "embed_default", "page_sections"}


def run(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]


def parquet(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def test_every_query_without_sql_is_checked_here():
    assert set(registry.QUERIES) - set(registry.ORACLES) == CHECKED


def test_dom_blocks(spark):
    """Blocks by cutting the pages at their tags, which holds for headings and paragraphs, as none lies inside another."""
    pages, got = parquet("pages"), defaultdict(list)
    for r in run(spark, "dom_blocks"):
        got[r["page_id"]].append(r)
    checked = 0
    for page, page_html in zip(pages.page_id, pages.html):
        own = sorted(got[page], key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(len(own)))
        for r in own:
            assert r["kind"] == KINDS[r["tag"]] and r["text"] == " ".join(r["text"].split()) != "" and r["heading_level"] == (int(r["tag"][1]) if re.match("h[1-6]", r["tag"]) else None)
        flat = re.sub(r"(?is)<(script|style|title|nav)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "", page_html or "")
        if re.search(r"(?i)<(blockquote|li|figcaption|nav)\b", flat):
            continue
        opens = list(re.finditer(r"(?i)<(h[1-6]|p)\b[^>]*>", flat))
        want = []
        for m, after in zip(opens, [*[x.start() for x in opens[1:]], len(flat)]):
            inside = re.split(rf"(?i)</{m[1]}\s*>", flat[m.end():after])[0]
            text = " ".join(html.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?i)<br[^>]*>", " ", inside))).split())
            if text:
                want.append((m[1].lower(), text))
        assert [(r["tag"], r["text"]) for r in own] == want
        checked += 1
    assert checked > 5


def _windows():
    """{(source, doc): lines} of the documents in order."""
    out = defaultdict(list)
    for doc, source, text in parquet("documents").sort_values("doc_id")[["doc_id", "source", "text"]].itertuples(index=False):
        lines = [x for x in text.split("\n") if re.search(r"[^ \t\n\x0b\f\r]", x)]
        if lines:
            out[source].append(lines)
    return out


def test_chunk_blocks(spark):
    got = defaultdict(list)
    for r in run(spark, "chunk_blocks"):
        got[r["book_id"]].append(r)
    assert set(got) == set(_windows())
    for book, sections in _windows().items():
        want, order = [], 0
        for lines in sections:
            win = "\n".join(lines)
            for a, z in split_points(win, 800, 100):
                piece = win[a:z]
                if piece.strip():
                    a += len(piece) - len(piece.lstrip())
                    want.append((order, a, a + len(piece.strip()), piece.strip()))
            order += len(lines)
        own = sorted(got[book], key=lambda r: r["chunk_ord"])
        assert [(r["window"], r["start"], r["stop"], r["text"]) for r in own] == want and [r["chunk_ord"] for r in own] == list(range(len(own)))
    some = spark.createDataFrame([(b, r["chunk_ord"], r["chunk_id"]) for b, x in got.items() for r in x], "b string, o long, c string")
    assert some.where(chunk_id(F.col("b"), F.col("o")) != F.col("c")).count() == 0


def test_keyword_snippet(spark):
    fold = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    words_of = lambda t: re.findall(r"[^\W_]+", t.lower().translate(fold))
    blocks = {(r["book_id"], r["block_id"]): r["text"] for r in _blocks(spark)}
    top = {(r["query_id"], r["rank"]): r for r in run(spark, "keyword_search")}
    clauses = {i * 1000 + k: set(words_of(c)) for i, t in parquet("benchmark")[["item_id", "text"]].itertuples(index=False) for k, c in enumerate(re.split("[.,;:!?]", t))}
    got = run(spark, "keyword_snippet")
    assert len(got) == len(top) > 0
    for r in got:
        hit = top[r["query_id"], r["rank"]]
        text, terms = re.split(r"\s+", blocks[hit["book_id"], hit["block_id"]].strip(" ")), clauses[r["query_id"]]
        match = [bool(set(words_of(w)) & terms) for w in text]
        starts = range(max(len(text) - 12, 0) + 1)
        at = max(starts, key=lambda i: (sum(match[i:i + 12]), -i))
        cut = " ".join(f"[{w}]" if m else w for w, m in zip(text[at:at + 12], match[at:at + 12]))
        assert r["block_id"] == hit["block_id"] and r["snippet"] == ("… " if at else "") + cut + (" …" if at + 12 < len(text) else "")


def _blocks(spark):
    from codexloom.sources import corpus

    return corpus.blocks(spark, SF).select("book_id", "block_id", "text").collect()


def test_vector_topk_ivf(spark):
    e = parquet("embeddings")
    v = dict(zip(e.vec_id, np.stack(e.embedding).astype(float)))
    got = defaultdict(list)
    for r in run(spark, "vector_topk_ivf"):
        assert r["sim"] == pytest.approx(round(float(v[r["query_id"]] @ v[r["node_id"]]), 6), abs=2e-6)
        got[r["query_id"]].append(r)
    assert set(got) == {i for i in v if i % 100 == 0}
    for own in got.values():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3] and own == sorted(own, key=lambda r: (-r["sim"], r["node_id"])) and own[0]["node_id"] == own[0]["query_id"]


def test_page_sections(spark):
    """First-level headings, cut out of the pages by their tags; else second-level ones; else one section for a page that has any block."""
    got = defaultdict(list)
    for r in run(spark, "page_sections"):
        got[r["book_id"]].append((r["pos"], r["label"], r["kind"]))
    headed = defaultdict(lambda: defaultdict(list))
    for r in run(spark, "dom_blocks"):
        headed[r["page_id"]][r["heading_level"]].append((r["pos"], r["text"][:80], "heading"))
    want = {}
    for page, levels in headed.items():
        first = min(pos for found in levels.values() for pos, _, _ in found)
        want[page] = levels.get(1) or levels.get(2) or [(first, "Body", "other")]
    assert {b: sorted(x) for b, x in got.items()} == {b: sorted(x) for b, x in want.items()} and len(want) > 10


def test_cluster_nodes(spark):
    e = parquet("embeddings")
    books, got = defaultdict(dict), defaultdict(dict)
    for i, x in zip(e.vec_id, e.embedding):
        books[f"b{i // 200}"][f"n{i:06d}"] = np.array(x, float) / np.linalg.norm(x)
    for r in run(spark, "cluster_nodes"):
        got[r["book_id"]][r["node_id"]] = r["cluster"]
    assert {b: set(x) for b, x in got.items()} == {b: set(x) for b, x in books.items() if len(x) > 2}
    for book, labels in got.items():
        names = sorted(labels)
        x, y = np.stack([books[book][n] for n in names]), np.array([labels[n] for n in names])
        k = min(10, max(2, len(names) // 4))
        assert set(y) <= set(range(k)) and len(set(y)) >= 2
        # a fixed point: every node is nearest to the mean of its own cluster
        means = {c: x[y == c].mean(0) for c in set(y)}
        far = np.stack([((x - m) ** 2).sum(1) for m in means.values()], 1)
        own = np.array([((a - means[c]) ** 2).sum() for a, c in zip(x, y)])
        assert (own <= far.min(1) + 1e-9).mean() > 0.99


def test_build_tree(spark):
    rows = [("a", f"raptor_l1_{i:02d}", 1, i % 3, " ".join([f"topic{i % 4}"] * 30 + [f"own{i}"])) for i in range(23)] + [("b", f"raptor_l1_{i}", 1, 0, f"few {i}") for i in range(4)]
    nodes, links = T.build_tree(spark.createDataFrame(rows, "book_id string, node_id string, raptor_level int, chapter int, text string"), lambda df, text: hooks.embed(df, text, 64))
    nodes = [r.asDict() for r in nodes.collect()]
    level = {k: [r for r in nodes if r["raptor_level"] == k] for k in (1, 2, 3)}
    assert sorted((r["book_id"], r["node_id"]) for r in level[1]) == sorted((r[0], r[1]) for r in rows)
    # book a has 23 nodes, so at most 5 clusters of them; book b has no more than four nodes and gets no level above
    assert {r["book_id"] for r in level[2] + level[3]} == {"a"} and 2 <= len(level[2]) <= 5 and len(level[3]) == (min(10, max(2, len(level[2]) // 4)) if len(level[2]) > 4 else 0)
    text, chapter = {r["node_id"]: r["text"] for r in nodes if r["book_id"] == "a"}, {r["node_id"]: r["chapter"] for r in nodes if r["book_id"] == "a"}
    children = defaultdict(list)
    for r in links.collect():
        children[r["node_id"]].append(r["child_id"])
    assert set(children) == {r["node_id"] for r in level[2] + level[3]}
    for k in (2, 3):
        below = sorted(c for n, x in children.items() if n.startswith(f"raptor_l{k}_c") for c in x)
        assert below == (sorted(r["node_id"] for r in level[k - 1] if r["book_id"] == "a") if level[k] else [])
    for r in level[2] + level[3]:
        own = sorted(children[r["node_id"]])
        assert re.fullmatch(rf"raptor_l{r['raptor_level']}_c\d{{3}}", r["node_id"])
        assert r["text"] == " ".join("\n\n".join(text[c][:600] for c in own).split()[:200])
        counts = Counter(chapter[c] for c in own)
        assert r["chapter"] == min(c for c in counts if counts[c] == max(counts.values()))
    # texts of one topic differ in a word of thirty and stay together
    topic = lambda c: text[c].split()[0]
    assert all(len({topic(c) for c in own}) <= 2 for n, own in children.items() if n.startswith("raptor_l2")) or len(level[2]) < 4


def test_registered_tree(spark):
    names, want = by_sql(registry.ORACLES["section_nodes"])
    books = Counter(r[names.index("book_id")] for r in want)
    got = run(spark, "build_tree")
    one = [r for r in got if r["raptor_level"] == 1]
    assert sorted((r["book_id"], r["node_id"], r["chapter"], r["text"]) for r in one) == sorted(tuple(r[names.index(n)] for n in ("book_id", "node_id", "chapter", "text")) for r in want)
    two = Counter(r["book_id"] for r in got if r["raptor_level"] == 2)
    assert set(two) == {b for b, n in books.items() if n > 4} and all(2 <= n <= min(10, max(2, books[b] // 4)) for b, n in two.items())
    assert all(len(r["text"].split()) <= 200 for r in got)


def test_annotate_answers(spark):
    answers = [("a", "<fact>one</fact> and <FACT>two</FACT> <fact>three"), ("b", "no facts"), ("c", '<fact>x</fact>'), ("d", "")]
    facts = [("a", 1, ["c1", "c2"]), ("a", 2, []), ("c", 1, ['q"&<'])]
    got = A.annotate_answers(spark.createDataFrame(answers, "key string, text string"), spark.createDataFrame(facts, "key string, fact_no int, chunk_ids array<string>"))
    assert {r["key"]: r["text"] for r in got.collect()} == {
        "a": '<fact id="f1" chunks="c1,c2">one</fact> and <fact id="f2" chunks="">two</FACT> <fact id="f3" chunks="">three', "b": "no facts",
        "c": '<fact id="f1" chunks="q&quot;&amp;&lt;">x</fact>', "d": ""}


def test_registered_answers(spark):
    c = parquet("conversations")
    want = {}
    for conv, turn, text in c[c.role == "assistant"][["conv_id", "turn", "text"]].itertuples(index=False):
        n, tagged = 0, []
        for part in ("<fact>" + text.replace("\n", "</fact>\n<FACT>") + "</fact>").replace("<FACT>", "<fact>").split("<fact>"):
            tagged.append(part if not n else f'<fact id="f{n}" chunks="{f"chk_{n}" if n % 3 else ""}">{part}')
            n += 1
        want[conv * 1000 + turn] = "".join(tagged)
    assert {r["key"]: r["text"] for r in run(spark, "annotate_answers")} == want and want


def test_clean_answers(spark):
    c, want = parquet("conversations"), {}
    for conv, turn, text in c[c.role == "assistant"][["conv_id", "turn", "text"]].itertuples(index=False):
        whole = f"{text} \n{text}" if conv % 3 == 0 else text
        want[f"{conv}-{turn}"] = (text, whole, turn % 4 == 1)
    got = {r["key"]: r for r in run(spark, "clean_answers")}
    assert set(got) == set(want)
    for key, (text, whole, closed) in want.items():
        r = got[key]
        # the stray closer goes, the open tag is closed
        assert r["text"].startswith("<fact>") and r["text"].endswith("</fact>") and r["text"].count("fact>") == 2
        assert r["dropped_tags"] == 1 or r["was_doubled"]
        inner = r["text"].removeprefix("<fact>").removesuffix("</fact>")
        assert inner.rstrip() == (text if r["was_doubled"] else whole).rstrip() or inner.rstrip() in whole
        assert r["added_closers"] == int(not closed) or r["was_doubled"]
        if whole == text and len(text) < 120:
            assert not r["was_doubled"] and inner == text


def test_embeddings(spark):
    texts = list(parquet("benchmark")[["item_id", "text"]].itertuples(index=False))
    got = {r["query_id"]: np.array(r["embedding"]) for r in run(spark, "embed_default")}
    assert set(got) == {i for i, _ in texts} and all(len(v) == 256 and abs(np.linalg.norm(v) - 1) < 1e-5 for v in got.values())
    # with so many places that words hardly ever share one, angles are those of the term weights
    df = spark.createDataFrame([(int(i), t) for i, t in texts], "i long, text string")
    wide = {r["i"]: np.array(r["embedding"]) for r in hooks.embed(df, "text", 1 << 16).collect()}
    bags = {i: Counter(re.split(r"\s", t.lower())) for i, t in texts}
    held = Counter(w for b in bags.values() for w in b)
    weight = lambda b: {w: n * math.log((len(bags) + 1) / (held[w] + 1)) for w, n in b.items()}
    size = lambda x: math.sqrt(sum(a * a for a in x.values()))
    for i, _ in texts[:8]:
        for j, _ in texts[:8]:
            a, b = weight(bags[i]), weight(bags[j])
            assert wide[i] @ wide[j] == pytest.approx(sum(a[w] * b.get(w, 0) for w in a) / (size(a) * size(b)), abs=0.02)
