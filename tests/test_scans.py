"""What is carried from range to range equals what one pass over a whole book gives."""

from __future__ import annotations

import random

import numpy as np
import pytest
from codexloom.operators import blocks as B
from codexloom.operators import clustering, scans, tree
from codexloom.operators.retrieval import kmeans


def test_numbers_over_ranges(spark):
    rows = [("a", (i * 37) % 500) for i in range(500)] + [("b", 3), ("b", 1)]
    got = {(r["k"], r["v"]): r["no"] for r in scans.numbered(spark.createDataFrame(rows, "k string, v long"), ["k"], ["v"]).collect()}
    assert got == {**{("a", i): i for i in range(500)}, ("b", 1): 0, ("b", 3): 1}


def test_state_since_the_last_reset(spark):
    rows = [("a", 0, True, 1), ("a", 1, False, 0), ("a", 4, False, 0), ("a", 5, True, 0), ("a", 6, False, 1), ("a", 9, True, 0), ("b", 2, False, 1)]
    got = {(r["k"], r["p"]): r["v"] for r in scans.since_reset(spark.createDataFrame(rows, "k string, p int, reset boolean, v int"), ["k"], "p", "reset", "v").collect()}
    assert got == {("a", 0): None, ("a", 1): 1, ("a", 4): 1, ("a", 5): 1, ("a", 6): 0, ("a", 9): 1, ("b", 2): None}


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_healing_over_ranges(spark, span):
    """Against the sequential rule, on books that are much longer than a range and have gaps in their order."""
    rnd, rows, want = random.Random(8), [], []
    pieces = ["word", "word,", "Word", "word-", "Chapter 3", "end.", "1.2 Next", "  and so", "half‐ ", "", "é;"]
    for book in range(6):
        page, at, groups, run_turned, last = 0, 0, [], False, None
        for _ in range(120):
            at, page, text = at + rnd.choice([1, 1, 2, 7]), page + rnd.choice([0, 0, 1]), rnd.choice(pieces)
            rows.append((book, page, at, text))
            tail, head = (last[1].rstrip() if last else ""), text.lstrip()
            hyphen = tail.endswith(("-", "‐"))
            heading = head in ("Chapter 3", "1.2 Next")
            joins = last is not None and (hyphen or (not heading and head[:1].islower() and (tail[-1:] in ",;:" and tail or tail[-1:].islower())))
            run_turned = bool(joins) and (run_turned or last[0] != page)
            if joins and run_turned:
                g = groups[-1]
                g["text"] = g["text"].rstrip()[:-1] + head if hyphen else g["text"].rstrip() + " " + head
                g["pages"].add(page)
                g["n"] += 1
            else:
                groups.append({"ord": at, "text": text, "pages": {page}, "n": 0})
            last = (page, text)
        want += [(book, g["ord"], g["text"], sorted(g["pages"]), g["n"]) for g in groups]
    got = B.heal_page_breaks(spark.createDataFrame(rows, "book_id int, page int, ord int, text string"), span=span)
    assert sorted((r["book_id"], r["ord"], r["text"], r["pages"], r["n_merged"]) for r in got.collect()) == sorted(want)


def _same_partition(a: dict, b: dict) -> bool:
    pairs = {(a[x], b[x]) for x in a}
    return a.keys() == b.keys() and len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


def test_rounds_give_the_clusters_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for book, n in (("few", 2), ("small", 30), ("large", 900), ("twins", 300)):
        centres = rng.normal(size=(6, 12))
        v = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, 12))
        v[n // 2] = 0  # a vector without a direction
        if book == "twins":
            v[:] = v[rng.integers(0, 40, n)]
        rows += [(book, f"n{i:05d}", [float(x) for x in v[i]]) for i in range(n)]
    nodes = spark.createDataFrame(rows, "book_id string, node_id string, embedding array<double>").repartition(5)
    whole = {(r["book_id"], r["node_id"]): r["cluster"] for r in tree.cluster_nodes(nodes).collect()}
    monkeypatch.setattr(clustering, "TOGETHER", 1)
    rounds = {(r["book_id"], r["node_id"]): r["cluster"] for r in tree.cluster_nodes(nodes, large=100).collect()}
    assert {b for b, _ in rounds} == {"small", "large", "twins"}
    for book in ("small", "large", "twins"):
        pick = lambda d: {n: c for (b, n), c in d.items() if b == book}  # noqa: E731,B023
        assert _same_partition(pick(whole), pick(rounds)), book


def test_run_takes_the_steps_of_kmeans():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    first = np.random.default_rng(42)
    run = clustering._Run([v[first.choice(200, 7, replace=False)] for _ in range(10)])
    for _ in range(50):
        for r in [r for r, on in enumerate(run.active) if on]:
            label = clustering._labels(v, run.centres[r])
            hot = np.eye(7)[label]
            run.step(r, hot.sum(0), hot.T @ v, float((v ** 2).sum()))
    assert (clustering._labels(v, run.best()) == kmeans(v, 7)[0]).all()
