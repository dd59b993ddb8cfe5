"""Passages inside longer lines (op3)."""

from __future__ import annotations

import numpy as np

from codexloom.llm import common, paragraphs


def _words(rng, n, tag):
    return [f"{tag}{x}" for x in rng.integers(0, 10**9, n)]


def test_passages_inside_lines_go_from_all_but_the_first(spark):
    rng = np.random.default_rng(3)
    long, short, docs, want = _words(rng, 55, "p"), _words(rng, 25, "q"), [], {}
    for d in range(40):
        a, b, c = (_words(rng, n, f"d{d}x") for n in (int(rng.integers(0, 90)), 60, 30))
        passage = [w.upper() if d % 2 else w for w in long] if d % 4 else []
        docs.append((d, " ".join([*a, *passage, *b, *short, *c]) + "\n" + " ".join(c[:3])))
        gone = " ".join(passage) + " " if d > 1 and passage else ""
        want[d] = (0, int(bool(gone)), docs[d][1].replace(gone, "") if gone else docs[d][1])
        if d % 3:  # a passage can be wrapped; here no part of it is long
            docs[d] = (d, docs[d][1].replace(" ".join(passage), " ".join(passage[:30]) + "\n" + " ".join(passage[30:])) if passage else docs[d][1])
            want[d] = want[d] if gone else (0, 0, docs[d][1])
    # one word over and over, and a passage that only its own line repeats, stay
    docs += [(d, " ".join([*_words(rng, 60, f"d{d}x"), *["the"] * 200, *_words(rng, 60, "y")])) for d in (40, 41)] + [(42, " ".join(long[::-1] * 3)), (43, None), (44, "")]
    want |= {d: (0, 0, t) for d, t in docs[40:]}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_removed"], r["n_passages"], r["text_without_passages"]) for r in paragraphs.drop_passages(table).collect()}
    assert got == want


def test_every_shared_run_has_a_shared_anchor():
    rng = np.random.default_rng(4)
    for _ in range(300):
        run = _words(rng, paragraphs.MIN_PASSAGE, "r")
        x, y = ([*_words(rng, int(rng.integers(0, 50)), "x"), *run, *_words(rng, int(rng.integers(0, 50)), "y")] for _ in range(2))
        texts, _, keys = paragraphs.anchors([[w.encode() for w in z] for z in (x, y)])
        assert set(keys[texts == 0]) & set(keys[texts == 1])


def test_edges_of_a_cut():
    words = [b"w%d" % i for i in range(50)]
    line, own = b" ".join(words), (5, b" ".join(words[:5]), b" ".join(words[5:17]), b" ".join(words[17:46]))
    assert paragraphs.without_passages(line, [own]) == (b" ".join(words[46:]), 1)
    assert paragraphs.without_passages(b"a  " + line[:-16], [(6, *own[1:])], 20)[0] == b"a"
    assert paragraphs.without_passages(b" ".join(words[:46]), [own]) == (b"", 1) and paragraphs.without_passages(line, []) == (line, 0)
    assert paragraphs.without_passages(line, [own], 47) == (line, 0) and paragraphs.without_passages(line, [(6, *own[1:])]) == (line, 0)


def test_texts_are_written_once_and_steps_leave_nothing_behind(spark):
    rng = np.random.default_rng(5)
    line = " ".join(_words(rng, 30, "c"))
    docs = [(d, "\n".join([" ".join(_words(rng, 50, f"d{d}x")), line if d % 3 == 0 else " ".join(_words(rng, 30, f"e{d}x"))]) if d % 7 else None) for d in range(200)]
    since = common.n_staged()
    got = paragraphs.drop_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    # the texts, the copies' positions and the passages' words; no bands, no anchors, no second copy of the texts
    left = [path.rsplit("/", 1)[-1] for path, _ in common._STAGED[since:]]
    assert len(left) == 3 and left[0].startswith("codexloom_") and sum(x.startswith("codexloom_") for x in left) == 1
    rows = {r["doc_id"]: (r["n_removed"], r["text"]) for r in got.collect()}
    assert all(rows[d] == ((1, t.split("\n")[0]) if t and d % 3 == 0 and d > 3 else (0, t)) for d, t in docs)
    common.release(spark, since)
