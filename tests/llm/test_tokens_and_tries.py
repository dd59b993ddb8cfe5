"""Prefix tries, token counts and alignments against brute force, on awkward tables."""

from __future__ import annotations

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codexloom.llm import alignment, prefix_trie, token_counts
from tests.compare import SF

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\n\n   ", "\t", "'re", "'", "don't ", "<|endoftext|>", "<|end", "oftext|>", "<s>", "é", "é", "\U0001f389", "123456", "!!", "　 ", "\x1c", "\x85 ", " word", "<0x41>", "\r\n"]


def awkward_texts():
    """Random mixtures in which chunks seldom meet, and runs longer than any chunk."""
    rnd = random.Random(11)
    pick = lambda: rnd.choice([*PARTS, "a" * rnd.randint(1, 40), "日本語" * rnd.randint(1, 9)])
    rows = [(i, "".join(pick() for _ in range(rnd.randint(0, 150)))) for i in range(120)]
    rows += [(1000, "a" * 3000), (1001, " " * 3000), (1002, "x " * 20 + "b" * 1000 + " y" * 300 + "1" * 500 + "\n" * 300), (1003, "<|endoftext|>" * 200), (1004, "日本語" * 800)]
    return rows + [(1005, None), (None, "hello there"), (5, ""), (5, "bad ▁ text"), (6, "bad " * 100 + "▁" + " more" * 100), (7, " "), (8, "a "), (9, "a  "), (9, "a  "), (10, "ab " * 4000)]


def with_clashes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("kept") for c in ("_row", "_k", "_block", "code", "pieces")})


# prefix tries

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(data):
    said = defaultdict(list)
    for c, t, r, x in data:
        if c is not None:
            said[c].append(((t is not None, t or 0), r or "", x or ""))
    said = {c: [(r, x) for _, r, x in sorted(v)] for c, v in said.items()}
    rebuilt = {}
    for c, own in said.items():
        base = abs(c) // 5 * 5 * (1 if c > 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = said.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def nodes(df):
    return sorted(tuple(r[c] for c in NODE) for r in df.collect())


def test_trie_of_awkward_conversations(spark):
    rnd = random.Random(2)
    data = [(c, rnd.choice([None, *range(12)]), rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "hi", "hé", "ok"])) for c in range(-12, 40) for _ in range(rnd.choice([1, 2, 3, 9, 12]))]
    # no base, repeated rows, longer than a block of the scan, many equal conversations
    data += [(None, 1, "user", "x")] + [(c, i // 2, "u", f"t{i % 3}") for c in (100, 101) for i in range(600)] + [(200 + i, 0, "user", "same") for i in range(200)]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").withColumns({"pos": F.lit(1), "node": F.lit("x"), "m": F.lit(2)})
    assert nodes(prefix_trie.prefix_trie(df)) == trie(data)


def test_trie_of_no_conversations(spark):
    assert nodes(prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))) == []


def test_trie_nodes_point_to_stored_turns(spark):
    df = spark.createDataFrame([(0, 1, "user", "a"), (0, 2, "assistant", "b"), (1, 5, "user", "q"), (1, 6, "assistant", "c")], "conv_id long, turn int, role string, text string")
    stored = {(0, 1): "a", (0, 2): "b", (1, 1): "q", (1, 2): "c"}
    got = prefix_trie.prefix_trie(df).where("depth > 0").collect()
    assert got and all((r["ref_conv"], r["ref_pos"]) in stored for r in got)


def test_equal_fingerprints_of_other_turns_are_found(spark, monkeypatch):
    """With maps that do not depend on the turn, groups hold different sequences: the comparison of stored turns must see it."""
    monkeypatch.setattr(prefix_trie, "_drawn", lambda seed: [F.lit(3).cast("long").alias("m"), F.lit(7).cast("long").alias("t")])
    data = [(c, t, "user", f"{c} {t}") for c in range(0, 20, 5) for t in range(10)]
    with pytest.raises(ValueError, match="another seed"):
        prefix_trie.prefix_trie(spark.createDataFrame(data, "conv_id long, turn int, role string, text string"))


# token counts

def whole_counts(rows):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(JSON)
    return sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in rows)


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 24)])
def test_spliced_counts_equal_the_library(spark, chunk, overlap):
    rows = awkward_texts()
    got = token_counts.count_tokens(with_clashes(spark, rows), JSON, chunk=chunk, overlap=overlap).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == whole_counts(rows)
    assert all(r["_row"] == r["_block"] == "kept" for r in got)


def test_counts_of_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = token_counts.op12_token_counts(spark, SF).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == whole_counts(rows)


def test_counts_of_no_documents_and_unproven_tokenizers(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, JSON).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(none, public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        token_counts.count_tokens(none, JSON, chunk=10, overlap=20)


# alignment

ROW = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in visible]
    back = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}
    counts, held = Counter(), []
    for doc, text in rows:
        links, groups = Counter(), []
        if text:
            left, right = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            of_a = [bytes(map(back.__getitem__, t)) for t in left.tokens]
            of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
            if b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
                ga, gb, na, nb, i, j = [], [], 0, 0, 0, 0
                while i < len(of_a) or j < len(of_b):
                    if na <= nb and i < len(of_a):
                        ga.append(left.ids[i])
                        na, i = na + len(of_a[i]), i + 1
                    else:
                        gb.append(right[j])
                        nb, j = nb + len(of_b[j]), j + 1
                    if na == nb:
                        groups.append((ga, gb))
                        ga, gb = [], []
                for ga, gb in groups:
                    for x, n in Counter(ga).items():
                        for y, m in Counter(gb).items():
                            links[x, y] += n * m
        counts.update(links.keys())
        held.append((doc, groups, links))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    digest = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
    return sorted((str(d), sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), links.total(), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), digest(g)) for d, g, links in held)


def scored(df):
    return sorted(tuple(str(r[c]) if c == "doc_id" else r[c] for c in ROW) for r in df.collect())


@pytest.mark.parametrize("long", [40, 700])
def test_composed_fragments_equal_whole_alignments(spark, long):
    rows = awkward_texts()
    assert scored(alignment.align_tokens(with_clashes(spark, rows), JSON, MODEL, long=long, block=2000)) == aligned(rows)


def test_alignment_of_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert scored(alignment.op13_alignment(spark, SF)) == aligned(rows)


def test_alignment_of_no_documents(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), JSON, MODEL).collect() == []


def test_composition_is_associative():
    """Any bracketing of a text's fragments gives the same root and the same closed groups."""
    with open(JSON, encoding="utf-8") as f, open(MODEL, "rb") as g:
        pair = alignment.Pair(f.read(), g.read())
    text = "Ununterbrochenes " * 3 + "日本語" * 12 + " and plain words, interrupted by some Zwischenworte of 1234567 digits" * 3
    parts = [alignment.fragment(pair, 1, k, *r) for k, r in enumerate(alignment.ranges(pair, text, 20))]
    open_ = [dict(zip(alignment.FIELDS, p[0])) for p in parts]
    for p in open_:
        p |= {c: list(p[c]) for c in ("pa", "pb", "sa", "sb")}
    # ranges end inside pieces, so groups are open between them; a fragment without a cut is open as a whole
    assert len(open_) > 8 and any(p["sa"] for p in open_)
    at = next(i for i, p in enumerate(open_) if p["sa"])
    bare = {**open_[at], "cut": False, "first": None, "pa": open_[at]["sa"], "pb": open_[at]["sb"], "sa": [], "sb": []}
    open_ = [*open_[:at], {**open_[at], "sa": [], "sb": []}, bare, *open_[at + 1:]]

    def tree(rows, widths):
        closed = []
        for w in [*widths, len(rows)]:
            made = [alignment.compose(rows[i:i + w], pair.n_b) for i in range(0, len(rows), w)]
            closed += [m[FIELD] for one in made for m in one[1:]]
            rows = [dict(zip(alignment.FIELDS, one[0])) for one in made]
        return [rows[0][c] for c in ("ok", "cut", "first", "pa", "pb", "sa", "sb")], sorted(closed)

    FIELD = slice(alignment.FIELDS.index("n_a"), alignment.FIELDS.index("groups") + 1)
    assert tree(open_, []) == tree(open_, [2, 2]) == tree(open_, [3]) == tree(open_, [2, 3])
