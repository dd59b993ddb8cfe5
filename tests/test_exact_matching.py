"""Catalogue matching and substring joins against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from codexloom.operators import attribution, ledgers, substrings

VOLUME = "volume_id long, title string, subtitle string, publisher string, author string, description string"
WORDS = "the of and moby dick whale art war peace summer time dinner again book books a i x2 ring rings lord night day".split()
MARKS = re.compile(r"\b(summary|summaries|study guide|workbook|analysis|key takeaways|conversation starters|sparknotes|cliffs?notes|quicklet|trivia|sidekick|instaread|blinkist)\b", re.I)


def norm(s):
    return re.sub(r"[^\w\s]", " ", (s or "").lower()).strip()


def words(s):
    return {w for w in norm(s).split() if len(w) > 1}


def score(title, author, volume):
    _, other, subtitle, publisher, name, text = volume
    a, b = norm(title), norm(other)
    s = 10 if a and a == b else 5 if a and (a in b or b in a) else 2 * len(words(title) & words(other))
    s += 3 if words(name) & words(author) else 0
    s -= 8 if MARKS.search(" ".join(x for x in (other, subtitle, publisher) if x)) else 0
    return s + (0.5 if (text or "").strip() else 0)


def best_of_all(wanted, volumes):
    used = [v for v in volumes if (v[1] or "").strip()]
    return sorted((pick, -best[1], float(best[0])) for pick, title, author in wanted for best in [max(((score(title, author, v), -v[0]) for v in used), default=None)] if best)


def matched(spark, wanted, volumes):
    got = ledgers.match_catalog(spark.createDataFrame(wanted, "pick_id long, title string, author string"), spark.createDataFrame(volumes, VOLUME))
    return sorted((r["pick_id"], r["volume_id"], r["score"]) for r in got.collect())


def test_popular_books_win(spark):
    """The rarest word of the wanted title belongs to another book."""
    volumes = [(1, "Moby Dick", None, None, "Herman Melville", None), (2, "Moby Dick again", None, None, "X", None), (3, "Whale Dinner", None, None, "Y", None)]
    assert matched(spark, [(7, "Moby Dick or the Whale", "Melville")], volumes) == [(7, 1, 8.0)]


@pytest.mark.parametrize("n", [0, 30, 300])
def test_same_as_all_pairs(spark, n):
    rnd = random.Random(n)
    title = lambda: "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", ", ", "-", ""]) for _ in range(rnd.randint(0, 6)))
    names = ["Herman Melville", "Tolstoy, Leo", "Leo M.", "Jane Austen", None, ""]
    wanted = [(i, rnd.choice([title(), title(), None, "Art"]), rnd.choice(names)) for i in range(100)]
    # titles of punctuation alone are inside every title; repeated titles tie
    volumes = [(i, "!!!" if i % 97 == 96 else None if i % 50 == 49 else title(), rnd.choice([None, "A Study Guide", ""]), rnd.choice([None, "Instaread", "House"]), rnd.choice(names), rnd.choice([None, "", "good"])) for i in range(n)]
    assert matched(spark, wanted, volumes) == best_of_all(wanted, volumes)


@pytest.mark.parametrize("shipped", [substrings.SHIPPED, 0])
def test_quotes_cut_anywhere(spark, monkeypatch, shipped):
    monkeypatch.setattr(substrings, "SHIPPED", shipped)
    docs = [(1, "She lived in  the house of cards. é"), (2, "Mouse of steel"), (3, None), (4, ""), (5, "x" * 50 + "needle" + "y" * 50), (6, "\U0001f389 of cards"), (6, "\U0001f389 of cards")]
    quotes = [(1, "ouse of"), (2, "hous"), (3, "e"), (4, "É"), (5, "xxneedleyyyy"), (6, ""), (7, None), (8, "zzzz"), (9, "ouse of"), (10, "in the house of cards. é"), (11, " Lived  IN "), (12, "\U0001f389 of")]
    flat = lambda x: re.sub(r"\s+", " ", x.lower()).strip()
    want = sorted((i, j) for i, x in dict(docs).items() for j, y in quotes if x and y and flat(y) and flat(y) in flat(x))
    got = attribution.quote_containment(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "query_id long, text string"))
    assert sorted(set(map(tuple, got.collect()))) == want


def test_no_documents_or_no_quotes(spark):
    docs, quotes = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "query_id long, text string")
    assert attribution.quote_containment(docs, spark.createDataFrame([(1, "abcd")], "query_id long, text string")).collect() == []
    assert attribution.quote_containment(spark.createDataFrame([(1, "abcd")], "doc_id long, text string"), quotes).collect() == []


def test_windows_tell_substrings_apart():
    text = "abracadabra, \U0001f389 and so on " * 3
    w = substrings.Windows(text)
    for width in (1, 3, 8, 20, len(text)):
        seen = {}
        for i, h in enumerate(w.of(width).tolist()):
            assert seen.setdefault(h, text[i:i + width]) == text[i:i + width]
            assert substrings.Windows(text[i:i + width]).of(width).tolist() == [h]
