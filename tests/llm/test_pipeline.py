"""The corpus pipeline, stage by stage against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from codexloom.llm import common, decontaminate, quality
from tests.compare import SF
from tests.llm.test_corpus_operators import _fingerprint, encoding, lower  # noqa: F401


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, apply in P.STAGES:
        out.append((docs.toPandas(), docs))
        docs = common.stage(apply(spark, docs, SF), name)
    return [*out, (docs.toPandas(), docs)]


def as_dict(df):
    return dict(zip(df.doc_id, df.text))


def test_columns(steps):
    for df, _ in steps[:-1]:
        assert list(df.columns) == P.COLUMNS


def test_quality_keeps_what_scores(spark, steps):
    docs = steps[0][1]
    scores = quality.score_documents(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where(F.col("score") >= 0.3)
    assert as_dict(steps[1][0]) == {r["doc_id"]: r["text"] for r in scores.collect()} and len(steps[1][0]) < len(steps[0][0])


def test_lines(steps):
    before, held = as_dict(steps[1][0]), {}
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    for d, t in before.items():
        for k in {key(x) for x in t.split("\n")}:
            held.setdefault(k, []).append(d)
    lost = lambda d, x: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != d
    assert as_dict(steps[2][0]) == {d: "\n".join(x for x in t.split("\n") if not lost(d, x)) for d, t in before.items()}


def test_near_copies(steps):
    before = as_dict(steps[2][0])
    fps, kept = {d: _fingerprint(t) for d, t in before.items()}, as_dict(steps[3][0])
    left, want = set(before), set()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            d = todo.pop()
            group.add(d)
            left.discard(d)
            near = {x for x in left if bin(fps[x] ^ fps[d]).count("1") <= 2}
            left -= near
            todo += near
        want.add(min(group))
    assert kept == {d: before[d] for d in want}


def test_benchmark_is_gone(spark, steps):
    before, after = as_dict(steps[3][0]), as_dict(steps[4][0])
    hit = {r["doc_id"] for r in decontaminate.leaks(steps[3][1], spark.read.parquet(f"{SF}/benchmark.parquet")).where(F.size("spans") > 0).collect()}
    assert {d for d in before if before[d] != after[d]} == hit and set(before) == set(after)
    assert decontaminate.leaks(steps[4][1], spark.read.parquet(f"{SF}/benchmark.parquet")).where(F.size("spans") > 0).count() == 0


def test_ids(steps, encoding):  # noqa: F811
    own, last = encoding[2], steps[5][0]
    assert as_dict(last) == as_dict(steps[4][0])
    assert all(list(r.ids) == own.encode_ordinary(r.text) for r in last.itertuples())


def test_run_gives_the_last_stage(spark, steps):
    got = P.run(spark, SF).select("doc_id", "ids_sha256").toPandas()
    assert dict(zip(got.doc_id, got.ids_sha256)) == dict(zip(steps[5][0].doc_id, steps[5][0].ids_sha256))


def test_run_takes_up_where_it_stopped(spark, monkeypatch):
    calls, place = [], common.shared_dir(spark)

    def counted(name, apply):
        return name, lambda *a: calls.append(name) or apply(*a)

    monkeypatch.setattr(P, "STAGES", [counted(*x) for x in P.STAGES])
    first = P.run(spark, SF, place).select("doc_id", "ids_sha256").toPandas()
    calls.clear()
    again = P.run(spark, SF, place).select("doc_id", "ids_sha256").toPandas()
    assert calls == ["encode"] and dict(zip(first.doc_id, first.ids_sha256)) == dict(zip(again.doc_id, again.ids_sha256))


def test_release_drops_what_was_staged(spark):
    import os

    first, before = common.bucketed(spark.range(7), "id"), common.n_staged()
    common.bucketed(spark.range(10), "id")
    path, table = common._STAGED[-1]
    common.stage(spark.range(5))
    common.release(spark, before)
    assert common.n_staged() == before and not spark.catalog.tableExists(table) and not os.path.exists(path.removeprefix("file://"))
    assert first.count() == 7


def test_stages_of_other_tables_are_not_taken_up(spark, tmp_path):
    """Kept stages lie under the state of the tables, so a table that is written anew has stages of its own."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    before = P._state(spark, str(tmp_path))
    assert before == P._state(spark, str(tmp_path)) != P._state(spark, SF)
    spark.read.parquet(f"{SF}/labels.parquet").limit(5).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert P._state(spark, str(tmp_path)) != before
