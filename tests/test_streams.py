"""Streams go on where they stopped, and agree with the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.sources import store
from codexloom.streaming import streams as H


def _write(spark, folder, rows):
    df = spark.createDataFrame(rows, "session_id long, chunk_key long, t long").selectExpr("session_id", "chunk_key", "timestamp_seconds(t) as ts")
    df.coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema("session_id long, chunk_key long, ts timestamp").parquet(folder)


def test_ledger_across_restarts(spark):
    place, folder = store.scratch(spark), store.scratch(spark)
    _write(spark, folder, [(1, 1, 100), (1, 1, 50), (2, 1, 70)])
    assert H.stream_ledger(_stream(spark, folder), place).count() == 2
    _write(spark, folder, [(1, 1, 10), (1, 2, 200)])
    got = {(r["session_id"], r["chunk_id"]): r["us"] for r in H.stream_ledger(_stream(spark, folder), place).collect()}
    assert got == {(1, 1): 50_000_000, (2, 1): 70_000_000, (1, 2): 200_000_000}


def test_exactly_thirty_minutes_is_in_time(spark):
    asks, answers = store.scratch(spark), store.scratch(spark)
    day, t = 86_400, 1_700_000_000
    _write(spark, asks, [(1, 0, t), (2, 0, t), (3, 0, t), (9, 0, t + 5 * day)])
    _write(spark, answers, [(1, 0, t + 1800), (2, 0, t + 1801), (9, 0, t + 5 * day)])
    got = {r["session_id"]: r["outcome"] for r in H.clarify_outcomes(_stream(spark, asks), _stream(spark, answers)).collect()}
    assert got[1] == "in_time" and got[2] == "late" and got[3] == "never"


def test_ledger_reads_only_its_keys_parts(spark):
    """A batch that ran half, and runs again, does not count twice; other parts of the ledger are left as they are."""
    place, folder = store.scratch(spark), store.scratch(spark)
    _write(spark, folder, [(i, j, 100 + i) for i in range(30) for j in range(3)])
    H.stream_ledger(_stream(spark, folder), place, buckets=8)
    ledger = spark.read.parquet(f"{place}/ledger")
    assert ledger.select("bucket").distinct().count() == 8 and ledger.groupBy("session_id", "chunk_id").agg(F.countDistinct("bucket").alias("n")).where("n > 1").count() == 0
    before = {r["f"] for r in ledger.select(F.input_file_name().alias("f")).distinct().collect()}
    _write(spark, folder, [(7, 1, 5), (7, 99, 5)])
    got = H.stream_ledger(_stream(spark, folder), place, buckets=8)
    assert got.count() == 91 and got.where("session_id = 7 and chunk_id = 1").first()["us"] == 107_000_000
    after = {r["f"] for r in spark.read.parquet(f"{place}/ledger").select(F.input_file_name().alias("f")).distinct().collect()}
    assert before < after and len(after - before) == 1


def test_recent_ledger_equals_the_ledger_within_its_delay(spark):
    place, folder, day = store.scratch(spark), store.scratch(spark), 86_400
    _write(spark, folder, [(1, 1, 100), (2, 1, 100)])
    assert H.stream_ledger_recent(_stream(spark, folder), "10 days", place).count() == 2
    # a restart within the delay: only the new key is added
    _write(spark, folder, [(1, 1, 5 * day), (1, 2, 5 * day)])
    got = H.stream_ledger_recent(_stream(spark, folder), "10 days", place)
    assert sorted((r["session_id"], r["chunk_id"]) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    whole = H.stream_ledger(_stream(spark, folder))
    assert sorted(map(tuple, got.select("session_id", "chunk_id").collect())) == sorted(map(tuple, whole.select("session_id", "chunk_id").collect()))
    # the watermark passes the first rows' delay: their keys are forgotten
    _write(spark, folder, [(3, 3, 100 * day)])
    H.stream_ledger_recent(_stream(spark, folder), "10 days", place)
    _write(spark, folder, [(2, 1, 101 * day)])
    got = H.stream_ledger_recent(_stream(spark, folder), "10 days", place)
    assert got.where("session_id = 2 and chunk_id = 1").count() == 2


def test_progress_sketches_merge(spark):
    """Sketches of two runs count what both have seen once, within three hundredths."""
    runs = []
    for low, high in ((0, 20_000), (15_000, 30_000)):
        folder = store.scratch(spark)
        spark.range(low, high).selectExpr("id % 3 AS book_id", "id AS chunk_id").union(spark.createDataFrame([(9, None), (0, 0)], "book_id long, chunk_id long")).write.parquet(folder)
        runs.append(H.stream_progress_sketches(spark.readStream.schema("book_id long, chunk_id long").parquet(folder)))
    got = {r["book_id"]: r["n_cited"] for r in H.progress_estimates(runs[0].unionByName(runs[1])).collect()}
    assert set(got) == {0, 1, 2} and all(abs(n - 10_000) <= 300 for n in got.values())
    one = {r["book_id"]: r["n_cited"] for r in H.progress_estimates(runs[1]).collect()}
    assert all(abs(one[b] - 5_000) <= 150 for b in (0, 1, 2))
