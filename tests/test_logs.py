"""Log lines keep what is absent, null, numeric or text apart."""

from __future__ import annotations

import json

from codexloom.operators import logs

RECORD = "time_us long, level string, logger string, msg string, request_id string, session_id string, book_id string, method string, took_ms double, status int"


def test_lines_leave_out_what_has_no_value(spark):
    rows = [(1_700_000_000_123_456, "INFO", "http", "request_end", "rid-abc", "sid-xyz", "bid-123", "POST", 12.3, 200), (0, "INFO", "test", "startup ok", None, None, "", None, None, None)]
    full, bare = (json.loads(r["line"]) for r in logs.log_lines(spark.createDataFrame(rows, RECORD), "method", "took_ms", "status").collect())
    assert full == {"time": "2023-11-14T22:13:20.123Z", "level": "INFO", "logger": "http", "msg": "request_end", "request_id": "rid-abc", "session_id": "sid-xyz", "book_id": "bid-123", "method": "POST", "took_ms": 12.3, "status": 200}
    assert bare == {"time": "1970-01-01T00:00:00.000Z", "level": "INFO", "logger": "test", "msg": "startup ok"}


def test_kinds_of_fields(spark):
    lines = ['{"msg": "a", "took_ms": 12.3}', '{"msg": "a", "took_ms": "12.3"}', '{"msg": "a", "took_ms": null}', '{"msg": "a"}', '{"msg": "a", "took_ms": [1]}', '{"msg": "a", "took_ms": true}', '{"msg": "a", "took_ms": 7}', "{torn", "", None, "3"]
    got = logs.read_logs(spark.createDataFrame([(x,) for x in lines], "line string")).select("msg", "malformed", logs.kind_of("fields", "took_ms").alias("kind"), logs.number("fields", "took_ms").alias("n"))
    want = [("a", False, k, n) for k, n in (("number", 12.3), ("string", None), ("null", None), ("absent", None), ("nested", None), ("boolean", None), ("number", 7.0))] + [(None, True, "absent", None)] * 4
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_requests_without_an_end_failed(spark):
    row = lambda ms, msg, rid, took=None, status=None: (ms * 1000, "INFO", "http", msg, rid, None, None, "GET", took, status)
    rows = [row(5, "request_start", "a"), row(9, "request_end", "a", 4.0, 200), row(6, "request_start", "b"), row(7, "request_end", "c", 2.0, 404), row(8, "request_end", "a", 3.0, 503), row(8, "other", "d"), row(8, "request_start", None)]
    got = logs.http_requests(logs.read_logs(logs.log_lines(spark.createDataFrame(rows, RECORD), "method", "took_ms", "status")))
    assert sorted((r["request_id"], r["took_ms"], r["status"], r["start_us"], r["method"]) for r in got.collect()) == [("a", 4.0, 200, 5000, "GET"), ("b", None, 500, 6000, "GET"), ("c", 2.0, 404, None, "GET")]


def test_merged_sketches_give_the_percentiles_of_all(spark):
    r = spark.range(3000).selectExpr("'p' AS path", "id % 24 AS hour", "double(id) AS took_ms", "int(if(id % 10 = 0, 503, 200)) AS status").unionByName(spark.createDataFrame([("q", 0, None, 500)], "path string, hour long, took_ms double, status int"))
    got = {x["path"]: x for x in logs.latency(logs.latency_sketches(r, "path", "hour"), "path").collect()}
    assert (got["p"]["n_requests"], got["p"]["n_failed"], got["p"]["p50"], got["p"]["p95"], got["p"]["p99"]) == (3000, 300, 1499.0, 2849.0, 2969.0)
    assert (got["q"]["n_requests"], got["q"]["n_failed"], got["q"]["p50"]) == (1, 1, None)
    # beyond what a sketch keeps, ranks are near
    big = spark.range(200_000).selectExpr("'p' AS path", "id % 24 AS hour", "double(id) AS took_ms", "200 AS status")
    p95 = logs.latency(logs.latency_sketches(big, "path", "hour"), "path").first()["p95"]
    assert abs(p95 - 190_000) < 0.01 * 200_000


def test_exact_percentiles_of_more_values_than_a_sketch_holds(spark):
    rows = [("a", float(i * 7 % 20_011), 200) for i in range(20_011)] + [("b", None, 500), ("c", 3.0, 200), ("c", None, 500), ("c", 9.0, 200)]
    requests = spark.createDataFrame(rows, "path string, took_ms double, status int").repartition(7)
    got = {r["path"]: tuple(r)[1:] for r in logs.exact_latency(requests, "path").collect()}
    assert got == {"a": (20_011, 0, 10_005.0, 19_010.0, 19_810.0), "b": (1, 1, None, None, None), "c": (3, 1, 3.0, 9.0, 9.0)}
