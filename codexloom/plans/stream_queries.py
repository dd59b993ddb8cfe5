"""Queries that run the streaming jobs over the events table until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexloom.plans.base import query
from codexloom.plans.ledger_queries import _prices
from codexloom.sources import corpus as S
from codexloom.streaming import streams as H

col = F.col
_EV = "ev AS (SELECT user_id AS session_id, user_id % 20 AS book_id, event_id AS seq, epoch_us(ts) AS us, event_type AS kind, value, json_extract(props, '$.k')::BIGINT AS k FROM events)"


@query(f"WITH {_EV} SELECT session_id, k AS chunk_id, min(us) AS us FROM ev WHERE kind = 'click' GROUP BY ALL")
def stream_ledger(spark, sf):
    return H.stream_ledger(H.read_events(spark, sf).where("kind = 'click'"))


# the delay is longer than the events' months, so nothing is forgotten
@query(f"WITH {_EV} SELECT DISTINCT session_id, k AS chunk_id FROM ev WHERE kind = 'click'")
def stream_ledger_recent(spark, sf):
    return H.stream_ledger_recent(H.read_events(spark, sf).where("kind = 'click'"), "4000 days").select("session_id", "chunk_id")


@query(f"""WITH {_EV}, pr(model, pi, po) AS (VALUES ('click', 0.6, 2.4), ('view', 0.15, 0.6), ('purchase', 3, 15))
SELECT session_id, sum(floor(value)::BIGINT)::BIGINT AS input_tokens, sum(k * 3)::BIGINT AS output_tokens, round(sum(coalesce(floor(value)::BIGINT * pi::DECIMAL(18,9) + k * 3 * po::DECIMAL(18,9), 0))::DOUBLE, 6) AS cost_micro
FROM ev LEFT JOIN pr ON kind = model GROUP BY session_id""")
def stream_usage(spark, sf):
    e = H.read_events(spark, sf).select("session_id", col("kind").alias("model"), F.floor("value").alias("input_tokens"), (col("chunk_key") * 3).alias("output_tokens"))
    return H.stream_usage(e, _prices(spark)).withColumn("cost_micro", F.round(col("cost_micro").cast("double"), 6))


# a client is a book's readers; the events come a few a minute
@query(f"WITH {_EV} SELECT book_id, us // 60000000 * 60000000 AS start_us, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1")
def rate_limit_minute(spark, sf):
    return H.rate_limit(H.read_events(spark, sf), "1 minute", 1, "book_id")


@query(f"WITH {_EV} SELECT kind, us // 3600000000 * 3600000000 AS start_us, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 4")
def rate_limit_hour(spark, sf):
    return H.rate_limit(H.read_events(spark, sf), "1 hour", 4, "kind")


def _closed(spark, sf, df, column, hours):
    """Rows that the watermark has passed, whatever the batches were."""
    last = S.table(spark, sf, "events").agg(F.max(S.micros("ts")).alias("_max"))
    return df.crossJoin(F.broadcast(last)).where(col(column) < col("_max") - hours * 3_600_000_000).drop("_max")


@query(f"""WITH {_EV}, a AS (SELECT DISTINCT session_id, us AS ask_us FROM ev WHERE kind = 'view'), b AS (SELECT session_id, us FROM ev WHERE kind = 'click'),
j AS (SELECT a.session_id, a.ask_us, min(b.us) AS ans FROM a LEFT JOIN b ON a.session_id = b.session_id AND b.us >= a.ask_us AND b.us <= a.ask_us + 6 * 3600000000 GROUP BY ALL),
n AS (SELECT *, lead(ask_us) OVER (PARTITION BY session_id ORDER BY ask_us) AS nx FROM j), p AS (SELECT session_id, ask_us, CASE WHEN nx IS NULL OR ans < nx THEN ans END AS answer_us FROM n)
SELECT session_id, ask_us, CASE WHEN answer_us IS NULL THEN 'never' WHEN answer_us - ask_us <= 1800000000 THEN 'in_time' ELSE 'late' END AS outcome, answer_us FROM p
WHERE ask_us < (SELECT max(us) FROM ev) - 24 * 3600000000""")
def clarify_outcomes(spark, sf):
    got = H.clarify_outcomes(H.read_events(spark, sf).where("kind = 'view'"), H.read_events(spark, sf).where("kind = 'click'"))
    return _closed(spark, sf, got, "ask_us", 24)


@query(f"""WITH {_EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY us)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS grp FROM g),
s AS (SELECT session_id, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS n FROM i GROUP BY session_id, grp)
SELECT * FROM s WHERE end_us < (SELECT max(us) FROM ev) - 2 * 3600000000""")
def session_activity(spark, sf):
    return _closed(spark, sf, H.session_activity(H.read_events(spark, sf)), "end_us", 2)


@query(f"WITH {_EV} SELECT book_id, count(DISTINCT k) AS n_cited FROM ev WHERE value > 10 GROUP BY book_id")
def stream_progress(spark, sf):
    return H.stream_progress(H.read_events(spark, sf).where("value > 10").select("book_id", col("chunk_key").alias("chunk_id")))


@query(f"WITH {_EV} SELECT book_id, count(DISTINCT k) AS n_cited, true AS within FROM ev WHERE value > 10 GROUP BY book_id")
def stream_progress_sketch(spark, sf):
    e = H.read_events(spark, sf).where("value > 10").select("book_id", col("chunk_key").alias("chunk_id"))
    about = H.progress_estimates(H.stream_progress_sketches(e)).withColumnRenamed("n_cited", "about")
    exact = S.ledger(spark, sf).where("value > 10").groupBy("book_id").agg(F.countDistinct("chunk_key").alias("n_cited"))
    return exact.join(about, "book_id").select("book_id", "n_cited", (F.abs(col("about") - col("n_cited")) <= 0.03 * col("n_cited")).alias("within"))
