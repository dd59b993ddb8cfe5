"""Append-only ledgers, usage, limits and sessions as Structured Streaming jobs.

Every job reads a stream (session_id, ts, ...), runs until its input is used up (availableNow) and
returns its result as a table. State and results live in shared storage, so a job that is started
again on the same place goes on where it stopped. Rows later than a job's delay are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codexloom.sources import store


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A stream over one Parquet table of a folder, in the ledger's columns; times become UTC timestamps."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return e.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 20).alias("book_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
                    F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("long").alias("chunk_key"))


def _run(df: DataFrame, place: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jpath):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


#: Parts of the stored ledger, by a hash of the key.
BUCKETS = 64


def stream_ledger(stream: DataFrame, place: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """First citation per (session_id, chunk_id), across batches and restarts.

    The stored ledger is partitioned by a hash of the key. Every batch is held against the parts that its own keys fall
    into, by an anti-join, and replaces only its own folders there, so a batch that runs again does not count twice.
    """
    spark = stream.sparkSession
    place = place or store.scratch(spark)
    path, schema = f"{place}/ledger", "session_id long, chunk_id long, us long, bucket int, batch long"
    keys = ["session_id", "chunk_id"]

    def each(df: DataFrame, batch: int) -> None:
        session = df.sparkSession
        first = store.stage(df.groupBy(*keys).agg(F.min("us").alias("us")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        own = [r[0] for r in first.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        known = _read(session, path, schema).where(F.col("bucket").isin(own) & (F.col("batch") != batch)).select("bucket", *keys)
        new = first.join(known, ["bucket", *keys], "left_anti").withColumn("batch", F.lit(batch).cast("long"))
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    _run(stream.select("session_id", F.col("chunk_key").alias("chunk_id"), F.unix_micros("ts").alias("us")), place, "append", each)
    return _read(spark, path, schema).drop("bucket", "batch")


def stream_ledger_recent(stream: DataFrame, delay: str = "30 days", place: str | None = None) -> DataFrame:
    """(session_id, chunk_id, us) with state that is bounded by a delay: a repeat within it is dropped, a later one counts again.

    Nothing stored is read; the state holds the keys that the watermark has not passed. ``us`` is the
    time of the row that came first.
    """
    spark = stream.sparkSession
    place = place or store.scratch(spark)
    s = stream.select("session_id", F.col("chunk_key").alias("chunk_id"), "ts").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session_id", "chunk_id"])
    s = s.select("session_id", "chunk_id", F.unix_micros("ts").alias("us"))

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{place}/recent/part={batch}")

    _run(s, place, "append", each)
    return _read(spark, f"{place}/recent", "session_id long, chunk_id long, us long").select("session_id", "chunk_id", "us")


def _latest(stream: DataFrame, keys: list[str], place: str | None, mode: str = "update") -> DataFrame:
    """Run a keyed aggregation and return the last row that it gave for every key."""
    spark = stream.sparkSession
    place = place or store.scratch(spark)
    columns, schema = stream.columns, T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def each(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{place}/out/part={batch}")

    _run(stream, place, mode, each)
    got = _read(spark, f"{place}/out", schema)
    rest = [c for c in columns if c not in keys]
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(*keys, *[f"_l.{c}" for c in rest])


def stream_usage(stream: DataFrame, prices: DataFrame, place: str | None = None) -> DataFrame:
    """Tokens and exact cost per session; stream (session_id, model, input_tokens, output_tokens), prices a small static table."""
    j = stream.join(prices, "model", "left")
    d = lambda c: F.col(c).cast("decimal(18,0)")
    cost = F.coalesce(d("input_tokens") * F.col("input_per_1m") + d("output_tokens") * F.col("output_per_1m"), F.lit(0)).cast("decimal(28,9)")
    g = j.groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(cost).alias("cost_micro"))
    return _latest(g, ["session_id"], place)


def rate_limit(stream: DataFrame, length: str, limit: int, client: str = "session_id", delay: str = "10 minutes", place: str | None = None) -> DataFrame:
    """(client, start_us, n) of the tumbling windows in which a client exceeded its limit."""
    g = stream.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), client).agg(F.count(F.lit(1)).alias("n"))
    g = g.select(client, F.unix_micros(F.col("w.start")).alias("start_us"), "n").where(F.col("n") > limit)
    return _latest(g, [client, "start_us"], place)


def clarify_outcomes(asks: DataFrame, answers: DataFrame, minutes: int = 30, horizon: str = "6 hours", delay: str = "1 hour", place: str | None = None) -> DataFrame:
    """(session_id, ask_us, outcome, answer_us): whether a question was answered in time, late or never.

    asks and answers are streams (session_id, ts). A stream-stream outer join pairs them within the
    horizon; an answer counts for the pending question, that is the session's last one before it.
    Exactly ``minutes`` is still in time. Questions whose horizon the watermark has not passed may
    be missing.
    """
    spark = asks.sparkSession
    place = place or store.scratch(spark)
    a = asks.select("session_id", F.col("ts").alias("ask_ts")).withWatermark("ask_ts", delay)
    b = answers.select(F.col("session_id").alias("_s"), F.col("ts").alias("answer_ts")).withWatermark("answer_ts", delay)
    j = a.join(b, F.expr(f"session_id = _s and answer_ts >= ask_ts and answer_ts <= ask_ts + interval {horizon}"), "leftOuter")
    j = j.select("session_id", F.unix_micros("ask_ts").alias("ask_us"), F.unix_micros("answer_ts").alias("answer_us"))

    def each(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{place}/out/part={batch}")

    _run(j, place, "append", each)
    got = _read(spark, f"{place}/out", j.schema)
    per = got.groupBy("session_id", "ask_us").agg(F.min("answer_us").alias("answer_us"))
    w = Window.partitionBy("session_id").orderBy("ask_us")
    per = per.withColumn("_next", F.lead("ask_us").over(w)).withColumn("answer_us", F.when(F.col("_next").isNull() | (F.col("answer_us") < F.col("_next")), F.col("answer_us")))
    outcome = F.when(F.col("answer_us").isNull(), "never").when(F.col("answer_us") - F.col("ask_us") <= minutes * 60_000_000, "in_time").otherwise("late")
    return per.select("session_id", "ask_us", outcome.alias("outcome"), "answer_us")


def session_activity(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", place: str | None = None) -> DataFrame:
    """(session_id, start_us, end_us, n) of bursts of activity that the watermark has closed."""
    g = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count(F.lit(1)).alias("n"))
    g = g.select("session_id", F.unix_micros(F.col("w.start")).alias("start_us"), F.unix_micros(F.col("w.end")).alias("end_us"), "n")
    return _latest(g, ["session_id", "start_us", "end_us"], place, mode="append")


def stream_progress(stream: DataFrame, place: str | None = None) -> DataFrame:
    """Running number of distinct cited chunks per book: stream (book_id, chunk_id)."""
    g = stream.select("book_id", "chunk_id").dropDuplicates(["book_id", "chunk_id"]).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_cited"))
    return _latest(g, ["book_id"], place)


#: Logarithm of a progress sketch's registers: a standard error of 0.8 %.
REGISTERS = 14


def stream_progress_sketches(stream: DataFrame, place: str | None = None) -> DataFrame:
    """(book_id, part, sketch): one sketch of the distinct cited chunks per book and batch; stream (book_id, chunk_id).

    The stream keeps no state, and a batch that runs again replaces its own sketches. Sketches of batches, runs and places merge;
    see ``progress_estimates``.
    """
    spark = stream.sparkSession
    place = place or store.scratch(spark)

    def each(df: DataFrame, batch: int) -> None:
        df.where("chunk_id is not null").groupBy("book_id").agg(F.hll_sketch_agg("chunk_id", F.lit(REGISTERS)).alias("sketch")).write.mode("overwrite").parquet(f"{place}/sketches/part={batch}")

    _run(stream.select("book_id", "chunk_id"), place, "append", each)
    kind = stream.schema["book_id"].dataType.simpleString()
    return _read(spark, f"{place}/sketches", f"book_id {kind}, part int, sketch binary")


def progress_estimates(sketches: DataFrame) -> DataFrame:
    """(book_id, n_cited): about how many distinct chunks all sketches of a book have seen together."""
    return sketches.groupBy("book_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_cited"))
