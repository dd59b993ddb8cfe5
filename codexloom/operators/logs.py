"""Request logs as JSON text: written, read back field by field, paired and summed up.

A field that is absent differs from one that is null, and numbers from strings that look like numbers:
lines are kept as variants, whose fields have types of their own.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codexloom.operators.scans import before_ranges
from codexloom.sources.store import stage

#: Values that a quantile sketch keeps; up to so many it is exact, beyond its rank error is about 1.7 divided by their number.
SKETCH = 4096
CONTEXT = ("request_id", "session_id", "book_id")


def log_lines(records: DataFrame, *extras: str) -> DataFrame:
    """(line): one JSON object per record (time_us, level, logger, msg, context fields, extras).

    Context fields without a value and null extras are left out, not written as null; extras keep their types.
    """
    time = F.concat(F.date_format(F.timestamp_micros("time_us"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("time")
    context = [F.when(F.col(c).cast("string") != "", F.col(c).cast("string")).alias(c) for c in CONTEXT]
    return records.select(F.to_json(F.struct(time, "level", "logger", "msg", *context, *extras), {"ignoreNullFields": "true"}).alias("line"))


def read_logs(lines: DataFrame) -> DataFrame:
    """(time_us, level, logger, msg, request_id, session_id, book_id, fields, malformed) of text lines (line).

    ``fields`` is the whole line as a variant, for ``kind_of`` and ``number``. A line that is no JSON object is malformed and has no other value.
    """
    v = lines.select(F.try_parse_json("line").alias("fields"))
    whole = F.coalesce(F.schema_of_variant("fields").startswith("OBJECT"), F.lit(False))
    text = lambda c: F.try_variant_get("fields", f"$.{c}", "string").alias(c)
    v = v.select(F.when(whole, F.col("fields")).alias("fields"), (~whole).alias("malformed"))
    time = F.unix_micros(F.try_to_timestamp(F.try_variant_get("fields", "$.time", "string"))).alias("time_us")
    return v.select(time, *map(text, ("level", "logger", "msg", *CONTEXT)), "fields", "malformed")


def kind_of(fields: Column | str, name: str) -> Column:
    """absent, null, number, string, boolean or nested."""
    kind = F.schema_of_variant(F.try_variant_get(fields, f"$.{name}", "variant"))
    return (F.when(kind.isNull(), "absent").when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
            .when(kind.rlike("^(ARRAY|OBJECT)"), "nested").otherwise("number"))


def number(fields: Column | str, name: str) -> Column:
    """An extra's value where it is a number; strings that look like numbers are none."""
    return F.when(kind_of(fields, name) == "number", F.try_variant_get(fields, f"$.{name}", "double"))


def http_requests(logs: DataFrame) -> DataFrame:
    """(request_id, session_id, start_us, method, path, took_ms, status) from the paired request_start and request_end rows of ``read_logs``.

    A request without an end has no took_ms and status 500; its last end counts, by time.
    """
    f = lambda c: F.try_variant_get("fields", f"$.{c}", "string")
    rows = logs.where("msg in ('request_start', 'request_end') and request_id is not null")
    rows = rows.select("request_id", "session_id", "time_us", "msg", f("method").alias("method"), f("path").alias("path"), number("fields", "took_ms").alias("took_ms"), number("fields", "status").cast("int").alias("status"))
    end = F.col("msg") == "request_end"
    last = F.max_by(F.struct("took_ms", "status"), F.when(end, F.struct("time_us", "took_ms", "status")))
    g = rows.groupBy("request_id").agg(F.min(F.when(~end, F.col("time_us"))).alias("start_us"), last.alias("_e"), *[F.max(c).alias(c) for c in ("session_id", "method", "path")])
    return g.select("request_id", "session_id", "start_us", "method", "path", F.col("_e.took_ms").alias("took_ms"), F.coalesce("_e.status", F.lit(500)).alias("status"))


def latency_sketches(requests: DataFrame, *keys: str | Column, size: int = SKETCH) -> DataFrame:
    """(keys, n_requests, n_failed, sketch): a mergeable quantile sketch of took_ms per key; store it per hour or day, and merge what is asked for."""
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("status") >= 500).alias("n_failed"), F.kll_sketch_agg_double("took_ms", F.lit(size)).alias("sketch"))


def latency(sketches: DataFrame, *keys: str, percentiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(keys, n_requests, n_failed, p50, p95, ...) of merged sketches; requests without an end have no latency, and without any all percentiles are null."""
    g = sketches.groupBy(*keys).agg(F.sum("n_requests").alias("n_requests"), F.sum("n_failed").alias("n_failed"), F.kll_merge_agg_double("sketch").alias("_s"))
    some = F.kll_sketch_get_n_double("_s") > 0
    return g.select(*keys, "n_requests", "n_failed", *[F.when(some, F.kll_sketch_get_quantile_double("_s", F.lit(p))).alias(f"p{p * 100:g}") for p in percentiles])


def exact_latency(requests: DataFrame, *keys: str, percentiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """What ``latency`` estimates, exactly: the p-th percentile is the least took_ms that at least the share p of the key's known ones do not exceed.

    Equal values are counted first. Sorted ranges of the counts are summed apart and carried from range to range, so no task holds a key's values.
    """
    totals = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("status") >= 500).alias("n_failed"), F.count("took_ms").alias("_known"))
    values = requests.where("took_ms is not null").groupBy(*keys, "took_ms").agg(F.count(F.lit(1)).alias("_n"))
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stage(values.repartitionByRange(n, *keys, "took_ms").withColumn("_range", F.spark_partition_id()))
    first = before_ranges(held.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum")), list(keys), "_range", _before=F.sum("_sum"))
    w = Window.partitionBy(*keys, "_range").orderBy("took_ms").rowsBetween(Window.unboundedPreceding, 0)
    upto = held.withColumn("_upto", F.sum("_n").over(w)).join(first, [*keys, "_range"]).withColumn("_upto", F.col("_upto") + F.coalesce("_before", F.lit(0)))
    place = lambda p: F.greatest(F.ceil(F.col("_known") * F.lit(Decimal(str(p)))), F.lit(1))
    found = upto.join(totals.select(*keys, "_known"), [*keys]).groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= place(p), F.col("took_ms"))).alias(f"p{p * 100:g}") for p in percentiles])
    return totals.drop("_known").join(found, [*keys], "left")
