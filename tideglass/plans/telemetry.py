"""The telemetry queries, as functions of the logs, spans and metrics tables.

Each takes DataFrames and typed predicates and returns a lazy DataFrame: predicates reach the scan, and only
the columns a query names are read. Queries over HTTP requests take both sources, spans and log rows of the
HTTP logger, and translate the predicates for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.functions.columns import HEALTH_CLASSES, STATUS_BUCKETS, health, json_get_str, minute_bucket, status_bucket
from tideglass.plans.predicates import Predicate, arms, where
from tideglass.schemas import ERROR_LEVELS, HTTP_LOGGER, LATENCY_KEY, STATUS_KEY

#: percentile_approx keeps this many samples' precision: exact at any size these queries are compared at.
ACCURACY = 1_000_000
Predicates = list[Predicate]


def errors() -> Column:
    return F.col("level").isin(*ERROR_LEVELS)


def rows() -> Column:
    return F.count(F.lit(1))


def summary(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    """Events, errors, services seen, and services with more than 5 % errors."""
    per = logs.filter(where(ps)).groupBy("service").agg(rows().alias("n"), F.count_if(errors()).alias("e"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"), F.coalesce(F.sum("e"), F.lit(0)).alias("total_errors"),
        rows().alias("active_services"), F.count_if(F.col("e") * 1.0 / F.col("n") > 0.05).alias("unhealthy_services"),
    )


def by_day(logs: DataFrame, ps: Predicates = (), only_errors: bool = False) -> DataFrame:
    kept = logs.filter(where(ps))
    return (kept.filter(errors()) if only_errors else kept).groupBy("date").agg(rows().alias("cnt"))


def error_rate_by_day(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    """Days with errors and their share of the day's events, from one scan."""
    per = logs.filter(where(ps)).groupBy("date").agg(F.count_if(errors()).alias("e"), rows().alias("n")).filter("e > 0")
    return per.select("date", F.col("e").alias("cnt"), F.round(F.col("e") / F.col("n"), 4).alias("rate"))


def health_breakdown(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    return logs.filter(where(ps)).groupBy("service").agg(F.count_if(~F.coalesce(errors(), F.lit(False))).alias("healthy"), F.count_if(errors()).alias("errors"))


def top_services(logs: DataFrame, ps: Predicates = (), k: int = 5) -> DataFrame:
    return facet(logs, "service", ps).orderBy(F.desc("cnt"), F.asc_nulls_last("service")).limit(k)


def facet(logs: DataFrame, column: str, ps: Predicates = ()) -> DataFrame:
    """Counts by one column; null is an option of its own, but not for exception types."""
    kept = logs.filter(where(ps))
    return (kept.filter(F.col(column).isNotNull()) if column == "exception_type" else kept).groupBy(column).agg(rows().alias("cnt"))


def facets(logs: DataFrame, columns: list[str], ps: Predicates = ()) -> DataFrame:
    """Several columns' counts from one scan: (facet, value, cnt)."""
    kept = logs.filter(where(ps)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f"))
    return kept.groupBy("f.facet", "f.value").agg(rows().alias("cnt"))


def http_status_facet(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    kept = logs.filter(where(ps) & (F.col("logger_name") == HTTP_LOGGER))
    return kept.groupBy(json_get_str("attributes", STATUS_KEY).alias("code")).agg(rows().alias("cnt"))


def status_bucket_facet(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    """All four status classes with their counts; other codes count nowhere."""
    spark = logs.sparkSession
    got = http_status_facet(logs, ps).groupBy(status_bucket(F.col("code")).alias("bucket")).agg(F.sum("cnt").alias("cnt"))
    spine = spark.createDataFrame([(b,) for b in STATUS_BUCKETS], "bucket string")
    return spine.join(F.broadcast(got), "bucket", "left").select("bucket", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def requests(spans: DataFrame, logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    """HTTP requests of both sources: service, status_code (text), latency_ms."""
    on_spans, on_logs = arms(list(ps))
    typed = spans.filter(on_spans).select("service", F.col("status_code").cast("string").alias("status_code"), "latency_ms")
    attributes = F.from_json("attributes", "map<string,string>")
    http = logs.filter((F.col("logger_name") == HTTP_LOGGER) & on_logs).select("service", attributes.alias("a"))
    return typed.unionByName(http.select("service", F.col("a")[STATUS_KEY].alias("status_code"), F.col("a")[LATENCY_KEY].try_cast("double").alias("latency_ms")))


def percentiles(**named: float) -> tuple[Column, list[Column]]:
    """One digest for all shares (an aggregate called ``ps``), and the columns that take it apart."""
    digest = F.percentile_approx("latency_ms", list(named.values()), ACCURACY).alias("ps")
    return digest, [F.get("ps", F.lit(i)).alias(name) for i, name in enumerate(named)]


def latency_percentiles(spans: DataFrame, logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    digest, columns = percentiles(p50=0.5, p90=0.9, p95=0.95, p99=0.99)
    return requests(spans, logs, ps).agg(digest).select(*columns)


def status_codes(spans: DataFrame, logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    return requests(spans, logs, ps).groupBy("status_code").agg(rows().alias("cnt"))


def latency_by_service(spans: DataFrame, logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    """Sum and count stay apart, so partial results can be added; the count holds null latencies too."""
    digest, columns = percentiles(p50=0.5, p95=0.95, p99=0.99)
    out = requests(spans, logs, ps).groupBy("service").agg(F.sum("latency_ms").alias("s"), rows().alias("cnt"), digest)
    return out.select("service", F.round("s", 2).alias("sum_ms"), "cnt", F.round(F.col("s") / F.col("cnt"), 2).alias("avg_ms"), *columns)


def request_count(spans: DataFrame, logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    return requests(spans, logs, ps).agg(rows().alias("total"))


PAGE = ("id", "timestamp", "level", "service", "message", "attributes", "logger_name", "file", "line", "correlation_id")
ERROR_PAGE = ("id", "timestamp", "level", "service", "message", "line", "correlation_id", "exception_type", "exception_message")


def log_page(logs: DataFrame, ps: Predicates = (), limit: int = 500, page: int = 0, newest: bool = True) -> DataFrame:
    """One page; ties in time are broken by id, so pages neither overlap nor leave gaps."""
    order = [F.desc_nulls_last("timestamp"), F.desc("id")] if newest else [F.asc_nulls_last("timestamp"), F.asc("id")]
    out = logs.filter(where(ps)).select(*PAGE).orderBy(*order)
    return (out.offset(page * limit) if page else out).limit(limit)


def error_page(logs: DataFrame, ps: Predicates = (), limit: int = 1000) -> DataFrame:
    return logs.filter(where(ps) & errors()).select(*ERROR_PAGE).orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(limit)


def log_count(logs: DataFrame, ps: Predicates = (), only_errors: bool = False) -> DataFrame:
    kept = logs.filter(where(ps))
    return (kept.filter(errors()) if only_errors else kept).agg(rows().alias("total"))


def histogram(logs: DataFrame, ps: Predicates = (), unit: str = "minute") -> DataFrame:
    return logs.filter(where(ps)).groupBy(F.date_trunc(unit, "timestamp").alias("bucket"), "level").agg(rows().alias("cnt"))


STEPS = {"minute": "1 minute", "hour": "1 hour", "12-hour": "12 hours", "day": "1 day"}
DEFAULT_SERIES = ("info", "warn", "error", "debug")


def histogram_filled(logs: DataFrame, start_micros: int, end_micros: int, granularity: str = "12-hour", ps: Predicates = ()) -> DataFrame:
    """Counts by bucket and (lower-cased) level over a full range, zeros included.

    Rows outside the range and with a null or blank level do not count. Without any row there are four
    zero series. Counts of a level are folded into a map by bucket, as long as the range, and unfolded over it:
    levels are free text, so nothing about them is broadcast or joined.
    """
    spark = logs.sparkSession
    step = F.expr(f"INTERVAL {STEPS[granularity]}")
    unit = {"12-hour": "hour"}.get(granularity, granularity)

    def floor(ts: Column) -> Column:
        t = F.date_trunc(unit, ts)
        return F.date_trunc("day", t) + F.when(F.hour(t) < 12, F.expr("INTERVAL 0 hours")).otherwise(F.expr("INTERVAL 12 hours")) if granularity == "12-hour" else t

    level = F.lower(F.trim("level"))
    first, last = floor(F.timestamp_micros(F.lit(start_micros))), F.timestamp_micros(F.lit(end_micros))
    kept = logs.filter(where(ps)).filter((level != "") & (F.col("timestamp") >= first) & (F.col("timestamp") <= last))
    counts = kept.groupBy(floor(F.col("timestamp")).alias("bucket"), level.alias("level")).agg(rows().alias("cnt"))
    per = counts.groupBy("level").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("by"))
    none = spark.createDataFrame([(x,) for x in DEFAULT_SERIES], "level string").join(F.broadcast(kept.select(F.lit(1).alias("any")).limit(1)), F.lit(True), "left_anti")
    every = per.unionByName(none.withColumn("by", F.create_map().cast("map<timestamp,bigint>")))
    return every.withColumn("bucket", F.explode(F.sequence(first, last, step))).select("bucket", "level", F.coalesce(F.col("by")[F.col("bucket")], F.lit(0)).alias("cnt"))


LABELS = {"minute": "HH:mm", "hour": "MM/dd HH:00", "12-hour": "MM/dd HH:00", "day": "MM/dd"}


def histogram_series(filled: DataFrame, granularity: str = "12-hour") -> DataFrame:
    """One row a level: the bucket labels and the counts, in time order."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "cnt")))
    out = filled.groupBy("level").agg(pairs.alias("p"))
    return out.select("level", F.transform("p", lambda x: F.date_format(x["bucket"], LABELS[granularity])).alias("buckets"), F.transform("p", lambda x: x["cnt"]).alias("counts"))


def active_services(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    return logs.filter(where(ps)).select("service").distinct()


def service_health(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    """By service: events, rows at level ``error`` alone, their share, first seen, and the class of that share."""
    per = logs.filter(where(ps)).groupBy("service").agg(rows().alias("total"), F.count_if(F.col("level") == "error").alias("errors"), F.min("timestamp").alias("first_seen"))
    return per.select("service", "total", "errors", F.round(F.col("errors") / F.col("total"), 4).alias("error_rate"), "first_seen", health(F.col("total"), F.col("errors")).alias("health"))


def health_counts(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    got = service_health(logs, ps).groupBy("health").agg(rows().alias("n"))
    spine = logs.sparkSession.createDataFrame([(h,) for h in HEALTH_CLASSES], "health string")
    return spine.join(F.broadcast(got), "health", "left").select(F.col("health").alias("health_status"), F.coalesce("n", F.lit(0)).alias("count"))


def sparkline(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    return logs.filter(where(ps)).groupBy("service", minute_bucket(F.col("timestamp")).alias("bucket")).agg(rows().alias("cnt"))


def sparkline_series(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    """One row a service: its minutes' counts in time order, minutes without events left out."""
    pairs = F.array_sort(F.collect_list(F.struct("bucket", "cnt")))
    return sparkline(logs, ps).groupBy("service").agg(F.transform(pairs, lambda x: x["cnt"]).alias("counts"))


def sort_rows(df: DataFrame, column: str, ascending: bool = True, *then: str) -> DataFrame:
    """Rows by one column: numbers by value, everything else by its text; nulls as the text ``null``. ``then``: by
    these among equals."""
    number = df.schema[column].dataType
    own = F.col(column)
    if not isinstance(number, T.NumericType):
        own = F.coalesce(own.cast("string"), F.lit("null"))
    return df.orderBy(own.asc() if ascending else own.desc(), *then)


def service_inventory(logs: DataFrame, detected: DataFrame, ps: Predicates = ()) -> DataFrame:
    """Services that are detected (name, framework), active, or both."""
    active = service_health(logs, ps).withColumnRenamed("service", "name")
    out = detected.join(active, "name", "full_outer")
    seen = F.col("total").isNotNull()
    return out.select("name", "framework", F.when(seen, "active").otherwise("detected_only").alias("status"), F.when(seen, F.col("health")).otherwise("unknown").alias("health"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("errors", F.lit(0)).alias("errors"))


def service_drawer(logs: DataFrame, service: str, k: int = 5) -> DataFrame:
    """A service's newest events and errors: (kind, rank, id, timestamp, level, message)."""
    own = logs.filter(F.col("service") == service).select("id", "timestamp", "level", "message")
    order = [F.desc_nulls_last("timestamp"), F.desc("id")]
    out = [part.orderBy(*order).limit(k).withColumn("kind", F.lit(kind)) for kind, part in (("log", own), ("error", own.filter(errors())))]
    rank = Window.partitionBy("kind").orderBy(*order)  # over 2k rows
    return out[0].unionByName(out[1]).select("kind", F.row_number().over(rank).alias("rank"), "id", "timestamp", "level", "message")


def store_counts(logs: DataFrame, spans: DataFrame, metrics: DataFrame) -> DataFrame:
    one = [df.agg(rows().alias(n)) for df, n in ((logs, "log_count"), (spans, "span_count"), (metrics, "metric_count"))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))  # three single rows


def hourly_error_rate(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    per = logs.filter(where(ps)).groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(rows().alias("total"), F.count_if(errors()).alias("errors"))
    return per.select("hour", "total", "errors", F.round(F.col("errors") / F.col("total"), 4).alias("rate"))


def metric_rollup(metrics: DataFrame, unit: str = "month") -> DataFrame:
    return metrics.groupBy("service", "name", F.date_trunc(unit, "timestamp").alias("bucket")).agg(
        rows().alias("cnt"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 4).alias("mean")
    )


def correlated(logs: DataFrame, spans: DataFrame, correlation_id: str) -> DataFrame:
    """All that shares a correlation id, in time order: (source, id, at, service, what)."""
    a = logs.filter(F.col("correlation_id") == correlation_id).select(F.lit("log").alias("source"), "id", F.col("timestamp").alias("at"), "service", F.col("message").alias("what"))
    b = spans.filter(F.col("correlation_id") == correlation_id).select(F.lit("span").alias("source"), "id", F.col("start_time").alias("at"), "service", F.col("name").alias("what"))
    return a.unionByName(b).orderBy("at", "source", "id")


def frames_by_exception(logs: DataFrame, ps: Predicates = ()) -> DataFrame:
    """How often each stack frame occurs under each exception type."""
    kept = logs.filter(where(ps) & F.col("stack_trace").isNotNull())
    return kept.select("exception_type", F.explode("stack_trace").alias("frame")).groupBy("exception_type", "frame").agg(rows().alias("cnt"))


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)
