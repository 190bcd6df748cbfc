"""Telemetry views over the star-schema tables: logs from events, spans from orders, metrics from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.schemas import HTTP_LOGGER, LOGS, METRICS, SPANS

#: The instant that relative time windows end at.
NOW_MICROS = 1_706_659_200_000_000  # 2024-01-31 00:00:00 UTC


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumns({
        "k": F.get_json_object("props", "$.k").cast("int"),
        "svc": F.col("user_id") % 5,
        "http": F.col("event_type").isin("view", "purchase", "error"),
        "ts": F.col("ts").cast("timestamp"),
    })
    k, svc, kind = F.col("k"), F.col("svc"), F.col("event_type")
    status = (
        F.when(~F.col("http"), F.lit(None).cast("int"))
        .when((kind == "error") & ((svc == 0) | ((svc == 1) & (k >= 10))), 404)
        .when(kind == "error", 500 + k % 4)
        .when(kind == "purchase", 201)
        .when(k < 10, 404)
        .otherwise(200)
    )
    e = e.withColumn("status", status)
    code = F.col("status")
    level = F.when(F.col("http"), F.when(code >= 500, "error").when(code >= 400, "warn").otherwise("info"))
    level = level.when(kind == "signup", "debug").when((kind == "click") & (k < 5) & (svc != 0), "fatal").otherwise("info")
    attributes = F.when(
        F.col("http"),
        F.format_string(
            '{"http.latency_ms":"%s","http.method":"GET","http.route":"/%s","http.status_code":"%s"}',
            F.col("value").cast("string"), kind, code.cast("string"),
        ),
    ).otherwise(F.col("props"))
    boom = kind == "error"
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), level.alias("level"), F.lit(None).cast("string").alias("route"),
        F.concat(kind, F.lit(" user "), F.col("user_id").cast("string")).alias("message"), attributes.alias("attributes"),
        F.when(F.col("http"), HTTP_LOGGER).otherwise("app").alias("logger_name"),
        F.when(~F.col("http"), "app.py").alias("file"), F.when(~F.col("http"), k).alias("line"),
        F.concat(F.lit("corr-"), F.col("user_id").cast("string")).alias("correlation_id"),
        F.when(boom, F.array(F.lit("frame a"), F.lit("frame b"))).alias("stack_trace"),
        F.when(boom, F.concat(F.lit("Err"), (k % 3).cast("string"))).alias("exception_type"),
        F.when(boom, F.concat(F.lit("boom "), k.cast("string"))).alias("exception_message"),
        F.concat(F.lit("svc-"), svc.cast("string")).alias("service"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
    ).select(*LOGS.names)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    state = F.col("o_orderstatus")
    start = F.lit(1_704_067_200_000_000) + (F.col("o_orderkey") % 43200) * 60_000_000
    latency = F.col("o_totalprice") / 1000
    route = F.concat(F.lit("/orders/"), F.substring("o_orderpriority", 1, 1))
    method = F.when(state == "O", "GET").when(state == "F", "POST").otherwise("PUT")
    nothing = F.lit(None).cast("string")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("corr-"), (F.col("o_custkey") % 150).cast("string")).alias("correlation_id"),
        nothing.alias("parent_correlation_id"), F.concat(method, F.lit(" "), route).alias("name"), route.alias("route"), method.alias("method"),
        F.when(state == "O", 200).when(state == "F", 404).otherwise(503).alias("status_code"), latency.alias("latency_ms"), F.lit(False).alias("is_error"),
        F.timestamp_micros(start).alias("start_time"), F.timestamp_micros(start + F.floor(latency * 1000)).alias("end_time"), nothing.alias("attributes"),
        F.concat(F.lit("svc-"), (F.col("o_custkey") % 5).cast("string")).alias("service"),
        F.date_format(F.timestamp_micros(start), "yyyy-MM-dd").alias("date"),
    ).select(*SPANS.names)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "lineitem")
    return m.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit("metric."), F.col("l_returnflag")).alias("name"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.col("l_quantity").cast("double").alias("value"), F.format_string('{"linestatus":"%s"}', F.col("l_linestatus")).alias("labels"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 5).cast("string")).alias("service"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
    ).select(*METRICS.names)


VIEWS = {"logs": logs, "spans": spans, "metrics": metrics}


def register(spark: SparkSession, sf_dir: str) -> None:
    for name, view in VIEWS.items():
        view(spark, sf_dir).createOrReplaceTempView(name)
