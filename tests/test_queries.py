"""Every registered telemetry query against its DuckDB text, and what the plans look like."""

import datetime as dt
import decimal

import duckdb
import pytest

from tideglass.plans import registry
from tideglass.plans import telemetry as q
from tideglass.plans.predicates import Contains, OneOf, Since, Status
from tideglass.schemas import HTTP_LOGGER, LOGS, SPANS
from tideglass.sources import catalog, derived

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(v):
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, float):
        return round(v, 5)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    res = duck.execute(registry.SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(repr([plain(row[names.index(c)]) for c in columns]) for row in res.fetchall())
    assert sorted(names) == columns and got == want


def log(id, service="web", latency=None, status=None, level="info", logger=HTTP_LOGGER, message="GET /x", ts=1):
    a = f'{{"http.latency_ms":"{latency}","http.status_code":"{status}"}}' if status else None
    return (id, dt.datetime.fromtimestamp(ts, dt.UTC), level, None, message, a, logger, None, None, None, None, None, None, service, "1970-01-01")


def span(id, service, latency, status, name="GET /api"):
    t = dt.datetime.fromtimestamp(1, dt.UTC)
    return (id, None, None, name, "/api", "GET", status, latency, False, t, t, None, service, "1970-01-01")


def test_two_sources_are_one_population(spark):
    logs = spark.createDataFrame([log("1", "web", 150.0, 404), log("2", "api", 12.5, 200), log("3", logger="app")], LOGS)
    spans = spark.createDataFrame([span("a", "web", 42.5, 200), span("b", "web", 77.0, 500)], SPANS)
    per = {r.service: r for r in q.latency_by_service(spans, logs).collect()}
    assert (per["web"].sum_ms, per["web"].cnt, per["api"].sum_ms, per["api"].cnt) == (269.5, 3, 12.5, 1)
    assert {r.status_code: r.cnt for r in q.status_codes(spans, logs).collect()} == {"200": 2, "404": 1, "500": 1}
    assert 12.5 <= q.latency_percentiles(spans, logs).first().p50 <= 150
    assert q.request_count(spans, logs, [Contains("nonexistent")]).first().total == 0
    assert q.request_count(spans, logs, [Status(">=", 400)]).first().total == 2
    assert q.request_count(spans, logs, [OneOf("level", ("trace",))]).first().total == 0


def test_a_middle_latency_is_exact(spark):
    logs = spark.createDataFrame([log("1", "web", 42.5, 200), log("2", "web", 77.0, 500), log("3", "api", 12.5, 200)], LOGS)
    assert q.latency_percentiles(spark.createDataFrame([], SPANS), logs).first().p50 == 42.5


def test_empty_tables_give_zeros_and_full_spines(spark):
    logs, spans = spark.createDataFrame([], LOGS), spark.createDataFrame([], SPANS)
    assert tuple(q.summary(logs).first()) == (0, 0, 0, 0)
    assert {tuple(r) for r in q.health_counts(logs).collect()} == {(h, 0) for h in ("healthy", "degraded", "unhealthy", "unknown")}
    rows = q.histogram_filled(logs, 0, 2 * 86_400_000_000, "day").collect()
    assert len(rows) == 12 and {r.level for r in rows} == {"info", "warn", "error", "debug"} and not any(r.cnt for r in rows)
    assert q.latency_percentiles(spans, logs).first().p50 is None


def test_histogram_lowers_levels_and_drops_blank_and_outer_rows(spark):
    rows = [log("1", level="ERROR", ts=60), log("2", level=None, ts=60), log("3", level=" ", ts=60), log("4", level="error", ts=86400 * 9), log("5", level="error", ts=13 * 3600)]
    got = q.histogram_filled(spark.createDataFrame(rows, LOGS), 0, 86_400_000_000 - 1, "12-hour").orderBy("bucket").collect()
    assert [(r.level, r.cnt) for r in got] == [("error", 1), ("error", 1)]
    series = q.histogram_series(q.histogram_filled(spark.createDataFrame(rows, LOGS), 0, 86_400_000_000 - 1, "12-hour")).first()
    assert (series.buckets, series.counts) == (["01/01 00:00", "01/01 12:00"], [1, 1])


def test_a_time_window_prunes_day_partitions_and_columns(spark, tmp_path):
    catalog.append(derived.logs(spark, SF), str(tmp_path), "logs")
    df = q.by_day(catalog.scan(spark, str(tmp_path), "logs"), [OneOf("service", ("svc-1",)), Since(registry.NOW_MICROS - 3 * 86_400_000_000)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "date#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThan(timestamp" in plan.split("PushedFilters")[1] and "message" not in plan.split("ReadSchema")[1]
    assert sum(r.cnt for r in df.collect()) > 0


def test_pages_neither_overlap_nor_leave_gaps(spark):
    logs = derived.logs(spark, SF)
    pages = [r.id for k in range(4) for r in q.log_page(logs, limit=250, page=k).collect()]
    assert len(pages) == len(set(pages)) == logs.count()
