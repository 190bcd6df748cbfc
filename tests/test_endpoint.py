import datetime as dt
import json
import threading
import urllib.error
import urllib.request

import pytest

from tideglass import __version__
from tideglass.functions import columns as fc
from tideglass.operators.endpoint import Endpoint, QueryError, guard
from tideglass.operators.server import Server
from tideglass.schemas import LOGS
from tideglass.sources.catalog import Catalog, append, scan
from tideglass.streaming.ingest import Tail


def rows(n, service="api", day=15, start=0):
    t = dt.datetime(2024, 1, day, tzinfo=dt.UTC)
    return [(f"{service}-{day}-{start + i}", t, "info", None, f"m{i}", None, None, None, None, None, None, None, None, service, f"2024-01-{day}") for i in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    append(spark.createDataFrame(rows(3) + rows(2, "worker", 16), LOGS), str(tmp_path), "logs")
    catalog = Catalog(spark, str(tmp_path))
    fc.register(spark)
    return str(tmp_path), Endpoint(spark, before=catalog.ensure)


def test_star_has_partition_columns_last_and_prunes(store):
    _, e = store
    r = e.query("SELECT * FROM logs WHERE service = 'api' AND date = '2024-01-15'")
    assert r.row_count == 3 and r.columns == LOGS.names and r.columns[4] == "message" and r.columns[-2:] == ["service", "date"]
    assert r.rows[0][1] == 1_705_276_800_000_000


@pytest.mark.parametrize("sql", [
    "INSERT INTO logs SELECT * FROM logs", "DELETE FROM logs", "UPDATE logs SET id = '1'", "DROP TABLE logs", "CREATE TABLE t AS SELECT 1", "COPY logs TO 'x'",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
    "FROM logs INSERT INTO t SELECT id INSERT INTO u SELECT id", "CALL x.y()", "EXECUTE IMMEDIATE 'SELECT 1'", "BEGIN SELECT 1; END", "SET a=b", "EXPLAIN SELECT 1",
    "SHOW TABLES", "CACHE TABLE logs", "USE x", "REFRESH TABLE logs", "DECLARE x INT", "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE", "TRUNCATE TABLE logs",
    "ADD JAR x", "SELECT TRANSFORM(id) USING 'cat' FROM logs", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT (SELECT reflect('java.lang.Math', 'abs', 1))",
    "WITH a AS (SELECT reflect('a', 'b')) SELECT * FROM a", "SELECT 1 WHERE EXISTS (SELECT java_method('a', 'b'))", "garbage",
])
def test_only_queries_pass(spark, sql):
    with pytest.raises(QueryError):
        guard(spark, sql)


def test_files_cannot_be_named(store):
    with pytest.raises(QueryError):
        store[1].query("SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`")


@pytest.mark.parametrize(("sql", "n"), [
    ("SELECT * FROM range(20000)", 10_000), ("SELECT * FROM range(20000) LIMIT 15000", 10_000), ("SELECT * FROM range(200) LIMIT 5", 5), ("SELECT * FROM (SELECT * FROM range(100) LIMIT 3)", 3),
    ("WITH a AS (SELECT * FROM range(100) LIMIT 3) SELECT * FROM a;", 3),
])
def test_row_cap(store, sql, n):
    assert store[1].query(sql).row_count == n


def test_a_late_query_is_cancelled_and_the_endpoint_goes_on(spark):
    e = Endpoint(spark, timeout=1.5)
    with pytest.raises(QueryError, match="timeout"):
        e.query("SELECT count(*) FROM range(200000) a CROSS JOIN range(200000) b WHERE a.id * b.id % 7 = 3")
    e.timeout = 30
    assert e.query("SELECT 1 AS x").rows == [[1]]


def test_values_have_json_forms_or_the_query_fails(store):
    r = store[1].query("SELECT double('NaN') a, array(1, null) b, CAST('1.50' AS DECIMAL(5,2)) c, CAST('2.00' AS DECIMAL(5,2)) d, date'2024-01-02' e, timestamp'1970-01-01 00:00:01Z' f, null g")
    assert json.loads(json.dumps(r.to_dict()))["rows"] == [[None, [1, None], 1.5, 2, "2024-01-02", 1_000_000, None]]
    with pytest.raises(QueryError, match="map"):
        store[1].query("SELECT map('a', 1) m")


def test_names_that_telemetry_sql_uses(store):
    r = store[1].query("""SELECT json_get_str('{"a.b":"x","n":5}', 'a.b'), json_get_str('{bad', 'a'), json_get_int('{"n":"5"}', 'n'), json_get_float('{"n":"x"}', 'n'),
        json_contains('{"n":5}', 'n'), to_timestamp_micros(7), approx_percentile_cont(id, 0.5) FROM range(3)""")
    assert r.rows == [["x", None, 5, None, True, 7, 1]]


def test_new_files_show_after_the_list_expires(spark, tmp_path):
    clock, base = [0.0], str(tmp_path)
    append(spark.createDataFrame(rows(1), LOGS), base, "logs")
    c = Catalog(spark, base, ttl=10, clock=lambda: clock[0])
    assert c.table("logs").count() == 1
    append(spark.createDataFrame(rows(1, start=1), LOGS), base, "logs")
    assert c.table("logs").count() == 1
    clock[0] = 11
    assert c.table("logs").count() == 2


def test_missing_store_and_stray_files(spark, tmp_path):
    assert scan(spark, str(tmp_path / "none"), "logs").columns == LOGS.names and scan(spark, str(tmp_path / "none"), "spans").count() == 0
    append(spark.createDataFrame(rows(1), LOGS), str(tmp_path), "logs")
    part = next(tmp_path.glob("data/table_type=logs/*/*"))
    (part / "stray.tmp").write_text("x")
    (part / ".hidden").write_text("x")
    assert scan(spark, str(tmp_path), "logs").count() == 1


def test_http(store, tmp_path):
    (tmp_path / "package.json").write_text('{"name":"shop","dependencies":{"express":"1","next":"1"}}')
    server = Server(store[1], 0, str(tmp_path))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"

    def post(sql):
        return json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/query", json.dumps({"sql": sql}).encode())))

    assert post("SELECT count(*) AS n FROM logs") == {"columns": ["n"], "rows": [[5]], "row_count": 1}
    with pytest.raises(urllib.error.HTTPError) as e:
        post("DROP TABLE logs")
    assert e.value.code == 400 and e.value.read().startswith(b"Query failed: ")
    assert json.load(urllib.request.urlopen(f"{url}/health"))["status"] == "ok"
    (tmp_path / "go.mod").write_text("module example.org/x/y\n")
    assert json.load(urllib.request.urlopen(f"{url}/detect")) == [
        {"service_name": "shop", "language": "Node.js", "framework": "Next.js", "project_file": "package.json"},
        {"service_name": "example.org/x/y", "language": "Go", "framework": None, "project_file": "go.mod"},
    ]
    used = json.load(urllib.request.urlopen(f"{url}/resources"))
    assert used["cpu"]["cores"] > 0 and 0 <= used["cpu"]["global_usage_percent"] <= 100 and used["memory"]["total_bytes"] > 0 and used["disk"] and len(used["load_avg"]) == 3
    assert all(n["rx_bytes_per_sec"] >= 0 for n in used["network"])
    assert json.load(urllib.request.urlopen(f"{url}/status")) == {"status": "running", "version": __version__, "dropped_events": 0, "buffer_occupancy": 0}
    preflight = urllib.request.urlopen(urllib.request.Request(f"{url}/query", method="OPTIONS"))
    assert preflight.status == 200 and "POST" in preflight.headers["Access-Control-Allow-Methods"] and preflight.headers["Access-Control-Allow-Origin"] == "*"
    server.shutdown()


def test_live_events_over_http(store):
    tail = Tail()
    server = Server(store[1], 0, tail=tail)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/tail")
    while not tail.queues:
        pass
    tail.publish("logs", store[1].spark.createDataFrame([("a", 1)], "id string, n int"))
    assert got.readline() == b'data: {"table":"logs","id":"a","n":1}\n'
    got.close()
    server.shutdown()


@pytest.mark.parametrize(("sql", "want"), [
    ("SELECT CAST(5 AS VARCHAR) AS x, 7::varchar AS y, CAST('VARCHAR' AS TEXT) AS z", [["5", "7", "VARCHAR"]]),
    ("SELECT CAST(timestamp'1970-01-01 00:00:02Z' AS BIGINT) AS t, CAST('8' AS BIGINT) AS n, CAST(2.9 AS BIGINT) AS d", [[2_000_000, 8, 2]]),
    ("""SELECT "id" FROM (SELECT 3 AS "id") t WHERE "id" > 1 AND '"id"' <> 'x' -- "no""", [[3]]),
    ("""SELECT '{"a":{"b":[1,"x"]}}' -> 'a' -> 'b' ->> 1 AS v, '{"a":1}' ? 'a' AS h""", [["x", True]]),
    ("""SELECT json_get_json('{"a":{"b":1}}', 'a') j, json_get_array('{"a":[1,"x",null]}', 'a') l, json_get_int('[4,5]', '1') i, json_as_text('{"n":1.5}', 'n') n, json_length('[1,2]') c, json_get('bad', 'a') b""",
     [['{"b":1}', ["1", "x", None], 5, "1.5", 2, None]]),
    ("SELECT now() - INTERVAL '7 days' < now() AS a, now() - INTERVAL '15' MINUTE < now() AS b", [[True, True]]),
    ("SELECT k, max(n) AS n FROM (SELECT id % 2 AS k, id AS n FROM range(5)) GROUP BY k ORDER BY k", [[0, 4], [1, 3]]),
    ("SELECT percentile(id, 0.5) AS p FROM range(5)", [[2.0]]),
])
def test_telemetry_dialect(store, sql, want):
    assert store[1].query(sql).rows == want
