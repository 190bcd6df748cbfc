import pytest
from pyspark.sql import functions as F

from tideglass.functions import columns as fc


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("value", "mode", "want"), [
    ("password123", "partial", "pa***23"), ("hello", "partial", "he***lo"), ("abcd", "partial", "[***]"), ("", "partial", ""), ("x", "full", "[REDACTED]"), ("", "full", ""),
    ("x", "hash", "[HASH:2d711642b726b044]"), (None, "full", None),
])
def test_redaction(spark, value, mode, want):
    assert one(spark, fc.redact(F.lit(value).cast("string"), mode)) == want


def test_attributes_are_redacted_by_key(spark):
    m = F.create_map(*[F.lit(x) for x in ("PassWord", "abc", "my_email", "someone", "plain", "abc", "pin", "1234")])
    assert one(spark, fc.redact_attributes(m, [("pin", "full")])) == {"PassWord": "[REDACTED]", "my_email": "so***ne", "plain": "abc", "pin": "[REDACTED]"}


@pytest.mark.parametrize(("total", "errors", "want"), [(0, 0, "unknown"), (1000, 9, "healthy"), (1000, 10, "degraded"), (1000, 49, "degraded"), (1000, 50, "unhealthy")])
def test_health(spark, total, errors, want):
    assert one(spark, fc.health(F.lit(total), F.lit(errors))) == want


@pytest.mark.parametrize(("code", "want"), [("200", "success"), ("302", "redirect"), ("404", "client_error"), ("500", "server_error"), ("0", None), ("-1", None), ("x", None)])
def test_status_bucket(spark, code, want):
    assert one(spark, fc.status_bucket(F.lit(code))) == want


def test_times(spark):
    assert one(spark, F.unix_micros(fc.ns_to_timestamp(F.lit(1999).cast("long")))) == 1
    assert one(spark, F.unix_micros(fc.ns_to_timestamp(F.lit(-1999).cast("long")))) == -1
    assert one(spark, F.unix_micros(fc.epoch_to_timestamp(F.lit(1_700_000_000_000)))) == 1_700_000_000_000_000
    assert one(spark, fc.epoch_to_timestamp(F.lit(5))) is None
    assert [one(spark, fc.level_from_status(F.lit(c))) for c in (200, 404, 500)] == ["info", "warn", "error"]


def test_ulids_sort_by_time_and_differ_by_entropy(spark):
    t = [F.timestamp_millis(F.lit(ms)) for ms in (1_469_918_176_385, 1_469_918_176_386)]
    a, b, c = (one(spark, fc.ulid(x, F.lit(e))) for x, e in ((t[0], "a"), (t[0], "b"), (t[1], "a")))
    assert len(a) == 26 and a[:10] == "01ARYZ6S41" == b[:10] and a != b and c > a and set(a) <= set("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
