"""Scalar functions of the telemetry model as Column expressions; none runs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"


def json_get_str(json: Column | str, key: str) -> Column:
    """The value under one literal key (dots included); null if the text is no JSON object or lacks it."""
    return F.from_json(json, "map<string,string>")[key]


def json_get_int(json: Column | str, key: str) -> Column:
    return json_get_str(json, key).try_cast("bigint")


def json_get_float(json: Column | str, key: str) -> Column:
    return json_get_str(json, key).try_cast("double")


def to_timestamp_micros(n: Column) -> Column:
    return F.timestamp_micros(n)


def ns_to_timestamp(ns: Column) -> Column:
    """Nanoseconds to a timestamp in microseconds, toward zero."""
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def utc_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def level_from_status(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warn").when(status.isNotNull(), "info")


def status_bucket(code: Column) -> Column:
    """success, redirect, client_error or server_error; null unless the code is a positive number."""
    n = code.try_cast("int")
    return F.when(n >= 500, "server_error").when(n >= 400, "client_error").when(n >= 300, "redirect").when(n > 0, "success")


STATUS_BUCKETS = ("success", "redirect", "client_error", "server_error")


def health(total: Column, errors: Column) -> Column:
    """unknown without events, healthy below 1 % errors, degraded below 5 %, else unhealthy."""
    share = errors * 1.0 / F.when(total > 0, total)
    return F.when(total == 0, "unknown").when(share < 0.01, "healthy").when(share < 0.05, "degraded").otherwise("unhealthy")


HEALTH_CLASSES = ("healthy", "degraded", "unhealthy", "unknown")


def minute_bucket(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 60_000_000).cast("long")


def epoch_to_timestamp(n: Column) -> Column:
    """A number whose size tells its unit: microseconds, milliseconds or seconds; smaller ones are null."""
    micros = F.when(n >= 10**15, n).when(n >= 10**12, n * 1000).when(n >= 10**9, n * 1_000_000)
    return F.timestamp_micros(micros.cast("long"))


def redact(value: Column, mode: str) -> Column:
    """``full``; ``partial`` keeps two characters at either end; ``hash`` has 16 hex digits of SHA-256.
    Empty stays empty."""
    n = F.char_length(value)
    if mode == "full":
        out = F.lit(REDACTED)
    elif mode == "partial":
        out = F.when(n <= 4, "[***]").otherwise(F.concat(F.substring(value, 1, 2), F.lit("***"), F.right(value, F.lit(2))))
    elif mode == "hash":
        out = F.concat(F.lit("[HASH:"), F.substring(F.sha2(value, 256), 1, 16), F.lit("]"))
    else:
        raise ValueError(f"unknown redaction mode {mode!r}")
    return F.when(n == 0, value).otherwise(out) if mode != "full" else F.when(n == 0, value).when(value.isNotNull(), out)


#: Parts of attribute keys and what is done to their values; the first that fits counts.
REDACTION_RULES = (("password", "full"), ("token", "full"), ("secret", "full"), ("email", "partial"))


def redact_attributes(attributes: Column, rules=()) -> Column:
    """Redact a map's values by key; ``rules`` come before the built-in ones."""

    def value(k: Column, v: Column) -> Column:
        out = v
        for part, mode in reversed((*rules, *REDACTION_RULES)):
            out = F.when(F.contains(F.lower(k), F.lit(part.lower())), redact(v, mode)).otherwise(out)
        return out

    return F.transform_values(attributes, value)


def sorted_json(attributes: Column) -> Column:
    """A map as a JSON object with sorted keys; null for a null or empty map."""
    entries = F.array_sort(F.map_entries(attributes))
    return F.when(F.size(attributes) > 0, F.to_json(F.map_from_entries(entries)))


def content_id(*fields: Column) -> Column:
    """16 hex digits over the fields; a null differs from an empty text, and no text runs into the next."""
    parts = [F.coalesce(F.concat(F.char_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


#: One step into a JSON text ``j``: the value under key ``k`` of an object, or at index ``k`` of an array.
STEP = "coalesce(from_json(j, 'map<string,string>')[k], get(from_json(j, 'array<string>'), try_cast(k AS INT)))"
#: JSON functions of telemetry SQL: name, result type, body.
JSON_FUNCTIONS = (
    ("json_get", "STRING", STEP), ("json_get_json", "STRING", STEP), ("json_as_text", "STRING", STEP), ("json_get_str", "STRING", STEP), ("json_get_int", "BIGINT", f"try_cast({STEP} AS BIGINT)"),
    ("json_get_float", "DOUBLE", f"try_cast({STEP} AS DOUBLE)"), ("json_get_bool", "BOOLEAN", f"try_cast({STEP} AS BOOLEAN)"), ("json_get_array", "ARRAY<STRING>", f"from_json({STEP}, 'array<string>')"),
    ("json_contains", "BOOLEAN", "coalesce(map_contains_key(from_json(j, 'map<string,string>'), k), false) OR coalesce(try_cast(k AS INT) < json_array_length(j), false)"),
)


def ulid(time: Column, entropy: Column) -> Column:
    """A sortable 26-character id: 48 bits of milliseconds and 80 bits of a hash of ``entropy``, in Crockford's base 32."""

    def digits(value: Column, n: int) -> list[Column]:
        return [F.substring(F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ"), F.shiftright(value, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in reversed(range(n))]

    hashed = F.sha2(entropy.cast("string"), 256)
    halves = [F.conv(F.substring(hashed, at, 10), 16, 10).cast("bigint") for at in (1, 11)]
    return F.concat(*digits(F.unix_millis(time), 10), *digits(halves[0], 8), *digits(halves[1], 8))


def register(spark: SparkSession) -> None:
    """Names that telemetry SQL uses, as SQL functions that Catalyst inlines."""
    for name, kind, body in JSON_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(j STRING, k STRING) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION json_length(j STRING) RETURNS INT RETURN coalesce(json_array_length(j), size(json_object_keys(j)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION to_timestamp_micros(n BIGINT) RETURNS TIMESTAMP RETURN timestamp_micros(n)")
    # The percentage must fold, which no SQL function's parameter does: a second name for the builtin.
    registry, jvm = spark._jsparkSession.sessionState().functionRegistry(), spark._jvm
    names = [jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(x) for x in ("percentile_approx", "approx_percentile_cont")]
    builtin = registry.lookupFunctionBuilder(names[0])
    if builtin.isDefined():
        registry.registerFunction(names[1], registry.lookupFunction(names[0]).get(), builtin.get())
