"""The read-only SQL endpoint: guard, row cap, timeout, and results that JSON can carry."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import uuid
from dataclasses import dataclass
from threading import Timer

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tideglass.plans.dialect import micros_casts, respell

ROW_CAP, TIMEOUT_S = 10_000, 30.0

#: Logical operators a query may have, by class name; everything else is refused.
READING_NODES = frozenset("""
Project Filter Aggregate Join AsOfJoin Sort GlobalLimit LocalLimit Offset Tail Union Distinct Deduplicate Except Intersect SubqueryAlias View
UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedWith CTERelationDef CTERelationRef WithCTE UnresolvedInlineTable
LocalRelation OneRowRelation Range Generate Window WithWindowDefinition LateralJoin UnresolvedTableValuedFunction UnresolvedTVFAliases Expand
Pivot Unpivot UnresolvedHint ResolvedHint Sample RepartitionByExpression ParameterizedQuery PlanWithUnresolvedIdentifier UnresolvedOrdinal
InlineTable ResolvedInlineTable Repartition AliasViewChild UnresolvedSubquery PipeOperator
""".split())  # fmt: skip
#: Functions that reach beyond the data: arbitrary Java, files, waiting.
DENIED_FUNCTIONS = frozenset({"java_method", "reflect", "try_reflect", "read_files", "sleep", "raise_error", "python_worker_logs", "input_file_name"})


class QueryError(Exception):
    """What a client is told; the text begins with the reason's kind."""


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[list]
    row_count: int

    def to_dict(self) -> dict:
        return {"columns": self.columns, "rows": self.rows, "row_count": self.row_count}


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _walk(plan):
    """Every logical operator of a plan, those of CTE definitions and subqueries in expressions included."""
    todo = [plan]
    while todo:
        p = todo.pop()
        yield p
        todo += _items(p.children()) + _items(p.innerChildren())


def _functions(plan):
    """Lower-case names of the functions that one operator's expressions call."""
    if plan.getClass().getSimpleName() == "UnresolvedTableValuedFunction":
        yield plan.name().last().lower()
    todo = _items(plan.expressions())
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            yield e.nameParts().last().lower()
        todo += _items(e.children())


def guard(spark: SparkSession, sql: str) -> None:
    """Refuse what is not a single reading query. The text is parsed, never run."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise QueryError(f"parse error: {str(e).splitlines()[0][:300]}") from None
    for p in _walk(plan):
        kind = p.getClass().getSimpleName()
        if kind not in READING_NODES:
            raise QueryError(f"not allowed: {kind}")
        for name in _functions(p):
            if name in DENIED_FUNCTIONS:
                raise QueryError(f"not allowed: function {name}")


def casts_a_timestamp(df: DataFrame, sql: str) -> bool:
    """Whether the analysed query casts a timestamp to BIGINT, which is seconds in Spark."""
    if "BIGINT" not in sql.upper():
        return False
    for p in _walk(df._jdf.queryExecution().analyzed()):
        todo = _items(p.expressions())
        while todo:
            e = todo.pop()
            if e.getClass().getSimpleName() == "Cast" and e.dataType().simpleString() == "bigint" and e.child().dataType().simpleString().startswith("timestamp"):
                return True
            todo += _items(e.children())
    return False


def encode(value, kind: T.DataType):
    """A value as JSON carries it: timestamps as epoch microseconds, NaN and infinities as null.

    Types without a JSON form raise, rather than leave a type's name among the data."""
    if value is None:
        return None
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.StringType)):
        return value
    if isinstance(kind, T.FractionalType):
        if isinstance(value, decimal.Decimal):
            return int(value) if value == value.to_integral_value() else float(value)
        return value if math.isfinite(value) else None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if value.tzinfo is None and isinstance(kind, T.TimestampType):
            value = value.astimezone(dt.UTC)
        return (value.replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
    if isinstance(kind, T.DateType):
        return value.isoformat()
    if isinstance(kind, T.ArrayType):
        return [encode(v, kind.elementType) for v in value]
    raise QueryError(f"column type {kind.simpleString()} has no JSON form")


def encodable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return encodable(kind.elementType)
    return isinstance(kind, (T.BooleanType, T.IntegralType, T.StringType, T.FractionalType, T.TimestampType, T.TimestampNTZType, T.DateType, T.NullType))


class Endpoint:
    """``query(sql)`` over the session's views. At most ``cap`` rows come to the driver; a query that runs
    longer than ``timeout`` seconds has its jobs cancelled and the endpoint goes on serving."""

    def __init__(self, spark: SparkSession, cap: int = ROW_CAP, timeout: float = TIMEOUT_S, before=lambda: None):
        self.spark, self.cap, self.timeout, self.before = spark, cap, timeout, before
        spark.conf.set("spark.sql.runSQLOnFiles", "false")

    def plan(self, sql: str, cap: bool = True) -> DataFrame:
        """The guarded query under the cap; smaller limits of its own stay."""
        sql = respell(sql)
        guard(self.spark, sql)
        self.before()
        try:
            df = self.spark.sql(sql)
            if casts_a_timestamp(df, sql):
                df = self.spark.sql(micros_casts(sql))
        except PySparkException as e:
            raise QueryError(str(e).splitlines()[0][:500]) from None
        return df.limit(self.cap) if cap else df

    def query(self, sql: str) -> QueryResult:
        df = self.plan(sql)
        for f in df.schema:
            if not encodable(f.dataType):
                raise QueryError(f"column {f.name}: type {f.dataType.simpleString()} has no JSON form")
        rows = self._collect(df)
        kinds = [f.dataType for f in df.schema]
        out = [[encode(v, k) for v, k in zip(r, kinds, strict=True)] for r in rows]
        return QueryResult(df.columns, out, len(out))

    def _collect(self, df: DataFrame) -> list:
        group, context, got = f"query-{uuid.uuid4().hex}", self.spark.sparkContext, {}

        def run() -> None:
            context.setJobGroup(group, "endpoint query", True)
            try:
                got["rows"] = df.collect()
            except Exception as e:
                got["error"] = e

        worker = InheritableThread(target=run, session=self.spark)
        timer = Timer(self.timeout, lambda: (got.setdefault("late", True), context.cancelJobGroup(group)))
        timer.start()
        worker.start()
        worker.join(self.timeout + 5)
        timer.cancel()
        if "rows" in got:
            return got["rows"]
        if "late" in got or worker.is_alive():
            raise QueryError(f"timeout: the query ran longer than {self.timeout:g} s")
        raise QueryError(str(got["error"]).splitlines()[0][:500])
