"""Typed filter predicates, and their meaning on log rows and on HTTP requests from either source."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideglass.functions.columns import json_get_str, utc_date
from tideglass.schemas import STATUS_KEY

OPS = {
    "=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


class UnsupportedPredicate(ValueError):
    """A filter that does not mean the same on spans and on HTTP log rows; nothing is run half-filtered."""


def conjunction(columns: list[Column]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


def disjunction(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Predicate:
    def column(self) -> Column:
        """On the logs table."""
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def spans(self) -> Column:
        raise UnsupportedPredicate(self.sql())

    def http_logs(self) -> Column:
        """On log rows that carry HTTP requests."""
        return self.column()


@dataclass(frozen=True)
class OneOf(Predicate):
    field: str
    values: tuple

    def column(self) -> Column:
        return F.col(self.field).isin(*self.values)

    def sql(self) -> str:
        return f"{self.field} IN ({','.join(sql_text(v) if isinstance(v, str) else str(v) for v in self.values)})"

    def spans(self) -> Column:
        if self.field == "service":
            return self.column()
        if self.field != "level":
            return super().spans()
        code, parts = F.col("status_code"), []
        for level in {v.lower() for v in self.values}:
            if level in ("error", "critical", "fatal"):
                parts.append(code >= 500)
            elif level == "warn":
                parts.append((code >= 400) & (code < 500))
            elif level == "info":
                parts.append(code < 400)
        return disjunction(parts)

    def http_logs(self) -> Column:
        if self.field not in ("service", "level"):
            raise UnsupportedPredicate(self.sql())
        return self.column()


@dataclass(frozen=True)
class Equals(Predicate):
    field: str
    value: str

    def column(self) -> Column:
        return F.col(self.field) == self.value

    def sql(self) -> str:
        return f"{self.field} = {sql_text(self.value)}"

    def spans(self) -> Column:
        return self.column() if self.field in ("service", "correlation_id") else super().spans()


@dataclass(frozen=True)
class Contains(Predicate):
    """``message LIKE '%needle%'``; % and _ in the needle are wildcards."""

    needle: str

    def column(self) -> Column:
        return F.col("message").like(f"%{self.needle}%")

    def sql(self) -> str:
        return f"message LIKE {sql_text('%' + self.needle + '%')}"

    def spans(self) -> Column:
        return F.col("name").like(f"%{self.needle}%") | F.col("route").like(f"%{self.needle}%")


@dataclass(frozen=True)
class AnyText(Predicate):
    """Free text: part of the message, or a level."""

    text: str

    def column(self) -> Column:
        return F.col("message").like(f"%{self.text}%") | (F.col("level") == self.text)

    def sql(self) -> str:
        return f"(message LIKE {sql_text('%' + self.text + '%')} OR level = {sql_text(self.text)})"


@dataclass(frozen=True)
class Status(Predicate):
    """A comparison of the ``line`` column, which on HTTP requests means the status code."""

    op: str
    code: int

    def column(self) -> Column:
        return OPS[self.op](F.col("line"), self.code)

    def sql(self) -> str:
        return f"line {self.op} {self.code}"

    def spans(self) -> Column:
        return OPS[self.op](F.col("status_code"), self.code)

    def http_logs(self) -> Column:
        return OPS[self.op](json_get_str("attributes", STATUS_KEY).try_cast("int"), self.code)


@dataclass(frozen=True)
class StatusClasses(Predicate):
    """success, redirect, client_error, server_error as ranges of ``line``."""

    classes: tuple[str, ...]
    RANGES = {"success": (None, 300), "redirect": (300, 400), "client_error": (400, 500), "server_error": (500, None)}

    def within(self, code: Column) -> Column:
        parts = []
        for name, (low, high) in self.RANGES.items():
            if name in self.classes:
                parts.append(conjunction(([code >= low] if low else []) + ([code < high] if high else [])))
        return disjunction(parts)

    def column(self) -> Column:
        return self.within(F.col("line"))

    def sql(self) -> str:
        texts = [
            " AND ".join(([f"line >= {low}"] if low else []) + ([f"line < {high}"] if high else []))
            for name, (low, high) in self.RANGES.items()
            if name in self.classes
        ]
        return f"({' OR '.join(texts)})"

    def http_logs(self) -> Column:
        raise UnsupportedPredicate(self.sql())


@dataclass(frozen=True)
class Since(Predicate):
    """Later (or earlier) than an instant. The ``date`` partitions follow from it, so they are pruned."""

    micros: int
    op: str = ">"

    def on(self, time: str) -> Column:
        at = F.timestamp_micros(F.lit(self.micros))
        day = F.col("date") >= utc_date(at) if self.op[0] == ">" else F.col("date") <= utc_date(at)
        return OPS[self.op](F.col(time), at) & day

    def column(self) -> Column:
        return self.on("timestamp")

    def sql(self) -> str:
        return f"timestamp {self.op} to_timestamp_micros({self.micros})"

    def spans(self) -> Column:
        return self.on("start_time")


def where(predicates: list[Predicate]) -> Column:
    return conjunction([p.column() for p in predicates])


def arms(predicates: list[Predicate]) -> tuple[Column, Column]:
    """(spans, HTTP log rows). Raises UnsupportedPredicate, naming every filter without a meaning on both."""
    spans, logs, bad = [], [], []
    for p in predicates:
        try:
            s, g = p.spans(), p.http_logs()
        except UnsupportedPredicate as e:
            bad.append(str(e))
            continue
        spans.append(s)
        logs.append(g)
    if bad:
        raise UnsupportedPredicate("; ".join(bad))
    return conjunction(spans), conjunction(logs)


def tokens(text: str, separator: str) -> list[str]:
    """Split at a separator that stands outside quotes and parentheses."""
    out, at, depth, i, quoted = [], 0, 0, 0, False
    while i < len(text):
        c = text[i]
        if c == "'":
            quoted = not quoted  # a doubled quote closes and opens again
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif not quoted and depth == 0 and text[i : i + len(separator)].upper() == separator:
            out.append(text[at:i])
            at = i = i + len(separator)
            continue
        i += 1
    return [t.strip() for t in [*out, text[at:]] if t.strip()]


def unquote(text: str) -> str:
    return text.strip()[1:-1].replace("''", "'")


QUOTED = r"'(?:[^']|'')*'"
FORMS = (
    (re.compile(rf"(service|level|exception_type)\s+IN\s*\(((?:\s*{QUOTED}\s*,?)+)\)", re.I), lambda m: OneOf(m[1].lower(), tuple(unquote(x) for x in re.findall(QUOTED, m[2])))),
    (re.compile(r"line\s+IN\s*\(([-0-9,\s]+)\)", re.I), lambda m: OneOf("line", tuple(int(x) for x in m[1].split(",")))),
    (re.compile(rf"(service|correlation_id|exception_type)\s*=\s*({QUOTED})", re.I), lambda m: Equals(m[1].lower(), unquote(m[2]))),
    (re.compile(rf"message\s+LIKE\s+({QUOTED})", re.I), lambda m: Contains(unquote(m[1])[1:-1]) if re.fullmatch(r"%.*%", unquote(m[1]), re.S) else None),
    (re.compile(rf"\(\s*message\s+LIKE\s+({QUOTED})\s+OR\s+level\s*=\s*({QUOTED})\s*\)", re.I), lambda m: AnyText(unquote(m[2])) if unquote(m[1]) == f"%{unquote(m[2])}%" else None),
    (re.compile(r"line\s*(<=|>=|!=|<>|=|<|>)\s*(\d+)", re.I), lambda m: Status(m[1], int(m[2]))),
    (re.compile(r"line\s*=\s*'(\d+)'", re.I), lambda m: Status("=", int(m[1]))),
    (re.compile(r"timestamp\s*(<=|>=|<|>)\s*to_timestamp_micros\((-?\d+)\)", re.I), lambda m: Since(int(m[2]), m[1])),
)


def parse(text: str) -> list[Predicate]:
    """The predicates of a compiled WHERE text; anything else raises UnsupportedPredicate."""
    text = re.sub(r"^\s*WHERE\s+", "", text.strip(), flags=re.I)
    out, bad = [], []
    for clause in tokens(text, " AND "):
        found = next((p for pattern, make in FORMS if (m := pattern.fullmatch(clause)) and (p := make(m))), None)
        out.append(found) if found else bad.append(clause)
    if bad:
        raise UnsupportedPredicate("; ".join(bad))
    return out
