"""Filter state: what a user picked, as typed predicates and as URL parameters."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from tideglass.plans.predicates import AnyText, Contains, Equals, OneOf, Predicate, Since, Status, StatusClasses

MINUTE = 60_000_000
#: Relative windows in microseconds.
TIME_RANGES = {
    "Last 15 min": 15 * MINUTE, "Last 1 hour": 60 * MINUTE, "Last 6 hours": 360 * MINUTE, "Last 24 hours": 1440 * MINUTE,
    "Last 7 days": 7 * 1440 * MINUTE, "Last 30 days": 30 * 1440 * MINUTE,
}
DEFAULT_RANGE = "Last 15 min"
PREFIXES = ("service", "route", "status", "correlation_id")


@dataclass(frozen=True)
class Chip:
    prefix: str | None
    value: str

    @staticmethod
    def parse(text: str) -> Chip:
        prefix, colon, value = text.partition(":")
        return Chip(prefix, value) if colon and value and prefix in PREFIXES else Chip(None, text)

    def __str__(self) -> str:
        return f"{self.prefix}:{self.value}" if self.prefix else self.value

    def predicate(self) -> Predicate:
        if self.prefix in ("service", "correlation_id"):
            return Equals(self.prefix, self.value)
        if self.prefix == "route":
            return Contains(self.value)
        if self.prefix == "status":
            m = re.fullmatch(r"(<=|>=|!=|<>|==|=|<|>)?(\d+)", self.value)
            return Status(m[1] or "=", int(m[2])) if m else Equals("line", self.value)
        return AnyText(self.value)


def _list(raw: str | None) -> list[str]:
    return [x.strip() for x in (raw or "").split(",") if x.strip()]


@dataclass
class FilterState:
    query: str = ""
    chips: list[Chip] = field(default_factory=list)
    services: list[str] = field(default_factory=list)
    time_range: str = DEFAULT_RANGE
    levels: list[str] = field(default_factory=list)
    checked: dict[str, list[str]] = field(default_factory=dict)

    @staticmethod
    def from_params(params: dict[str, str]) -> FilterState:
        """From ``q, c, s, t, l, ch``; a malformed ``ch`` counts as empty, service chips join the services."""
        chips = [Chip.parse(x) for x in _list(params.get("c"))]
        services = _list(params.get("s")) + [c.value for c in chips if c.prefix == "service"]
        try:
            raw = json.loads(params.get("ch") or "{}")
        except ValueError:
            raw = {}
        checked = {k: kept for k, v in raw.items() if isinstance(v, list) and (kept := [x for x in v if isinstance(x, str) and x])} if isinstance(raw, dict) else {}
        return FilterState(params.get("q") or "", chips, list(dict.fromkeys(services)), params.get("t") or DEFAULT_RANGE, _list(params.get("l")), checked)

    def to_params(self) -> dict[str, str]:
        out = {
            "q": self.query, "c": ",".join(map(str, self.chips)), "s": ",".join(self.services), "l": ",".join(self.levels),
            "t": "" if self.time_range == DEFAULT_RANGE else self.time_range, "ch": json.dumps(self.checked, separators=(",", ":")) if self.checked else "",
        }
        return {k: v for k, v in out.items() if v}

    def predicates(self, now_micros: int, live: str = "", exclude: set[str] | frozenset[str] = frozenset()) -> list[Predicate]:
        """Services, levels, chips, text being typed, checked sections, time window, in that order.

        ``exclude`` drops ``services``, ``levels`` or checked sections by name, so that a facet still counts
        the options its own selection would hide. ``now_micros`` ends the relative window."""
        out: list[Predicate] = []
        if self.services and "services" not in exclude:
            out.append(OneOf("service", tuple(self.services)))
        if self.levels and "levels" not in exclude:
            out.append(OneOf("level", tuple(self.levels)))
        out += [c.predicate() for c in self.chips if c.prefix != "service"]
        if live.strip() and (chip := Chip.parse(live.strip())) not in self.chips:
            out.append(chip.predicate())
        out += [p for section, ids in self.checked.items() if section not in exclude and (p := checked_predicate(section, ids))]
        if window := TIME_RANGES.get(self.time_range):
            out.append(Since(now_micros - window))
        return out


def checked_predicate(section: str, ids: list[str]) -> Predicate | None:
    """A sidebar section's selection; None for sections that only narrow on the client."""
    values = tuple(v for v in ids if v.strip())
    if section == "status_code":
        codes = tuple(int(float(v)) for v in values if re.fullmatch(r"-?\d+(\.\d+)?", v))
        return OneOf("line", codes) if codes else None
    if section == "response_status":
        known = tuple(v for v in values if v in StatusClasses.RANGES)
        return StatusClasses(known) if known else None
    name = {"log_level": "level", "service_name": "service", "error_type": "exception_type"}.get(section)
    return OneOf(name, values) if name and values else None
