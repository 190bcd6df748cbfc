"""Batches in the binary form that clients send (Protocol Buffers), to and from plain dictionaries.

The format is decoded straight from its published encoding; no generated classes are needed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

# Field numbers, names and kinds of the messages on the wire.
LOG = {
    1: ("service_name", "text"), 2: ("message", "text"), 3: ("level", "text"), 4: ("timestamp_ns", "int"), 5: ("logger_name", "text"), 6: ("file", "text"), 7: ("line", "int"),
    8: ("correlation_id", "text"), 9: ("attributes", "map"), 10: ("stack_trace", "texts"), 11: ("exception_type", "text"), 12: ("exception_message", "text"), 13: ("event_id", "text"),
}
SPAN = {
    1: ("service_name", "text"), 2: ("name", "text"), 3: ("start_time_ns", "int"), 4: ("end_time_ns", "int"), 5: ("correlation_id", "text"), 6: ("parent_correlation_id", "text"), 7: ("route", "text"),
    8: ("method", "text"), 9: ("status_code", "int"), 10: ("error", "text"), 11: ("attributes", "map"), 12: ("kind", "int"), 13: ("event_id", "text"),
}
METRIC = {
    1: ("service_name", "text"), 2: ("name", "text"), 3: ("value", "double"), 4: ("timestamp_ns", "int"), 5: ("labels", "map"), 6: ("type", "int"), 7: ("bucket_values", "doubles"), 8: ("event_id", "text"),
}
BATCH = {1: ("service_name", "text"), 2: ("instance_id", "text"), 3: ("batch_seq", "int"), 10: ("logs", LOG), 11: ("spans", SPAN), 12: ("metrics", METRIC)}
RESPONSE = {1: ("accepted", "bool"), 2: ("events_count", "int"), 3: ("error", "text")}
ENTRY = {1: ("key", "text"), 2: ("value", "text")}

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
EMPTY = {"text": "", "int": 0, "bool": False, "double": 0.0}


def varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("a number is cut off")
        byte = raw[at]
        out, at, shift = out | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return out & (1 << 64) - 1, at


def fields(raw: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, kind on the wire, value) of a message; groups and cut-off values are errors."""
    at = 0
    while at < len(raw):
        tag, at = varint(raw, at)
        kind = tag & 7
        if kind == VARINT:
            value, at = varint(raw, at)
        else:
            if kind == BYTES:
                size, at = varint(raw, at)
            elif kind in (FIXED64, FIXED32):
                size = 8 if kind == FIXED64 else 4
            else:
                raise ValueError(f"unknown wire kind {kind}")
            if at + size > len(raw):
                raise ValueError("a field is cut off")
            value, at = raw[at : at + size], at + size
        yield tag >> 3, kind, value


def decode(raw: bytes, message: dict = BATCH) -> dict:
    """A message as a dictionary, absent fields with their empty values; unknown fields are passed over."""
    out = {name: {} if kind == "map" else [] if isinstance(kind, dict) or kind in ("texts", "doubles") else EMPTY[kind] for name, kind in message.values()}
    for number, wire, value in fields(raw):
        if number not in message:
            continue
        name, kind = message[number]
        if wire != {"int": VARINT, "bool": VARINT, "double": FIXED64}.get(kind if isinstance(kind, str) else "", BYTES) and kind != "doubles":
            raise ValueError(f"field {name} has wire kind {wire}")
        if isinstance(kind, dict):
            out[name].append(decode(value, kind))
        elif kind == "map":
            entry = decode(value, ENTRY)
            out[name][entry["key"]] = entry["value"]
        elif kind == "texts":
            out[name].append(value.decode())
        elif kind == "doubles":  # packed, or one by one
            if wire == VARINT or len(value) % 8:
                raise ValueError(f"field {name} is cut off")
            out[name] += struct.unpack(f"<{len(value) // 8}d", value)
        elif kind == "text":
            out[name] = value.decode()
        elif kind == "int":
            out[name] = value - (1 << 64) if value >> 63 else value
        else:
            out[name] = bool(value) if kind == "bool" else struct.unpack("<d", value)[0]
    return out


def number(n: int) -> bytes:
    out, n = bytearray(), n & (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def encode(value: dict, message: dict = BATCH) -> bytes:
    """The binary form of a dictionary; empty values are left out."""
    out = bytearray()

    def put(at: int, raw: bytes) -> None:
        out.extend(number(at << 3 | BYTES) + number(len(raw)) + raw)

    for at, (name, kind) in message.items():
        v = value.get(name)
        if not v:
            continue
        if isinstance(kind, dict):
            for x in v:
                put(at, encode(x, kind))
        elif kind == "map":
            for k, x in v.items():
                put(at, encode({"key": k, "value": x}, ENTRY))
        elif kind == "texts":
            for x in v:
                put(at, x.encode())
        elif kind == "text":
            put(at, v.encode())
        elif kind == "doubles":
            put(at, struct.pack(f"<{len(v)}d", *v))
        elif kind == "double":
            out.extend(number(at << 3 | FIXED64) + struct.pack("<d", v))
        else:
            out.extend(number(at << 3 | VARINT) + number(int(v)))
    return bytes(out)
