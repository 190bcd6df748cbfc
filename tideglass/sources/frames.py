"""Length-prefixed batches over a Unix or TCP socket."""

from __future__ import annotations

import json
import socketserver
import struct
from collections.abc import Iterator
from pathlib import Path

from tideglass.sources import wire
from tideglass.streaming.ingest import Ack, Front

MOST_BYTES = 16 << 20


def frames(read) -> Iterator[bytes]:
    """Payloads of a stream: four length bytes, least significant first, then the payload."""
    while len(head := read(4)) == 4:
        (n,) = struct.unpack("<I", head)
        if n > MOST_BYTES:
            raise ConnectionError(f"frame of {n} bytes")
        payload = read(n)
        if len(payload) < n:
            return
        yield payload


def decoded(payload: bytes) -> dict:
    """A batch from its binary form, or from JSON: an object's brace begins no valid binary batch."""
    if not payload.startswith(b"{"):
        return wire.decode(payload)
    batch = json.loads(payload)
    if not isinstance(batch, dict):
        raise ValueError("a batch is an object")
    return batch


def answer(front: Front, payload: bytes) -> Ack:
    """A payload that can't be decoded is refused; the connection goes on."""
    try:
        batch = decoded(payload)
    except ValueError as e:
        return Ack(False, 0, f"decode_error: {e}")
    return front.accept(batch)


def response(ack: Ack, payload: bytes) -> bytes:
    """The acknowledgement, in the form that the batch came in."""
    if payload.startswith(b"{"):
        return json.dumps(vars(ack)).encode()
    return wire.encode({"accepted": ack.accepted, "events_count": ack.events, "error": ack.error}, wire.RESPONSE)


class Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        try:
            for payload in frames(self.rfile.read):
                ack = response(answer(self.server.front, payload), payload)
                self.wfile.write(struct.pack("<I", len(ack)) + ack)
                self.wfile.flush()
        except ConnectionError:
            pass


class TcpServer(socketserver.ThreadingTCPServer):
    allow_reuse_address, daemon_threads = True, True

    def __init__(self, front: Front, host: str = "127.0.0.1", port: int = 4318):
        self.front = front
        super().__init__((host, port), Handler)


class UnixServer(socketserver.ThreadingUnixStreamServer):
    daemon_threads = True

    def __init__(self, front: Front, path: str):
        self.front = front
        Path(path).unlink(missing_ok=True)
        super().__init__(path, Handler)
