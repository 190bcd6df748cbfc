"""A thin HTTP shell over the endpoint: POST /query, GET /health, /status, /detect, /resources, /tail, and preflights."""

from __future__ import annotations

import json
import queue
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tideglass import __version__
from tideglass.operators.endpoint import Endpoint, QueryError
from tideglass.sources.workspace import detect, nested, usage
from tideglass.streaming.ingest import Front, Tail

KEEP_ALIVE_S = 15.0


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args) -> None:
        pass

    def reply(self, code: int, body, kind: str = "application/json") -> None:
        raw = (body if isinstance(body, str) else json.dumps(body)).encode()
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(raw)))
        self.send_header("Access-Control-Allow-Origin", "*")
        self.end_headers()
        self.wfile.write(raw)

    def do_OPTIONS(self) -> None:
        """A browser's preflight: any origin, the methods served, and the headers that a query needs."""
        self.send_response(200)
        self.send_header("Access-Control-Allow-Origin", "*")
        self.send_header("Access-Control-Allow-Methods", "GET,POST,OPTIONS")
        self.send_header("Access-Control-Allow-Headers", "content-type,accept")
        self.send_header("Content-Length", "0")
        self.end_headers()

    def do_POST(self) -> None:
        if self.path != "/query":
            return self.reply(404, "not found", "text/plain")
        try:
            sql = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))["sql"]
            return self.reply(200, self.server.endpoint.query(sql).to_dict())
        except (QueryError, ValueError, KeyError, TypeError) as e:
            return self.reply(400, f"Query failed: {e}", "text/plain")

    def do_GET(self) -> None:
        s, spark = self.server, self.server.endpoint.spark
        if self.path == "/health":
            return self.reply(200, {"status": "ok", "version": __version__})
        if self.path == "/status":
            front = s.front
            state = "recovering" if front and front.recovering else "running"
            return self.reply(200, {"status": state, "version": __version__, "dropped_events": front.dropped if front else 0, "buffer_occupancy": front.waiting if front else 0})
        if self.path == "/detect":
            keys = ("service_name", "language", "framework", "project_file")
            return self.reply(200, [{k: r[k] for k in keys} for r in detect(spark, s.workspace, depth=0).collect()])
        if self.path == "/resources":
            return self.reply(200, nested(usage(s.workspace)))
        if self.path == "/tail" and s.tail:
            return self.follow(s.tail.subscribe())
        return self.reply(404, "not found", "text/plain")

    def follow(self, events: queue.Queue) -> None:
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.send_header("Access-Control-Allow-Origin", "*")
        self.end_headers()
        try:
            while True:
                try:
                    text = f"data: {events.get(timeout=KEEP_ALIVE_S)}\n\n"
                except queue.Empty:
                    text = ": keep-alive\n\n"
                self.wfile.write(text.encode())
                self.wfile.flush()
        except OSError:
            pass


class Server(ThreadingHTTPServer):
    daemon_threads = True

    def __init__(self, endpoint: Endpoint, port: int = 4317, workspace: str = ".", tail: Tail | None = None, front: Front | None = None):
        self.endpoint, self.workspace, self.tail, self.front = endpoint, workspace, tail, front
        super().__init__(("127.0.0.1", port), Handler)
