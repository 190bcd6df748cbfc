"""Ingest: JSON batches in a landing directory, through Structured Streaming, into the partitioned store."""

from __future__ import annotations

import json
import os
import queue
import threading
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.columns import blank_to_null, content_id, ns_to_timestamp, redact_attributes, sorted_json, utc_date
from tideglass.operators import compaction
from tideglass.schemas import BATCH, TABLES
from tideglass.sources.catalog import append, scan
from tideglass.sources.wal import Wal

MAX_BUFFERED = 500_000


def _service() -> F.Column:
    return F.coalesce(blank_to_null(F.trim("service_name")), F.lit("default")).alias("service")


def normalise(batches: DataFrame, redact: bool = False, lower_levels: bool = False) -> dict[str, DataFrame]:
    """Batches to rows of the three tables: ids by content where none is given, blanks and zeros to null,
    maps to JSON with sorted keys, UTC days from event time."""

    def attributes(c: str):
        return sorted_json(redact_attributes(F.col(c)) if redact else F.col(c))

    def text(c: str):
        return blank_to_null(F.col(c)).alias(c)

    def number(c: str):
        return F.when(F.col(c) != 0, F.col(c)).alias(c)

    e = batches.select(_service(), F.explode("logs").alias("e")).select("service", "e.*")
    level = blank_to_null(F.lower("level") if lower_levels else F.col("level"))
    key = content_id(*map(F.col, ("service", "timestamp_ns", "level", "message", "logger_name", "file", "line", "correlation_id")), sorted_json(F.col("attributes")))
    logs = e.withColumn("timestamp", ns_to_timestamp(F.col("timestamp_ns"))).select(
        F.coalesce(blank_to_null(F.col("event_id")), key).alias("id"), "timestamp", level.alias("level"), F.lit(None).cast("string").alias("route"), text("message"),
        attributes("attributes").alias("attributes"), text("logger_name"), text("file"), number("line"), text("correlation_id"),
        F.when(F.size("stack_trace") > 0, F.col("stack_trace")).alias("stack_trace"), text("exception_type"), text("exception_message"), "service",
        utc_date(F.col("timestamp")).alias("date"),
    )

    e = batches.select(_service(), F.explode("spans").alias("e")).select("service", "e.*")
    names = ("service", "correlation_id", "parent_correlation_id", "name", "route", "method", "status_code", "start_time_ns", "end_time_ns", "error", "kind")
    key = content_id(*map(F.col, names), sorted_json(F.col("attributes")))
    spans = e.withColumn("start_time", ns_to_timestamp(F.col("start_time_ns"))).select(
        F.coalesce(blank_to_null(F.col("event_id")), key).alias("id"), text("correlation_id"), text("parent_correlation_id"), text("name"), text("route"), text("method"),
        number("status_code"), ((F.col("end_time_ns") - F.col("start_time_ns")) / 1e6).alias("latency_ms"), (F.coalesce(F.col("error"), F.lit("")) != "").alias("is_error"),
        "start_time", ns_to_timestamp(F.col("end_time_ns")).alias("end_time"), attributes("attributes").alias("attributes"), "service",
        utc_date(F.col("start_time")).alias("date"),
    )

    e = batches.select(_service(), F.explode("metrics").alias("e")).select("service", "e.*")
    key = content_id(*map(F.col, ("service", "name", "timestamp_ns", "value", "type")), F.to_json(F.struct("bucket_values")), sorted_json(F.col("labels")))
    metrics = e.withColumn("timestamp", ns_to_timestamp(F.col("timestamp_ns"))).select(
        F.coalesce(blank_to_null(F.col("event_id")), key).alias("id"), F.coalesce("name", F.lit("")).alias("name"), "timestamp", "value",
        attributes("labels").alias("labels"), "service", utc_date(F.col("timestamp")).alias("date"),
    )
    return {"logs": logs, "spans": spans, "metrics": metrics}


def fresh(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet, one a new id. Only days that the rows touch are compared, so the
    stored side is pruned to their partitions."""
    one = rows.dropDuplicates(["id"])
    days = one.select("date", "service").distinct()
    known = stored.select("id", "date", "service").join(days, ["date", "service"], "left_semi").select("id")
    return one.join(known, "id", "left_anti")


def deduplicated_stream(rows: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Steady-state duplicates removed by id; the watermark bounds the state."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


class Tail:
    """Live events for subscribers: bounded queues; one that is full loses the event, the others don't."""

    def __init__(self, capacity: int = 1024):
        self.capacity, self.queues, self.lock = capacity, [], threading.Lock()

    def subscribe(self) -> queue.Queue:
        q: queue.Queue = queue.Queue(self.capacity)
        with self.lock:
            self.queues.append(q)
        return q

    def publish(self, name: str, rows: DataFrame) -> None:
        """As many of a micro-batch's rows as a queue can hold come to the driver, and only if someone listens."""
        with self.lock:
            queues = list(self.queues)
        if not queues:
            return
        for r in rows.select(F.to_json(F.struct(F.lit(name).alias("table"), *rows.columns)).alias("j")).limit(self.capacity).collect():
            for q in queues:
                try:
                    q.put_nowait(r.j)
                except queue.Full:
                    pass


def read_landing(spark: SparkSession, landing: str, files_per_trigger: int = 1000, done: str | None = None) -> DataFrame:
    """Batches as they land; a line that is no valid batch becomes nulls and yields no rows. Files that are done
    move to ``done``, so that the folder that is listed stays small."""
    reader = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files_per_trigger).option("mode", "PERMISSIVE")
    if done:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", done)
    return reader.json(landing)


def start(
    spark: SparkSession, landing: str, base: str, checkpoint: str, tail: Tail | None = None, once: bool = False, interval: str = "2 seconds",
    replay_dedup: bool = True, redact: bool = False, front: Front | None = None, done: str | None = None,
):
    """The ingest query. Checkpoint and landing directory are its log: after a crash the last micro-batch runs
    again, and with ``replay_dedup`` rows that it had already stored are not stored twice: the first micro-batch
    of a run, the only one that may be such a replay, is compared with the ids stored for its days. Later ones are
    not compared with the store. ``front`` is told what has been stored, so that it accepts more."""
    first = True

    def store(batch: DataFrame, batch_id: int) -> None:
        nonlocal first
        batch.persist()
        try:
            for name, rows in normalise(batch, redact).items():
                if replay_dedup:
                    rows = fresh(rows, scan(spark, base, name)) if first else rows.dropDuplicates(["id"])
                rows = rows.persist()
                append(rows, base, name)
                if tail:
                    tail.publish(name, rows)
                rows.unpersist()
            if front:
                n = [F.coalesce(F.sum(F.size(F.coalesce(t, F.array()))), F.lit(0)) for t in TABLES]
                front.stored(batch.agg(sum(n[1:], n[0]).alias("n")).first().n)
        finally:
            batch.unpersist()
        first = False

    writer = read_landing(spark, landing, done=done).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def recover(spark: SparkSession, base: str, log: Wal, redact: bool = False) -> int:
    """Start-up: clear leftovers and finish recorded merges, then store what the write-ahead log holds and the
    store does not, and drop the log. Returns how many rows of the log were new. Running it again, after a crash
    at any point, stores nothing twice, as rows are compared by id."""
    if "://" not in base:
        compaction.recover(base)
    replayed, n = log.replay(spark), 0
    if log.segments():
        complete = log.rotate()
        for name, rows in normalise(replayed, redact).items():
            new = fresh(rows, scan(spark, base, name)).persist()
            n += new.count()
            append(new, base, name)
            new.unpersist()
        log.drop(complete)
    return n


@dataclass
class Ack:
    accepted: bool
    events: int
    error: str = ""


class Front:
    """Takes batches from clients into the landing directory. A batch is one file, renamed into place, so the
    stream sees all of it or nothing. With a ``log``, batches are written ahead to it first and land together, one
    file for those of ``settle``; a batch is acknowledged once it is in the log. Refuses while recovering, and
    beyond ``capacity`` events not yet stored."""

    def __init__(self, landing: str, capacity: int = MAX_BUFFERED, log: Wal | None = None):
        self.landing, self.capacity, self.waiting, self.dropped, self.recovering, self.log = Path(landing), capacity, 0, 0, False, log
        self.lock, self.held = threading.Lock(), []
        self.landing.mkdir(parents=True, exist_ok=True)

    def start_up(self, spark: SparkSession, base: str) -> int:
        """Recover from the log before anything is accepted."""
        self.recovering = True
        try:
            return recover(spark, base, self.log) if self.log else 0
        finally:
            self.recovering = False

    def accept(self, batch: dict) -> Ack:
        return self.accept_all([batch])[0]

    def accept_all(self, batches: list[dict]) -> list[Ack]:
        """Acknowledge several batches with one write to disk."""
        acks, taken = [], []
        with self.lock:
            for batch in batches:
                n = sum(len(batch.get(t) or ()) for t in TABLES)
                if self.recovering:
                    acks.append(Ack(False, 0, "startup_recovery_in_progress"))
                elif self.waiting + n > self.capacity:
                    self.dropped += n
                    acks.append(Ack(False, 0, "buffer_full"))
                else:
                    self.waiting += n
                    acks.append(Ack(True, n))
                    taken.append(json.dumps(batch, separators=(",", ":")))
            if taken and self.log:
                self.log.extend([x.encode() for x in taken])
                self.held += taken
        if taken and not self.log:
            self.land(taken)
        return acks

    def land(self, lines: list[str]) -> None:
        path = self.landing / f"{uuid.uuid4().hex}.json"
        hidden = self.landing / f".{path.name}"
        with hidden.open("w") as f:
            f.write("\n".join(lines) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(hidden, path)

    def settle(self) -> int:
        """Let the logged batches land, and drop the segments that held them; returns how many there were. The
        landing directory is durable itself, so the log needs them no longer."""
        with self.lock:
            lines, self.held = self.held, []
            complete = self.log.rotate() if lines else []
        if lines:
            self.land(lines)
            self.log.drop(complete)
        return len(lines)

    def stored(self, n: int) -> None:
        with self.lock:
            self.waiting = max(0, self.waiting - n)
