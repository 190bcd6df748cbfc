import datetime as dt
import io
import json
import socket
import struct
import threading
import time

import pytest

from tideglass.operators import compaction
from tideglass.schemas import BATCH, LOGS
from tideglass.sources import wire
from tideglass.sources.catalog import append, scan
from tideglass.sources.frames import TcpServer, UnixServer, frames
from tideglass.sources.wal import Wal
from tideglass.streaming.ingest import Front, Tail, deduplicated_stream, normalise, recover, start

NS = 1_705_276_800_000_000_000


def batch(ids=(), service="api", **more):
    return {"service_name": service, "logs": [{"event_id": i, "timestamp_ns": NS, "message": "m"} for i in ids], **more}


def frame(spark, *batches):
    return spark.createDataFrame([(json.dumps(b),) for b in batches], "j string").selectExpr(f"from_json(j, '{BATCH.simpleString()}') b").select("b.*")


def test_rows_are_normalised(spark):
    b = batch(service="", logs=[{"event_id": "", "timestamp_ns": NS + 1999, "level": "", "message": "hi", "attributes": {"b": "2", "a": "1"}, "line": 0, "stack_trace": []}])
    b["spans"] = [{"event_id": "s", "start_time_ns": 1000, "end_time_ns": 2500, "status_code": 0, "error": "x"}, {"event_id": "t", "start_time_ns": 0, "end_time_ns": 0}]
    b["metrics"] = [{"event_id": "m", "name": "", "timestamp_ns": -1, "value": 1.5, "labels": {}}]
    got = {k: v.collect() for k, v in normalise(frame(spark, b)).items()}
    r = got["logs"][0]
    assert (r.service, r.date, r.level, r.route, r.line, r.stack_trace, r.attributes) == ("default", "2024-01-15", None, None, None, None, '{"a":"1","b":"2"}')
    assert len(r.id) == 16 and r.timestamp.microsecond == 1
    s, t = sorted(got["spans"], key=lambda x: x.id)
    assert (s.latency_ms, s.is_error, s.status_code, t.is_error) == (0.0015, True, None, False)
    assert (got["metrics"][0].name, got["metrics"][0].labels) == ("", None)


def test_ids_by_content_tell_nulls_and_boundaries_apart(spark):
    rows = [("ab", None), ("a", "b"), ("ab", ""), ("ab", None)]
    logs = [{"timestamp_ns": NS, "message": m, "logger_name": n} for m, n in rows]
    ids = [r.id for r in normalise(frame(spark, batch(logs=logs)))["logs"].collect()]
    assert ids[0] == ids[3] and len(set(ids)) == 3


def run(spark, tmp, **more):
    start(spark, f"{tmp}/landing", f"{tmp}/store", f"{tmp}/checkpoint", once=True, **more).awaitTermination()
    return sorted(r.id for r in scan(spark, f"{tmp}/store", "logs").collect())


def test_stream_stores_what_the_front_accepts_and_replays_nothing_twice(spark, tmp_path):
    front, tail = Front(f"{tmp_path}/landing"), Tail()
    heard = tail.subscribe()
    assert front.accept(batch(["1", "2", "3"])).accepted
    assert run(spark, tmp_path, tail=tail) == ["1", "2", "3"]
    assert json.loads(heard.get_nowait())["table"] == "log" + "s" and heard.qsize() == 2
    front.accept(batch(["2", "3", "4", "5"]))
    assert run(spark, tmp_path) == ["1", "2", "3", "4", "5"]


def test_steady_state_can_keep_repeats(spark, tmp_path):
    front = Front(f"{tmp_path}/landing")
    front.accept(batch(["1", "1"]))
    assert run(spark, tmp_path, replay_dedup=False) == ["1", "1"]


def test_front_refuses_beyond_capacity_and_while_recovering(tmp_path):
    front = Front(str(tmp_path), capacity=10)
    acks = [front.accept(batch([str(i)])) for i in range(50)]
    assert sum(a.accepted for a in acks) == 10 and front.dropped == 40 and {a.error for a in acks if not a.accepted} == {"buffer_full"}
    front.stored(10)
    front.recovering = True
    assert front.accept(batch(["x"])).error == "startup_recovery_in_progress"


def test_frames_over_tcp(spark, tmp_path):
    front = Front(f"{tmp_path}/landing")
    server = TcpServer(front, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with socket.create_connection(server.server_address) as s:
        f = s.makefile("rwb")
        for payload in (json.dumps(batch(["1", "2"])).encode(), b"{\xff", json.dumps(batch(["3"])).encode()):
            f.write(struct.pack("<I", len(payload)) + payload)
        f.flush()
        acks = [json.loads(x) for _, x in zip(range(3), frames(f.read), strict=False)]
    server.shutdown()
    assert [(a["accepted"], a["events"]) for a in acks] == [(True, 2), (False, 0), (True, 1)]
    assert run(spark, tmp_path) == ["1", "2", "3"]
    with pytest.raises(ConnectionError):
        list(frames(io.BytesIO(struct.pack("<I", 17 << 20)).read))


def full_batch():
    log = {"event_id": "l", "service_name": "api", "timestamp_ns": NS, "level": "warn", "message": "é", "logger_name": "g", "file": "f.py", "line": -3, "correlation_id": "c", "attributes": {"b": "2", "a": ""},
           "stack_trace": ["x", "y"], "exception_type": "E", "exception_message": "m"}
    span = {"event_id": "s", "service_name": "", "correlation_id": "", "parent_correlation_id": "p", "name": "n", "route": "/r", "method": "GET", "status_code": 503, "start_time_ns": -5, "end_time_ns": NS,
            "error": "x", "kind": 2, "attributes": {}}
    metric = {"event_id": "m", "service_name": "", "name": "q", "timestamp_ns": NS, "value": -1.5, "type": 3, "labels": {"k": "v"}, "bucket_values": [0.5, 2.0]}
    return {"service_name": "api", "instance_id": "i", "batch_seq": 7, "logs": [log, log | {"event_id": "l2"}], "spans": [span], "metrics": [metric]}


def test_binary_batches_over_a_unix_socket(spark, tmp_path):
    front, path = Front(f"{tmp_path}/landing"), str(tmp_path / "in.sock")
    server = UnixServer(front, path)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with socket.socket(socket.AF_UNIX) as s:
        s.connect(path)
        f = s.makefile("rwb")
        for payload in (wire.encode(full_batch()), b"\x08", wire.encode(batch(["9"]))):
            f.write(struct.pack("<I", len(payload)) + payload)
        f.flush()
        acks = [wire.decode(x, wire.RESPONSE) for _, x in zip(range(3), frames(f.read), strict=False)]
    server.shutdown()
    assert [(a["accepted"], a["events_count"], a["error"].split(":")[0]) for a in acks] == [(True, 4, ""), (False, 0, "decode_error"), (True, 1, "")]
    assert run(spark, tmp_path) == ["9", "l", "l2"]
    r = scan(spark, f"{tmp_path}/store", "spans").first()
    assert (r.id, r.status_code, r.is_error, r.service) == ("s", 503, True, "api")


def test_binary_form_round_trips_and_damage_is_told():
    b = full_batch()
    raw = wire.encode(b)
    assert wire.decode(raw) == b and wire.decode(b"") == {"service_name": "", "instance_id": "", "batch_seq": 0, "logs": [], "spans": [], "metrics": []}
    assert raw[:5] == b"\x0a\x03api" and wire.decode(raw + b"\xfa\x01\x02zz") == b  # an unknown field
    for bad in (raw[:-1], b"\x0b", b"\x0a\xff", b"\x18", b"\x0a\x02\xff\xfe", b"\x08\x01"):
        with pytest.raises(ValueError):
            wire.decode(bad)


def test_the_front_accepts_again_once_rows_are_stored(spark, tmp_path):
    front = Front(f"{tmp_path}/landing", capacity=5)
    assert front.accept(batch(["1", "2", "3"])).accepted and not front.accept(batch(["4", "5", "6"])).accepted
    assert run(spark, tmp_path, front=front, done=f"{tmp_path}/done") == ["1", "2", "3"] and front.waiting == 0
    assert front.accept(batch(["4", "5", "6"])).accepted
    assert run(spark, tmp_path, front=front, done=f"{tmp_path}/done") == ["1", "2", "3", "4", "5", "6"]


def test_only_the_first_micro_batch_of_a_run_is_compared_with_the_store(spark, tmp_path, monkeypatch):
    from tideglass.streaming import ingest

    seen = []
    monkeypatch.setattr(ingest, "fresh", lambda rows, stored, own=ingest.fresh: seen.append(1) or own(rows, stored))
    monkeypatch.setattr(ingest, "read_landing", lambda spark, landing, done=None, own=ingest.read_landing: own(spark, landing, 1))
    front = Front(f"{tmp_path}/landing")
    for k in range(3):
        front.accept(batch([str(k), str(k)]))
    assert run(spark, tmp_path) == ["0", "1", "2"] and len(seen) == 3  # one for each table


def test_recovery_stores_what_the_log_has_and_the_store_lacks(spark, tmp_path):
    base, wal = f"{tmp_path}/store", Wal(f"{tmp_path}/wal")
    assert recover(spark, base, wal) == 0
    wal.append(json.dumps(batch(["1", "2", "3"])).encode())
    assert recover(spark, base, wal) == 3 and not wal.segments()
    wal.append(json.dumps(batch(["1", "2", "3", "4"])).encode())
    wal.append(json.dumps(batch(["5"])).encode())
    left = next(iter((tmp_path / "store").glob("data/*/*/*"))) / "x.tmp"
    left.write_text("half a file")
    front = Front(f"{tmp_path}/landing", log=wal)
    assert front.start_up(spark, base) == 2 and not front.recovering and not left.exists()
    assert sorted(r.id for r in scan(spark, base, "logs").collect()) == ["1", "2", "3", "4", "5"]


def test_a_crash_between_store_and_log_doubles_nothing(spark, tmp_path, monkeypatch):
    base, wal = f"{tmp_path}/store", Wal(f"{tmp_path}/wal")
    wal.append(json.dumps(batch(["1", "2"])).encode())
    monkeypatch.setattr(Wal, "drop", staticmethod(lambda segments: (_ for _ in ()).throw(OSError("crash"))))
    with pytest.raises(OSError):
        recover(spark, base, wal)
    monkeypatch.undo()
    assert recover(spark, base, Wal(f"{tmp_path}/wal")) == 0
    assert sorted(r.id for r in scan(spark, base, "logs").collect()) == ["1", "2"]


def test_logged_batches_land_together(spark, tmp_path):
    wal = Wal(f"{tmp_path}/wal")
    front = Front(f"{tmp_path}/landing", log=wal)
    assert [a.accepted for a in front.accept_all([batch(["1"]), batch(["2", "3"])])] == [True, True]
    assert len(wal.segments()) == 1 and not list((tmp_path / "landing").glob("*.json"))
    assert front.settle() == 2 and not wal.segments() and len(list((tmp_path / "landing").glob("*.json"))) == 1 and front.settle() == 0
    assert run(spark, tmp_path) == ["1", "2", "3"]


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    spark.createDataFrame([("a", t), ("a", t), ("b", t + dt.timedelta(minutes=5))], "id string, timestamp timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id string, timestamp timestamp").parquet(f"{tmp_path}/in")
    q = deduplicated_stream(rows, "timestamp").writeStream.format("memory").queryName("unrepeated").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("unrepeated").collect()) == ["a", "b"]


def test_log_replay_stops_at_damage_within_a_segment_only(spark, tmp_path):
    wal = Wal(str(tmp_path))
    for k in (1, 2, 3):
        wal.append(json.dumps(batch([str(k)])).encode())
    assert len(wal.rotate()) == 1
    wal.append(b"not json")
    wal.append(json.dumps(batch(["4"])).encode())
    first = wal.segments()[0]
    raw = bytearray(first.read_bytes())

    def ids():
        return sorted(r.id for r in normalise(wal.replay(spark))["logs"].collect())

    assert ids() == ["1", "2", "3", "4"]
    first.write_bytes(raw[:-1])
    assert ids() == ["1", "2", "4"]
    raw[len(raw) // 2] ^= 1
    first.write_bytes(raw)
    assert ids() == ["1", "4"]


@pytest.fixture
def small_files(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    for k in range(3):
        rows = [(f"{k}-{i}", t, "info", None, "m", None, None, None, None, None, None, None, None, "api", "2024-01-01") for i in range(5)]
        append(spark.createDataFrame(rows, LOGS).coalesce(1), str(tmp_path), "logs")
    return str(tmp_path), compaction.partitions(str(tmp_path), "logs")[0]


def seen(spark, base):
    return len({r.id for r in scan(spark, base, "logs").collect()}), scan(spark, base, "logs").count()


def test_compaction_merges_and_gates_today(spark, small_files):
    base, p = small_files
    assert compaction.compact(spark, base, today="2024-01-01") == 0
    assert compaction.compact(spark, base, today="2024-01-02") == 1
    assert len(list(p.glob("*.parquet"))) == 1 and seen(spark, base) == (15, 15)
    assert compaction.compact(spark, base, today="2024-01-02") == 0


def test_large_partitions_are_merged_bin_by_bin(spark, small_files):
    base, p = small_files
    most = max(f.stat().st_size for f in p.glob("*.parquet")) * 2 + 10
    assert [len(b) for b in compaction.bins(p, compaction.small_files(p), most)] == [2]
    assert compaction.compact(spark, base, today="2024-01-02", sealed=most) == 1
    assert len(list(p.glob("*.parquet"))) == 2 and seen(spark, base) == (15, 15)


def test_the_scheduler_compacts_until_stopped(spark, small_files):
    base, p = small_files
    s = compaction.Scheduler(spark, base, interval=0.2).start()
    for _ in range(300):
        if s.merged:
            break
        time.sleep(0.1)
    s.stop()
    assert s.merged == 1 and s.error is None and not s.thread.is_alive() and seen(spark, base) == (15, 15)
    (p / compaction.MANIFEST).write_text("{")
    s = compaction.Scheduler(spark, base, interval=0.01).start()
    s.thread.join(30)
    assert isinstance(s.error, compaction.CorruptManifest)


def test_a_large_partition_is_written_by_several_files(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    rows = [(str(i), t, "info", None, "m", None, None, None, None, None, None, None, None, "api", "2024-01-01") for i in range(100)]
    append(spark.createDataFrame(rows, LOGS), str(tmp_path), "logs", file_rows=30)
    assert len(list(tmp_path.glob("data/*/*/*/*.parquet"))) >= 4 and scan(spark, str(tmp_path), "logs").count() == 100


def test_no_crash_point_doubles_or_loses_rows(spark, small_files):
    base, p = small_files
    m = compaction.merge(spark, "logs", p, compaction.small_files(p))
    assert seen(spark, base) == (15, 15)  # recorded, nothing swapped
    compaction.hidden(m).rename(p / m.merged)
    assert seen(spark, base) == (15, 15)  # swapped, sources still there
    (p / m.sources[0]).unlink()
    assert seen(spark, base) == (15, 15)
    assert compaction.recover(base) == 1 and seen(spark, base) == (15, 15) and len(list(p.glob("*.parquet"))) == 1
    assert compaction.recover(base) == 0


def test_unrecorded_leftovers_go_and_a_corrupt_manifest_stops(spark, small_files):
    base, p = small_files
    (p / "_part-x.parquet").mkdir()
    (p / "y.tmp").write_text("x")
    compaction.recover(base)
    assert not (p / "_part-x.parquet").exists() and not (p / "y.tmp").exists()
    (p / compaction.MANIFEST).write_text("{")
    with pytest.raises(compaction.CorruptManifest, match="_compaction.json"):
        compaction.recover(base)
