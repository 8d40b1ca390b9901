"""A live capture: messages cut anywhere, a socket that is stopped and restarted, admission by bytes and by time."""

import random
import socket
import struct
import threading
import time

import pytest

from cairn.sources import receiver, wire
from cairn.streaming import reassembly


def frame(n, timestamp=0.0, size=40):
    return wire.prefixed(wire.encode_frame(wire.Frame(n, timestamp, image=bytes([n % 251]) * size, points=struct.pack("<3f4B", n, 2, 3, 9, 8, 7, 0), point_count=1, flags=wire.COLOURED)))


STREAM = frame(1) + wire.prefixed(wire.encode_status((1, 2, 3, 4, 5, 6))) + frame(2, size=0) + wire.prefixed(wire.encode_command(0, 1)) + frame(3)


def fed(session, chunks):
    return [m for c in chunks for m in session.feed([c])]


def test_cut_at_every_byte():
    whole = fed(reassembly.Session(0), [(0, STREAM)])
    assert [k for _, k, _ in whole] == ["frame", "status", "frame", "command", "frame"]
    for i in range(len(STREAM) + 1):
        assert fed(reassembly.Session(0), [(0, STREAM[:i]), (i, STREAM[i:])]) == whole
    assert fed(reassembly.Session(0), [(i, STREAM[i : i + 1]) for i in range(len(STREAM))]) == whole


def test_chunks_twice_out_of_order_and_overlapping():
    whole, r = fed(reassembly.Session(0), [(0, STREAM)]), random.Random(3)
    for _ in range(100):
        cuts = sorted(r.sample(range(len(STREAM)), 8))
        chunks = [(a, STREAM[a : z + r.randint(0, 30)]) for a, z in zip([0, *cuts], [*cuts, len(STREAM)])] * 2
        r.shuffle(chunks)
        session = reassembly.Session(0)
        assert fed(session, chunks) == whole and session.tail == b"" and not session.early


def test_a_session_ends_at_a_stop_marker_or_garbage():
    for end in (wire.prefixed(wire.stop_marker()), b"\4\0\0\0????", struct.pack("<I", (1 << 31) + 5) + wire.FRAME):
        session = reassembly.Session(0)
        got = fed(session, [(0, frame(1) + end), (len(frame(1) + end), frame(2))])
        assert [m.sequence for _, _, m in got] == [1] and session.closed and not session.tail and not session.early


def chunked(session, data, size):
    return [(session, session + i, data[i : i + size]) for i in range(0, len(data), size)]


@pytest.mark.parametrize("size", [7, 61, 10_000])
def test_recorded_chunks(spark, size):
    rows = chunked(0, STREAM, size) + chunked(5000, frame(9) + STREAM[:-3], size) + [(None, 0, b"x"), (0, None, b"x"), (0, 3, None), (77, 77, b"")]
    random.Random(1).shuffle(rows)
    got = reassembly.recorded(spark.createDataFrame(rows, receiver.CHUNKS)).collect()
    assert sorted((r.session, r.kind, r.sequence) for r in got if r.kind == "frame") == [(0, "frame", 1), (0, "frame", 2), (0, "frame", 3), (5000, "frame", 1), (5000, "frame", 2), (5000, "frame", 9)]
    assert [r.status for r in got if r.kind == "status"] == [[1, 2, 3, 4, 5, 6]] * 2
    assert reassembly.recorded(spark.createDataFrame([], receiver.CHUNKS)).count() == 0


class Sender:
    """A server that hands each connection its bytes, a piece at a time, and leaves it open."""

    def __init__(self, streams):
        self.s = socket.create_server(("127.0.0.1", 0))
        self.port, self.streams, self.open = self.s.getsockname()[1], streams, []
        threading.Thread(target=self._serve, daemon=True).start()

    def _serve(self):
        for data in self.streams:
            c, _ = self.s.accept()
            self.open.append(c)
            try:
                for i in range(0, len(data), 97):
                    c.sendall(data[i : i + 97])
            except OSError:
                pass


def running(spark, tmp_path, got, **options):
    stream = reassembly.messages(receiver.received(spark, spool=str(tmp_path / "spool"), host="127.0.0.1", **options))
    return stream.writeStream.foreachBatch(lambda b, i: got.extend((i, r.session, r.sequence) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()


def wait(query, ready, seconds=90):
    end = time.time() + seconds
    while not ready() and time.time() < end:
        assert query.isActive, query.exception()
        time.sleep(0.2)
    assert ready()


def test_a_socket_is_read_stopped_and_read_on(spark, tmp_path):
    first, second = b"".join(frame(i) for i in range(40)), b"".join(frame(i) for i in range(40, 90))
    sender, got = Sender([first + frame(40)[:50], second]), []
    query = running(spark, tmp_path, got, port=sender.port)
    wait(query, lambda: len(got) >= 40)
    query.stop()
    assert receiver.connection(str(tmp_path / "spool")) in ("connected", "disconnected")  # the reader may still be draining
    assert [n for _, _, n in got] == list(range(40))
    query = running(spark, tmp_path, got, port=sender.port)
    wait(query, lambda: len(got) >= 90)
    query.stop()
    assert [n for _, _, n in got] == list(range(90))  # none lost, none twice; the message cut by the first connection came whole by the second
    assert [s for _, s, _ in got] == [0] * 40 + [len(first) + 50] * 50


def test_a_reader_that_starts_anew_offers_the_same_bytes(tmp_path):
    sender = Sender([STREAM])
    options = {"spool": str(tmp_path / "s"), "host": "127.0.0.1", "port": str(sender.port), "maxbytes": "150"}
    one = receiver.Reader(options)
    assert one.initialOffset() == {"at": 0}
    ends = [one.latestOffset()["at"] for _ in range(6)]
    assert all(z - a <= 150 for a, z in zip([0, *ends], ends)) and ends[-1] == len(STREAM)
    again = receiver.Reader(options)
    for reader in (one, again):
        parts = reader.partitions({"at": 10}, {"at": len(STREAM) - 5})
        assert b"".join(b.column("chunk")[0].as_py() for p in parts for b in reader.read(p)) == STREAM[10:-5]
    one.options["retain"] = "false"
    one.commit({"at": len(STREAM)})
    assert len(one.spool.segments()) == 1 and one.spool.segments()[-1][1] == len(STREAM)
    one.stop()


def test_admission_by_bytes_a_second():
    now = [0.0]
    pace = receiver.Pace(per_second=1000, clock=lambda: now[0])
    taken = 0
    for _ in range(500):
        now[0] += 0.01
        n = pace.allowed(65536)
        pace.took(bytes(n))
        taken += n
    assert 4900 <= taken <= 5000
    now[0] += 3600
    assert pace.allowed(65536) == 1000  # no more than a second's worth after a pause


def test_a_recording_keeps_its_pace(tmp_path):
    data = b"".join(frame(i, i / 10) for i in range(50)) + wire.prefixed(wire.stop_marker())
    for speed, most in ((1.0, 12), (4.0, 45), (10.0, 50)):
        now, at, pace = [0.0], 0, None
        pace = receiver.Pace(speed=speed, clock=lambda now=now: now[0])
        for _ in range(110):  # 1.1 seconds
            while (n := pace.allowed(13)) and at < len(data):
                pace.took(data[at : at + n])
                at += n
            now[0] += 0.01
        seen = len(list(wire.messages(data[:at])))
        assert most - 2 <= seen <= most + 1, (speed, seen)


def test_a_recording_as_a_stream(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"".join(frame(i, i / 100) for i in range(30)) + wire.prefixed(wire.stop_marker()) + frame(99))
    got = []
    query = running(spark, tmp_path, got, path=str(tmp_path / "a.bin"), maxBytes=900)
    wait(query, lambda: len(got) >= 30)
    time.sleep(1)
    query.stop()
    assert [n for _, _, n in got] == list(range(30)) and len({i for i, _, _ in got}) > 3
