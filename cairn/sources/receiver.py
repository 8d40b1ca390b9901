"""A live capture as a stream of bytes: a socket, or a recording at its own pace, behind a replayable spool.

A socket can't be read twice, so the reader on the driver first writes what it
receives to the spool, a folder that all executors share, and only then offers
it as an offset, the number of bytes so far.  Executors read the spool, so a lost
task or a restart reads the same bytes again; each connection is a session, named
by the position where it began.

Admission is by not reading: at most `maxBytes` a batch and `bytesPerSecond`, and
with `speed` no frame that is further on in the recording than the time since the
first one times that speed (from FAST on, as fast as it comes).  What isn't read
waits at the sender.
"""

from __future__ import annotations

import json
import select
import socket
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from cairn.sources import wire

CHUNKS = "session long, at long, chunk binary"
#: Bytes of one read, of a row, and the most of a batch unless given; seconds a reader waits for bytes, and for quiet before it stops; the speed that is no longer paced.
READ, ROW, BATCH, WAIT, QUIET, FAST = 1 << 16, 1 << 20, 64 << 20, 0.05, 0.2, 10.0


@dataclass
class Segment(InputPartition):
    """Bytes `start` to `end` of the spool file that begins at `begins`."""

    path: str
    session: int
    begins: int
    start: int
    end: int


class Spool:
    """Files of bytes in order, each named by where it begins and ends and by its session."""

    def __init__(self, root: str):
        self.root = root if "://" in root else f"file://{root}"
        self.fs, self.base = fs.FileSystem.from_uri(self.root)
        self.fs.create_dir(self.base, recursive=True)

    def segments(self) -> list[tuple[int, int, int, str]]:
        """(begin, end, session, path) in order."""
        found = self.fs.get_file_info(fs.FileSelector(self.base))
        out = []
        for f in found:
            if f.base_name.endswith(".bytes"):
                begin, end, session = f.base_name[: -len(".bytes")].split("-")
                out.append((int(begin), int(end), int(session), f.path))
        return sorted(out)

    def append(self, at: int, session: int, data: bytes) -> int:
        """The end after `data`, whose file appears as a whole or not at all."""
        name = f"{self.base}/{at:020d}-{at + len(data):020d}-{session:020d}.bytes"
        with self.fs.open_output_stream(name + ".part") as out:
            out.write(data)
        self.fs.move(name + ".part", name)
        return at + len(data)

    def drop(self, end: int) -> None:
        """Files that lie before `end` go, but for the last one, which tells where the stream is."""
        for _, z, _, path in self.segments()[:-1]:
            if z <= end:
                self.fs.delete_file(path)

    def tell(self, state: str) -> None:
        """Keep the state of the connection beside the bytes."""
        with self.fs.open_output_stream(f"{self.base}/connection.json") as out:
            out.write(json.dumps({"state": state, "time": time.time()}).encode())


def connection(root: str) -> str:
    """The last known state of a spool's connection: searching, connected or disconnected."""
    spool = Spool(root)
    try:
        with spool.fs.open_input_stream(f"{spool.base}/connection.json") as f:
            return json.loads(f.read())["state"]
    except FileNotFoundError:
        return "searching"


class Pace:
    """How far a stream may be read: by bytes a second, and by the time stamps of its frames."""

    def __init__(self, per_second: float | None = None, speed: float | None = None, clock=time.monotonic):
        self.per_second, self.speed, self.clock = per_second, speed if speed is None or speed < FAST else None, clock
        self.credit, self.last = 0.0, None
        self.began, self.first, self.latest = None, None, None
        self.left, self.head, self.broken = 0, b"", False

    def allowed(self, want: int) -> int:
        """How many of `want` bytes may be read now."""
        now = self.clock()
        if self.speed is not None and self.latest is not None and (self.latest - self.first) > (now - self.began) * self.speed:
            return 0
        if self.per_second is None:
            return want
        self.credit = min(self.per_second, self.credit + (now - self.last) * self.per_second) if self.last is not None else 0.0
        self.last = now
        return min(want, int(self.credit))

    def took(self, data: bytes) -> None:
        """`data` was read: less credit, and its frames' time stamps count."""
        if self.per_second is not None:
            self.credit -= len(data)
        at = 0
        while self.speed is not None and not self.broken and at < len(data):
            if self.left:  # within a message
                skip = min(self.left, len(data) - at)
                self.left, at = self.left - skip, at + skip
                continue
            need = 20 - len(self.head)  # length, magic, sequence and time stamp
            self.head, at = self.head + data[at : at + need], min(len(data), at + need)
            if len(self.head) >= 4 and (size := struct.unpack_from("<I", self.head)[0] + 4) <= len(self.head):
                at -= len(self.head) - size  # a short message
                self.head = b""
            elif len(self.head) == 20:
                self.left = size - 20
                if self.head[4:8] == wire.FRAME and struct.unpack_from("<I", self.head, 8)[0] != wire.STOP:
                    self.latest = struct.unpack_from("<d", self.head, 12)[0]
                    if self.first is None:
                        self.first, self.began = self.latest, self.clock()
                self.head = b""


class _Socket:
    """The bytes of a connection; None where nothing waits, empty where the other side closed it."""

    def __init__(self, host: str, port: int):
        self.s = socket.create_connection((host, port), timeout=5)
        self.s.setblocking(False)

    def read(self, most: int, wait: float) -> bytes | None:
        if not select.select([self.s], [], [], wait)[0]:
            return None
        try:
            return self.s.recv(most)
        except BlockingIOError:
            return None
        except ConnectionError:
            return b""

    def close(self) -> None:
        self.s.close()


class _Recording:
    """The bytes of a file, from `at` on."""

    def __init__(self, path: str, at: int):
        where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.f = where.open_input_file(name)
        self.f.seek(min(at, self.f.size()))

    def read(self, most: int, wait: float) -> bytes | None:
        return self.f.read(most) or None

    def close(self) -> None:
        self.f.close()


class Reader(DataSourceStreamReader):
    """The reader on the driver and, for its partitions, in tasks."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.most = int(self.options.get("maxbytes", BATCH))
        number = lambda name: float(self.options[name]) if name in self.options else None
        self.pace = Pace(number("bytespersecond"), number("speed"))
        self.spool, self.feed, self.end, self.session = None, None, 0, 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"feed": None, "spool": None}  # tasks have no part in the connection

    def _open(self) -> Spool:
        if self.spool is None:
            self.spool = Spool(self.options["spool"])
            have = self.spool.segments()
            self.end = have[-1][1] if have else 0
            self.session = have[-1][2] if have else 0
        return self.spool

    def _connected(self) -> bool:
        if self.feed is None:
            try:
                if "path" in self.options:
                    self.feed = _Recording(self.options["path"], self.end)
                else:
                    self.feed = _Socket(self.options["host"], int(self.options["port"]))
                    self.session = self.end
                self.spool.tell("connected")
            except OSError:
                self.spool.tell("searching")
        return self.feed is not None

    def _receive(self, most: int, until: float, quiet: float) -> None:
        """Spool what comes: `most` bytes at most, until the clock says so or nothing has come for `quiet` seconds."""
        got, n, last = [], 0, time.monotonic()
        while n < most and time.monotonic() < until and self._connected():
            allowed = self.pace.allowed(min(READ, most - n))
            data = self.feed.read(allowed, min(WAIT, quiet)) if allowed > 0 else None
            if data is None:
                if time.monotonic() - last >= quiet:
                    break
                if allowed <= 0:
                    time.sleep(0.005)
                continue
            if not data:
                self.feed.close()
                self.feed = None
                self.spool.tell("disconnected")
                break
            self.pace.took(data)
            got.append(data)
            n, last = n + len(data), time.monotonic()
        if n:
            self.end = self.spool.append(self.end, self.session, b"".join(got))

    def initialOffset(self) -> dict:
        have = self._open().segments()
        return {"at": have[0][0] if have else 0}

    def latestOffset(self) -> dict:
        self._open()
        self._receive(self.most, time.monotonic() + 1.0, WAIT)
        return {"at": self.end}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        a, z = start["at"], end["at"]
        return [Segment(path, session, begin, max(a, begin), min(z, stop)) for begin, stop, session, path in self._open().segments() if begin < z and stop > a]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.options["spool"] if "://" in self.options["spool"] else f"file://{self.options['spool']}")
        with where.open_input_file(partition.path) as f:
            f.seek(partition.start - partition.begins)
            at = partition.start
            while at < partition.end:
                data = f.read(min(ROW, partition.end - at))
                yield pa.RecordBatch.from_arrays([pa.array([partition.session], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["session", "at", "chunk"])
                at += len(data)

    def commit(self, end: dict) -> None:
        if self.options.get("retain", "true") != "true":
            self._open().drop(end["at"])

    def stop(self) -> None:
        """What already waits is spooled, then the connection closes; the next reader offers it."""
        if self.feed is not None:
            if "path" not in self.options:
                self.pace = Pace()
                self._receive(self.most, time.monotonic() + 5.0, QUIET)
            if self.feed is not None:
                self.feed.close()
            self.feed = None
            self.spool.tell("disconnected")


class Capture(DataSource):
    """Options: host and port, or path (a recording); spool; maxBytes, bytesPerSecond, speed; retain (else, spool files go once they are committed)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return CHUNKS

    def streamReader(self, schema: StructType) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def received(spark: SparkSession, *, spool: str | None = None, **options) -> DataFrame:
    """A stream (session, at, chunk) of a capture with the options of `Capture`; the spool lies in the shared folder unless given."""
    if spool is None:
        from cairn.sources.shared import shared_dir

        spool = f"{shared_dir(spark)}/captures/{options.get('host', 'recording')}-{options.get('port', 0)}"
    spark.dataSource.register(Capture)
    reader = spark.readStream.format("capture").option("spool", spool)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
