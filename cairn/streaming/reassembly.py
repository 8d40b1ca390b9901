"""Messages from a stream of bytes that comes in chunks, cut anywhere.

A session's state is where its bytes have been read up to, the start of a message
that isn't whole yet, and chunks that came too early.  Bytes that come again are
dropped, so a replayed chunk changes nothing; chunks beyond a gap wait for it.  A
stop marker or bytes that are no known message end the session: nothing more of
it is read, as nothing after them could be told apart.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cairn.sources import wire

#: Bytes of a message at most; a greater length ends its session instead of being waited for.
LARGEST = 1 << 30
MESSAGES = f"session long, at long, {wire.FRAMES}, point_count int, detection_count int, status array<int>"
_NAMES = [c.split()[0] for c in MESSAGES.split(", ")]
_KINDS = (wire.FRAME, wire.STATUS, wire.PREVIEW, wire.COMMAND, wire.SNAPSHOT)
_SCHEMA = pa.schema([("session", pa.int64()), ("at", pa.int64()), *wire._SCHEMA, ("point_count", pa.int32()), ("detection_count", pa.int32()), ("status", pa.list_(pa.int32()))])


@dataclass
class Session:
    """Bytes of a session that begins at `at`: what is read is `tail`, whose first byte is at `at`."""

    at: int
    tail: bytes = b""
    closed: bool = False
    early: dict[int, bytes] = field(default_factory=dict)

    def feed(self, chunks: Iterable[tuple[int, bytes]]) -> Iterator[tuple[int, str, object]]:
        """(place, kind, message) of the messages that the chunks (place, bytes), in any order, make whole."""
        for at, data in chunks:
            if data and len(data) > len(self.early.get(at, b"")):
                self.early[at] = data
        if self.closed:
            self.early.clear()
            return
        end, parts = self.at + len(self.tail), [self.tail]
        for at in sorted(self.early):
            if at > end:
                break
            data = self.early.pop(at)[end - at :]
            parts.append(data)
            end += len(data)
        self.tail = b"".join(parts)
        read = 0
        for kind, message, upto in wire.messages(self.tail):
            if kind == "frame" and message is not None and message.sequence == wire.STOP:
                self._close()
                return
            yield self.at + read, kind, message
            read = upto
        self.at, self.tail = self.at + read, self.tail[read:]
        if len(self.tail) >= 8 and (self.tail[4:8] not in _KINDS or struct.unpack_from("<I", self.tail)[0] > LARGEST):
            self._close()

    def _close(self) -> None:
        self.closed, self.tail = True, b""
        self.early.clear()


def _row(session: int, at: int, kind: str, message: object) -> dict | None:
    """A message as a row: frames by their fields, status by its six bytes; others by kind and place; none for a message that can't be decoded."""
    if message is None:
        return None
    own = {"session": session, "at": at, "kind": kind}
    if kind == "frame":
        fields = asdict(message)
        own |= {n: fields[n] for n in _NAMES if n in fields}
    elif kind == "status":
        own |= {"flags": message[0], "status": list(message)}
    return dict.fromkeys(_NAMES) | own


class Reassembly(StatefulProcessor):
    """A session's unread bytes as state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "at long, tail binary, closed boolean")
        self.early = handle.getMapState("early", "at long", "chunk binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, tail, closed = self.held.get() if self.held.exists() else (key[0], b"", False)
        before = {k: bytes(v) for (k,), (v,) in self.early.iterator()}
        session = Session(at, bytes(tail), closed, dict(before))
        chunks = ((a, bytes(c)) for b in rows for a, c in zip(b["at"].tolist(), b["chunk"], strict=True))
        out = [r for m in session.feed(chunks) if (r := _row(key[0], *m))]
        self.held.update((session.at, session.tail, session.closed))
        for k in before.keys() - session.early.keys():
            self.early.removeKey((k,))
        for k, v in session.early.items():
            if before.get(k) != v:
                self.early.updateValue((k,), (v,))
        yield pa.Table.from_pylist(out, schema=_SCHEMA).to_pandas(integer_object_nulls=True)

    def close(self) -> None:
        pass


def messages(chunks: DataFrame) -> DataFrame:
    """The messages of a stream (session, at, chunk) of bytes; needs the RocksDB state store.

    A session's first byte is at the place that names it.  Null and empty chunks
    hold nothing.
    """
    rows = chunks.where("session is not null and at is not null and chunk is not null").select("session", "at", "chunk")
    return rows.groupBy("session").transformWithStateInPandas(Reassembly(), MESSAGES, "Append", "None")


def recorded(chunks: DataFrame) -> DataFrame:
    """The same over a table of chunks: sessions are dealt to tasks and read in order, a message's bytes held at a time."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Session | None = None
        name = None
        for b in batches:
            rows = []
            for key, at, data in zip(b.column("session").to_pylist(), b.column("at").to_pylist(), b.column("chunk").to_pylist(), strict=True):
                if key != name:
                    name, held = key, Session(key)
                rows += [r for m in held.feed([(at, data)]) if (r := _row(key, *m))]
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    rows = chunks.where("session is not null and at is not null and chunk is not null").select("session", "at", "chunk")
    return rows.repartition("session").sortWithinPartitions("session", "at").mapInArrow(part, MESSAGES)
