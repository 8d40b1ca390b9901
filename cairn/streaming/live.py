"""Stateful stream processors: the live map and pose fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cairn import constants as K
from cairn.operators import detect, fold
from cairn.sources.shared import checkpointed
from cairn.streaming.fusion import STATES, Fusion

LIVE = "cx short, cy short, cz short, ix short, iy short, iz short, log_odds float, obs_count int, last_observed long, layer int"


class LiveMap(StatefulProcessor):
    """A chunk's voxels as state, a map from leaf to evidence; every batch returns the leaves that it changed.

    Updates apply in order of seq within a batch, and batches as they arrive:
    late rows are late.  With `ttl` seconds, leaves of the dynamic layer that
    aren't seen for longer lose their evidence (log-odds zero) and stay; other
    layers never expire.  The clock is the latest t_rel of the chunk, which goes
    on with processing time while nothing comes in.
    """

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.leaves = handle.getMapState("leaves", "leaf int", "log_odds float, obs_count int, last_observed long, layer int")
        self.clock = handle.getValueState("clock", "t long, at_ms long")

    def _expire(self, key, now: int, held: dict[int, list]) -> None:
        """Expired leaves join `held`, those that this call changes."""
        for (leaf,), v in list(self.leaves.iterator()):
            v = held.get(leaf) or list(v)
            if v[3] == K.DYNAMIC and v[2] < now - self.ttl and v[0] != 0.0:
                held[leaf] = [0.0, *v[1:]]

    def _changed(self, key, held: dict[int, list]) -> pd.DataFrame:
        for leaf, v in held.items():
            self.leaves.updateValue((leaf,), tuple(v))
        return pd.DataFrame([(*key, i % 32, i // 32 % 32, i // 1024, *v) for i, v in held.items()], columns=[c.split()[0] for c in LIVE.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        held: dict[int, list] = {}
        for leaf, hit, t, layer in zip((batch["ix"] + 32 * batch["iy"] + 1024 * batch["iz"]).tolist(), batch["hit"].tolist(), batch["t_rel"].tolist(), batch["layer"].tolist(), strict=True):
            if leaf not in held:
                held[leaf] = list(self.leaves.getValue((leaf,))) if self.leaves.containsKey((leaf,)) else [0.0, 0, 0, 0]
            now = held[leaf]
            now[0] = float(min(np.float32(K.HIGH), max(np.float32(K.LOW), np.float32(now[0]) + np.float32(K.HIT if hit else K.MISS))))
            now[1], now[2], now[3] = min(K.MOST_OBSERVATIONS, now[1] + int(hit)), t, layer
        if self.ttl is not None:
            latest = max(int(batch["t_rel"].max()), self.clock.get()[0] if self.clock.exists() else 0)
            ms = timerValues.getCurrentProcessingTimeInMs()
            self.clock.update((latest, ms))
            for leaf, v in held.items():
                self.leaves.updateValue((leaf,), tuple(v))
            self._expire(key, latest, held)
            self.handle.registerTimer(ms + 1000 * (self.ttl + 1))
        yield self._changed(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        if self.ttl is not None and self.clock.exists():
            t, ms = self.clock.get()
            self._expire(key, t + (timerValues.getCurrentProcessingTimeInMs() - ms) // 1000, held)
        yield self._changed(key, held)

    def close(self) -> None:
        pass


def live_map(obs: DataFrame, *, ttl: int | None = None) -> DataFrame:
    """The changed voxels of each batch of a stream of observations; dynamic ones expire after `ttl` seconds. Needs the RocksDB state store."""
    rows = fold.keyed(obs).select(*fold.KEY, "seq", "hit", "t_rel", F.col("layer").cast("int").alias("layer"))
    return rows.groupBy("cx", "cy", "cz").transformWithStateInPandas(LiveMap(ttl), LIVE, "Update", "None" if ttl is None else "ProcessingTime")


POSES = "session long, seq long, state string, x double, y double, z double, qx double, qy double, qz double, qw double, scale double"


def fused(rows: pd.DataFrame, device: str, fusion: Fusion | None = None) -> tuple[Fusion, list[tuple]]:
    """The states after each sample (seq, kind, t, px .. pz, qx .. qw, vx .. vz, and score for matches), in order of seq."""
    f, out = fusion or Fusion(device), []
    for s in rows.sort_values("seq").itertuples(index=False):
        f.feed(s.kind, s.t, np.array([s.px, s.py, s.pz]), np.array([s.qx, s.qy, s.qz, s.qw]), np.array([s.vx, s.vy, s.vz]), getattr(s, "score", 0.0))
        out.append((s.seq, STATES[f.state], *f.position, *f.rotation, f.scale))
    return f, out


def replay(samples: DataFrame, device: str = "robot") -> DataFrame:
    """Pose fusion over a recording: a row per sample and session.

    Sessions are dealt to tasks and read in order; a task holds a batch of
    samples and the fusion of the session that it is in, whatever its length.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, None
        for b in batches:
            for key, rows in b.groupby("session", dropna=False):  # nulls last, as sorted
                key = None if pd.isna(key) else key
                held, out = fused(rows, device, held if key == name else None)
                name = key
                yield pd.DataFrame([(key, *r) for r in out], columns=[c.split()[0] for c in POSES.split(", ")])

    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by ranges, as few sessions' hashes would meet
    dealt = samples.repartitionByRange(parts, F.asc_nulls_last("session")).sortWithinPartitions(F.asc_nulls_last("session"), F.asc_nulls_last("seq"))
    return dealt.mapInPandas(part, POSES)


class Fuse(StatefulProcessor):
    """Pose fusion over a stream: a session's fusion as state."""

    def __init__(self, device: str = "robot"):
        self.device = device

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fusion", "pickled binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pickle

        held = pickle.loads(self.state.get()[0]) if self.state.exists() else None  # noqa: S301  written below
        held, out = fused(pd.concat(list(rows)), self.device, held)
        self.state.update((pickle.dumps(held),))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[c.split()[0] for c in POSES.split(", ")])

    def close(self) -> None:
        pass


def fuse(samples: DataFrame, device: str = "robot") -> DataFrame:
    """Poses of a stream of samples; needs the RocksDB state store."""
    return samples.groupBy("session").transformWithStateInPandas(Fuse(device), POSES, "Append", "None")


class Refinement:
    """The refinement queue of a running map: a small table (QUEUE rows at most) between passes.

    A pass scans for thin chunks where the queue is empty, and hands the next
    task to `sink(head, id)`; in the explore mode nothing is refined.
    """

    def __init__(self, voxels, sink, mode: str = "hybrid"):
        self.voxels, self.sink, self.mode, self.queue = voxels, sink, mode, None

    def __call__(self, batch: DataFrame | None, number: int) -> None:
        if self.mode not in ("hybrid", "refine"):
            return
        if self.queue is None or not self.queue.limit(1).count():
            thin = detect.thin_chunks(self.voxels()).select("cx", "cy", "cz", F.lit(2).alias("priority"), F.col("voxels").cast("double").alias("observations"))
            self.queue = checkpointed(detect.queue(thin.withColumn("seq", F.xxhash64("cx", "cy", "cz"))))
        head, rest = detect.dequeued(self.queue)
        if head.limit(1).count():
            self.sink(head, number)
            self.queue = checkpointed(rest)


def refine(ticks: DataFrame, voxels, sink, *, mode: str = "hybrid", seconds: int = 5):
    """Start a background pass every `seconds`, driven by a stream of ticks (any rows): `voxels()` gives the map, `sink(head, id)` takes a task."""
    return ticks.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(Refinement(voxels, sink, mode)).start()


def preview(points: DataFrame, most: int, sink) -> object:
    """Start a preview of a stream of points: every two seconds a strided sample of what came in."""
    from cairn.operators.world import strided

    return points.writeStream.trigger(processingTime="2 seconds").foreachBatch(lambda b, i: sink(strided(b, most, ["x", "y", "z"]), i)).start()


def stored(obs: DataFrame, root: str, checkpoint: str, *, name: str = "live", once: bool = False):
    """Start a query that inserts each batch of a stream of observations into the map stored under `root`, once: a batch that a restart repeats changes nothing."""
    from cairn.sources.store import Store

    writer = obs.writeStream.foreachBatch(lambda b, i: Store(b.sparkSession, root).insert(b, (name, i))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
