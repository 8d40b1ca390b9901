"""A stored map that grows by batches: super-chunks in Morton order, versions, commits.

A super-chunk's voxels are one segment, Parquet sorted by Morton key.  A batch
reads and writes the segments of the super-chunks that it touches and no others;
what it wrote becomes visible by one commit file, created last and never
overwritten.  Readers take the newest commit, so a killed or failed write leaves
the version before it, and two writers of one version can't both win.

    root/data/<version>-<token>/super=<k>/...   segments
    root/segments/<version>-<token>/...         per segment: super, folder, rows, least and greatest key
    root/commits/<version>                      what the version is made of, as JSON

A commit names the segment tables that are in force, of which a super-chunk's
newest row counts; from COMPACT on they are written as one.  A query for a box, a
sphere or a frustum cuts the region into ranges of keys, opens only segments
whose keys meet one, and hands the ranges to the reader, which skips row groups.
A commit may carry the number of a stream's batch; a batch that comes again
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import morton
from cairn.operators import fold, runs, world
from cairn.sources.shared import checkpointed

#: Segment tables of a commit before they are written as one, and rows of a row group.
COMPACT, GROUP_ROWS = 16, 20_000
VOXEL = "key long, cx short, cy short, cz short, ix short, iy short, iz short, log_odds float, obs_count int, observer_mask long, last_observed long, r long, g long, b long, layer int, class_id long"
_NAMES = [c.split()[0] for c in VOXEL.split(", ")]
_TYPED = ["cast({} as {}) as {}".format(*c.split(), c.split()[0]) for c in VOXEL.split(", ")]
_SEGMENT = "super long, folder string, version long, rows long, low long, high long"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was making."""


@dataclass(frozen=True)
class Commit:
    version: int = 0
    tables: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)
    dirty: int = 0


class Store:
    """A map under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, (self.root, *parts))))

    # --- versions -----------------------------------------------------------

    def commit(self, version: int | None = None) -> Commit:
        """The newest commit, or that of `version`; an empty one where there is none yet."""
        if version is None:
            folder = self._path("commits")
            have = [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []
            version = max((int(n) for n in have if n.isdigit()), default=0)
        if not version:
            return Commit()
        with_text = self.files.open(self._path("commits", f"{version:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_text, "UTF-8")
        finally:
            with_text.close()
        return Commit(**json.loads(text))

    def _publish(self, made: Commit) -> None:
        """Make `made` the newest version: the text is written aside and renamed, which fails where the name is taken."""
        name, aside = self._path("commits", f"{made.version:012d}"), self._path("commits", f".{uuid.uuid4().hex}")
        out = self.files.create(aside, False)
        try:
            out.write(bytearray(json.dumps(made.__dict__).encode()))
        finally:
            out.close()
        if self.files.exists(name) or not self.files.rename(aside, name):
            self.files.delete(aside, False)
            raise Conflict(f"version {made.version} of {self.root} is taken")

    def segments(self, version: int | None = None) -> DataFrame:
        """The segments in force: super, folder, version, rows, low, high."""
        tables = self.commit(version).tables
        if not tables:
            return self.spark.createDataFrame([], _SEGMENT)
        all_rows = self.spark.read.schema(_SEGMENT).parquet(*(f"{self.root}/segments/{t}" for t in tables))
        newest = all_rows.groupBy("super").agg(F.max_by(F.struct("folder", "version", "rows", "low", "high"), "version").alias("s"))
        return newest.select("super", "s.*").where("rows > 0")

    # --- writing ------------------------------------------------------------

    def _write(self, voxels: DataFrame, touched: DataFrame, before: Commit, batch: tuple[str, int] | None) -> Commit:
        """Write segments of `voxels`, all those of the super-chunks in `touched` (super), and commit them."""
        version, token = before.version + 1, uuid.uuid4().hex[:12]
        folder = f"{version:012d}-{token}"
        data = f"{self.root}/data/{folder}"
        rows = voxels.selectExpr(*_TYPED).withColumn("super", morton.super_key())
        dealt = rows.repartition("super").sortWithinPartitions("super", "key")
        dealt.write.option("parquet.block.row.count.limit", GROUP_ROWS).partitionBy("super").parquet(data)
        written = self.spark.read.schema("key long, super long").parquet(data)
        sizes = written.groupBy("super").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        known = touched.join(sizes, "super", "left").select("super", F.lit(folder).alias("folder"), F.lit(version).cast("long").alias("version"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "low", "high")
        known.coalesce(1).write.parquet(f"{self.root}/segments/{folder}")
        tables = [*before.tables, folder]
        made = Commit(version, tables, {**before.batches, **({batch[0]: batch[1]} if batch else {})}, self.spark.read.schema(_SEGMENT).parquet(f"{self.root}/segments/{folder}").count())
        if len(tables) > COMPACT:
            whole = f"{folder}-all"
            every = self.spark.read.schema(_SEGMENT).parquet(*(f"{self.root}/segments/{t}" for t in tables))
            newest = every.groupBy("super").agg(F.max_by(F.struct("folder", "version", "rows", "low", "high"), "version").alias("s"))
            newest.select("super", "s.*").write.parquet(f"{self.root}/segments/{whole}")
            made = Commit(version, [whole], made.batches, made.dirty)
        self._publish(made)
        return made

    def _segment_rows(self, segments: list) -> DataFrame:
        paths = [f"{self.root}/data/{r['folder']}/super={r['super']}" for r in segments]
        return self.spark.read.schema(VOXEL).parquet(*paths) if paths else self.spark.createDataFrame([], VOXEL)

    def insert(self, obs: DataFrame, batch: tuple[str, int] | None = None) -> Commit:
        """The map after the observations `obs` (see `fold.folded`), which apply after all that is stored; returns the commit.

        `batch` names a stream and the number of its batch: one that is committed
        already changes nothing.  No observation, no commit.
        """
        before = self.commit()
        if batch and before.batches.get(batch[0], -1) >= batch[1]:
            return before
        fresh = checkpointed(runs.voxels(obs.withColumn("mask", fold.bit())))
        touched = checkpointed(fresh.select(morton.super_key().alias("super")).distinct())
        if not touched.limit(1).count():
            return before
        have = self.segments(before.version).join(touched, "super", "left_semi").collect()  # a row for each super-chunk that changes
        return self._write(self._after(self._segment_rows(have), fresh), touched, before, batch)

    @staticmethod
    def _after(state: DataFrame, fresh: DataFrame) -> DataFrame:
        """Stored voxels after the runs of `fresh`."""
        last = {"last_observed": "t_rel", **{c: c for c in ("r", "g", "b", "layer", "class_id")}}
        new = fresh.select("key", *(F.col(c).alias(f"new_{c}") for c in fold.KEY), F.struct("lo", "hi", "steps").alias("run"), "hits", "mask", *(F.col(c).alias(f"new_{n}") for n, c in last.items()))
        both = state.join(new, "key", "full_outer")
        start = F.coalesce("log_odds", F.lit(0.0).cast("float"))
        seen = F.col("run").isNotNull()
        count = F.least(F.lit(K.MOST_OBSERVATIONS), F.coalesce("obs_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).cast("int")
        return both.select(
            "key",
            *(F.coalesce(c, f"new_{c}").alias(c) for c in fold.KEY),
            F.when(seen, runs.applied(start, F.col("run"))).otherwise(start).alias("log_odds"),
            count.alias("obs_count"),
            F.coalesce("observer_mask", F.lit(0)).bitwiseOR(F.coalesce("mask", F.lit(0))).alias("observer_mask"),
            *(F.when(seen, F.col(f"new_{n}")).otherwise(F.col(n)).alias(n) for n in last),
        )

    def replace(self, voxels: DataFrame, batch: tuple[str, int] | None = None) -> Commit:
        """Store `voxels` in place of all that the super-chunks they lie in hold."""
        keyed = voxels if "key" in voxels.columns else voxels.withColumn("key", morton.key())
        keyed = checkpointed(keyed.select(*_NAMES))
        touched = checkpointed(keyed.select(morton.super_key().alias("super")).distinct())
        return self._write(keyed, touched, self.commit(), batch)

    def remove(self, chunks: DataFrame) -> Commit:
        """Drop the chunks `chunks` (cx, cy, cz); super-chunks that are left without a voxel have no segment."""
        before = self.commit()
        code = F.shiftright(morton.key(), morton.CHUNK_BITS)
        gone = checkpointed(chunks.select("cx", "cy", "cz", *(F.lit(0).cast("short").alias(f"i{a}") for a in "xyz")).select(code.alias("chunk")).distinct())
        touched = gone.select(F.shiftright("chunk", morton.SUPER_BITS - morton.CHUNK_BITS).alias("super")).distinct()
        have = self.segments(before.version).join(touched, "super", "left_semi").collect()
        if not have:
            return before
        rows = self._segment_rows(have).withColumn("chunk", F.shiftright("key", morton.CHUNK_BITS)).join(gone, "chunk", "left_anti")
        own = self.spark.createDataFrame([(r["super"],) for r in have], "super long")
        return self._write(rows.select(*_NAMES), own, before, None)

    def vacuum(self, keep: int = 2) -> int:
        """Delete what no commit of the last `keep` needs, unfinished writes included; returns how many folders went.  No writer may be at work."""
        newest = self.commit().version
        kept = [self.commit(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        tables = {t for c in kept for t in c.tables}
        data = {r["folder"] for c in kept for r in self.segments(c.version).select("folder").distinct().collect()}
        gone = 0
        for kind, needed in (("segments", tables), ("data", data), ("commits", {f"{c.version:012d}" for c in kept})):
            folder = self._path(kind)
            for s in self.files.listStatus(folder) if self.files.exists(folder) else []:
                if s.getPath().getName() not in needed:
                    self.files.delete(s.getPath(), True)
                    gone += kind != "commits"
        return gone

    # --- reading ------------------------------------------------------------

    def read(self, version: int | None = None, ranges: morton.Ranges | None = None) -> DataFrame:
        """The voxels of a version; with `ranges`, those whose keys lie in one.  Folders of a version that is kept stay readable."""
        segments = self.segments(version)
        if ranges is None:
            return self._segment_rows(segments.select("super", "folder").collect())
        meets = F.lit(False)
        for a, z in ranges:
            meets = meets | ((F.col("low") <= z) & (F.col("high") >= a))
        return self._segment_rows(segments.where(meets).select("super", "folder").collect()).where(morton.within(ranges))

    def _ranges(self, relation: morton.Relation, version: int | None) -> morton.Ranges:
        """Ranges of a region's keys within the super-chunks that there are: a region without an end is cut at the map's."""
        corner = F.shiftleft("super", morton.SUPER_BITS)
        at = morton.located(self.segments(version).select(corner.alias("key")))
        ends = at.agg(*(f(f"c{a}") for f in (F.min, F.max) for a in "xyz")).first()
        if ends[0] is None:
            return []
        return morton.ranges(morton.both(relation, morton.box(ends[:3], [c + K.SUPER for c in ends[3:]])))

    def box(self, low: tuple[float, float, float], high: tuple[float, float, float], version: int | None = None) -> DataFrame:
        """Voxels whose centre lies between two corners, both included."""
        rows = world.positioned(self.read(version, self._ranges(morton.box(low, high), version)))
        return rows.where(F.expr(" and ".join(f"{a} between {lo} and {hi}" for a, lo, hi in zip("xyz", low, high, strict=True))))

    def sphere(self, centre: tuple[float, float, float], radius: float, version: int | None = None) -> DataFrame:
        """Voxels whose centre is no further than `radius` from `centre`."""
        rows = world.positioned(self.read(version, self._ranges(morton.sphere(centre, radius), version)))
        return rows.where(sum((F.col(a) - c) * (F.col(a) - c) for a, c in zip("xyz", centre, strict=True)) <= radius * radius)

    def frustum(self, planes: list[tuple[float, float, float, float]], version: int | None = None) -> DataFrame:
        """Voxels of the chunks that a frustum shows, as `world.visible` has them."""
        rows = self.read(version, self._ranges(morton.whole_chunks(morton.frustum(planes)), version))
        return world.positioned(rows.join(world.visible(rows.select("cx", "cy", "cz").distinct(), planes).select("cx", "cy", "cz"), ["cx", "cy", "cz"], "left_semi"))
