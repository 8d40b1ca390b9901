"""The stored map: batches, versions, commits, and what a query of a region opens."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import morton
from cairn.operators import fold, world
from cairn.sources.store import Conflict, Store
from cairn.streaming.live import stored
from test_runs import OBS, expected

FIELDS = ("log_odds", "obs_count", "observer_mask", "last_observed", "r", "g", "b", "layer", "class_id")


def observations(n, seed, first=0, at=(-16, 16)):
    r = random.Random(seed)
    out = []
    for seq in range(first, first + n):
        p = tuple(r.randint(at[0] * 4, at[1] * 4 - 1) / 4 + 0.01 for _ in range(3))
        out.append((seq, seq, r.randint(0, 63), *p, r.random() < 0.7, seq % 256, 1, 2, seq % 3, seq % 22))
    return out


def rows_of(df):
    return {tuple(r[c] for c in fold.KEY): tuple(r[c] for c in FIELDS) for r in df.collect()}


def written(root):
    """Bytes of all segments by the folder of their version."""
    out = {}
    for folder, _, names in os.walk(f"{root}/data"):
        version = folder[len(f"{root}/data/") :].split("/")[0]
        out[version] = out.get(version, 0) + sum(os.path.getsize(f"{folder}/{n}") for n in names if n.endswith(".parquet"))
    return [v for k, v in sorted(out.items()) if k]


def test_batches_add_up_and_write_only_what_they_touch(spark, tmp_path):
    store, root = Store(spark, f"file://{tmp_path}/m"), f"{tmp_path}/m"
    big, small, again = observations(4000, 1), observations(300, 2, 4000, (0, 4)), observations(300, 3, 4300, (0, 4))
    one = store.insert(spark.createDataFrame(big, OBS))
    two = store.insert(spark.createDataFrame(small, OBS))
    three = store.insert(spark.createDataFrame(again, OBS).repartition(3))
    assert (one.version, two.version, three.version) == (1, 2, 3)
    assert one.dirty == 8 and two.dirty == three.dirty == 1  # super-chunks
    assert rows_of(store.read()) == expected(big + small + again)
    assert rows_of(store.read(1)) == expected(big) and rows_of(store.read(2)) == expected(big + small)  # older versions stay
    size = written(root)
    assert size[1] < size[0] / 3 and size[2] < 2 * size[1]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/m")
    obs = observations(200, 4)
    df = spark.createDataFrame(obs, OBS)
    assert store.insert(df, ("s", 0)).version == 1
    assert store.insert(df, ("s", 0)).version == 1 and rows_of(store.read()) == expected(obs)
    assert store.insert(df.limit(0), ("s", 1)).version == 1
    assert store.insert(df.where("seq < 50").withColumn("seq", F.col("seq") + 1000), ("t", 0)).version == 2


def test_an_unfinished_write_stays_unseen(spark, tmp_path, monkeypatch):
    store, obs = Store(spark, f"file://{tmp_path}/m"), observations(200, 5)
    store.insert(spark.createDataFrame(obs, OBS))

    def killed(self, made):
        raise KeyboardInterrupt

    more = observations(200, 6, 200)
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            store.insert(spark.createDataFrame(more, OBS))
    assert store.commit().version == 1 and rows_of(store.read()) == expected(obs)
    store.insert(spark.createDataFrame(more, OBS))
    assert rows_of(store.read()) == expected(obs + more)
    assert store.vacuum(1) >= 2 and rows_of(store.read()) == expected(obs + more)


def test_two_writers_of_a_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/m")
    store.insert(spark.createDataFrame(observations(20, 7), OBS))
    with pytest.raises(Conflict):
        store._publish(store.commit())


def test_chunks_go_and_tables_are_written_as_one(spark, tmp_path, monkeypatch):
    from cairn.sources import store as module

    store, obs = Store(spark, f"file://{tmp_path}/m"), observations(300, 8, 0, (0, 3))
    store.insert(spark.createDataFrame(obs, OBS))
    gone = spark.createDataFrame([(0, 0, 0), (1, 2, 0), (500, 0, 0)], "cx short, cy short, cz short")
    store.remove(gone)
    want = {k: v for k, v in expected(obs).items() if k[:3] not in {(0, 0, 0), (1, 2, 0)}}
    assert rows_of(store.read()) == want
    store.remove(store.read().select("cx", "cy", "cz").distinct())
    assert store.read().count() == 0 and store.segments().count() == 0
    few = observations(5, 9, 0, (0, 1))
    monkeypatch.setattr(module, "COMPACT", 4)
    for _ in range(3):
        store.replace(fold.folded(spark.createDataFrame(few, OBS)))
    assert len(store.commit().tables) <= 3 and rows_of(store.read()) == expected(few)


def scanned(df):
    """Files and rows that the scans of `df` read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).collectLeaves()
    files = rows = 0
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        if m.contains("numFiles"):
            files += m.apply("numFiles").value()
            rows += m.apply("numOutputRows").value()
    return files, rows


def test_regions_open_few_files_and_row_groups(spark, tmp_path, monkeypatch):
    from cairn.sources import store as module

    monkeypatch.setattr(module, "GROUP_ROWS", 100)
    store = Store(spark, f"file://{tmp_path}/m")
    grid = spark.range(64 * 64 * 16).select(*(F.expr(e).cast("short").alias(n) for n, e in (("cx", "id % 64 - 32"), ("cy", "id div 64 % 64 - 32"), ("cz", "id div 4096 - 8"), ("ix", "id % 32"), ("iy", "id % 7"), ("iz", "id % 5"))))
    voxels = grid.select("*", F.lit(1.0).cast("float").alias("log_odds"), *(F.lit(1).alias(c) for c in FIELDS[1:]))
    store.replace(voxels)
    total_files, total = scanned(store.read().select("key"))
    assert (total_files, total) == (32, 65536)
    at = world.positioned(store.read())
    planes = [(1.0, 0.0, 0.0, -10.0), (-1.0, 0.0, 0.0, 14.0), (0.0, 1.0, 0.0, 0.0), (0.0, -1.0, 0.0, 6.0)]
    regions = (
        (store.box((1, 1, -3), (5, 5, 2)), at.where("x between 1 and 5 and y between 1 and 5 and z between -3 and 2"), ["key"]),
        (store.sphere((8.0, 8.0, 4.0), 3.0), at.where("(x - 8) * (x - 8) + (y - 8) * (y - 8) + (z - 4) * (z - 4) <= 9"), ["key"]),
        (store.frustum(planes), world.visible(at, planes), ["key"]),
    )
    for got, want, columns in regions:
        keys = sorted(r.key for r in want.select(columns).collect())
        assert keys and sorted(r.key for r in got.select(columns).collect()) == keys
    for relation, most_files in ((morton.box((1, 1, -3), (5, 5, 2)), 2), (morton.sphere((8.0, 8.0, 4.0), 3.0), 1), (morton.whole_chunks(morton.frustum(planes)), 4)):
        files, rows = scanned(store.read(ranges=store._ranges(relation, None)))
        assert files <= most_files and rows < total / 10, (files, rows)
    assert store.box((900, 900, 0), (901, 901, 1)).count() == 0


def test_a_stream_is_inserted_once(spark, tmp_path):
    root, obs = f"file://{tmp_path}/m", observations(400, 10)
    df = spark.createDataFrame(obs, OBS)
    for k in range(2):
        df.where(f"seq div 200 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stored(stream, root, f"{tmp_path}/cp", once=True).awaitTermination()
    assert Store(spark, root).commit().batches == {"live": 1} and rows_of(Store(spark, root).read()) == expected(obs)
    stored(stream, root, f"{tmp_path}/other", once=True).awaitTermination()  # its checkpoint lost, the stream repeats its batches
    assert rows_of(Store(spark, root).read()) == expected(obs)
