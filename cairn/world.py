"""A map as one object: voxels, and the queries over them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from cairn import constants as K
from cairn.operators import fold, grouped, rays, world
from cairn.sources import maps


@dataclass(frozen=True)
class World:
    """Voxels of a map; every operation returns a new one. mode: additive or subtractive."""

    voxels: DataFrame
    name: str = ""
    created: str = ""
    mode: str = "additive"

    @classmethod
    def of(cls, obs: DataFrame, **more) -> World:
        return cls(fold.folded(obs), **more)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **more) -> World:
        return cls(maps.load(spark, path), **more)

    @classmethod
    def read(cls, spark: SparkSession, path: str, **more) -> World:
        """From map files: each of their voxels is one hit."""
        return cls(fold.folded(maps.read_maps(spark, path)), **more)

    def save(self, path: str) -> None:
        maps.save(self.voxels, path)

    def info(self) -> DataFrame:
        return world.info(self.voxels)

    def positions(self, log_odds: float = 0.0) -> DataFrame:
        return world.positioned(self.voxels.where(world.renderable(log_odds)))

    def sample(self, most: int) -> DataFrame:
        return world.positioned(world.strided(self.voxels.where(world.renderable()), most, world.ORDER))

    def prune(self) -> DataFrame:
        return world.pruned_all(self.voxels)

    def expire(self, now: int, ttl: int = K.TTL) -> World:
        return replace(self, voxels=world.expired(self.voxels, now, ttl))

    def near(self, centre: tuple[float, float, float], radius: float) -> DataFrame:
        return world.near(self.voxels, centre, radius)

    def carve(self, lines: DataFrame, eye: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
        """Samples of rays, as observations without colour."""
        return rays.samples(lines, eye)

    def merged(self, eye: tuple[float, float, float] = (0.0, 0.0, 0.0), planes: list | tuple = ()) -> DataFrame:
        """Cuboids of what is rendered from `eye`: chunks by their level of detail, and super-chunks far away."""
        near = grouped.rendered(self.voxels, eye, planes, subtractive=self.mode == "subtractive")
        return near.unionByName(grouped.rendered_far(self.voxels, eye, planes))
