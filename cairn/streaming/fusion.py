"""Pose fusion of visual odometry, orientation and encoder samples: a state and its updates."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from cairn import constants as K
from cairn.operators.sequence import ENOUGH, HIGH, KEPT, LOW, TINY

STATES = ("uninitialized", "initializing", "tracking")


def slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The rotation a share t of the shorter way from a to b; unit quaternions (x, y, z, w)."""
    d = float(a @ b)
    if d < 0:
        b, d = -b, -d
    if d > 0.9995:
        q = a + t * (b - a)
    else:
        angle = np.arccos(min(1.0, d))
        q = (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)
    return q / np.linalg.norm(q)


@dataclass
class Fusion:
    """The fused pose of a device and what its next update needs."""

    device: str = "robot"
    state: int = 0
    position: np.ndarray = field(default_factory=lambda: np.zeros(3))
    rotation: np.ndarray = field(default_factory=lambda: np.array([0.0, 0, 0, 1]))
    visual: np.ndarray = field(default_factory=lambda: np.zeros(3))
    encoder: tuple | None = None
    before: np.ndarray = field(default_factory=lambda: np.zeros(3))
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(3))
    ratios: list[float] = field(default_factory=list)
    scale: float = 1.0
    quality: float = 0.0

    @property
    def trust(self) -> tuple[float, float, float, float]:
        """Trust in orientation, encoder, visual odometry at most, scan matching."""
        return K.DEVICES[self.device][7:]

    def add_ratio(self, known: float, seen: float) -> None:
        if seen <= TINY:
            return
        ratio = known / seen
        if self.ratios and not LOW * self.scale <= ratio <= HIGH * self.scale:
            return
        self.ratios = [*self.ratios, ratio][-KEPT:]
        self.scale = sorted(self.ratios)[len(self.ratios) // 2]

    def feed_video(self, position: np.ndarray, rotation: np.ndarray) -> None:
        """A pose of visual odometry."""
        moved = float(np.linalg.norm(position - self.visual))
        if self.encoder is not None and moved > TINY:
            driven = float(np.linalg.norm(self.encoder[1] - self.before))
            if driven > TINY:
                self.add_ratio(driven, moved)
        self.quality, self.visual = min(1.0, 10 * moved), position
        imu, _, most, _ = self.trust
        w = min(most, self.quality / 2)
        if w > 0.01:
            self.position = self.position * (1 - w) + position * self.scale * w
            turn = (1 - imu) * w / most
            if turn > 0.01:
                self.rotation = slerp(self.rotation, rotation, turn)
        if self.state == 0:
            self.state = 1
        if self.state == 1 and len(self.ratios) >= ENOUGH:
            self.state = 2

    def feed_imu(self, rotation: np.ndarray) -> None:
        """An orientation: the first sets it, later ones pull it by their trust."""
        if self.state == 0:
            self.rotation, self.state = rotation, 1
        else:
            self.rotation = slerp(self.rotation, rotation, self.trust[0])

    def feed_encoder(self, t: float, position: np.ndarray, velocity: np.ndarray) -> None:
        """A driven position: blended with dead reckoning, then into the pose by its trust."""
        trust = self.trust[1]
        if self.state == 0:
            self.position, self.before, self.velocity, self.state = position, position, velocity, 1
        elif trust > 0:
            if self.encoder is not None and 0 < (dt := t - self.encoder[0]) < 0.5:
                alpha = float(np.exp(-dt / 0.15))
                blend = (1 - alpha) * position + alpha * (self.before + self.velocity * dt)
                self.position = self.position * (1 - trust) + blend * trust
            self.before, self.velocity = position, velocity
        self.encoder = (t, position)

    def feed_match(self, position: np.ndarray, rotation: np.ndarray, score: float) -> None:
        """A scan match: the better its score, the stronger its pull."""
        alpha = self.trust[3] * max(0.0, 1 - 2 * score)
        if alpha > 0.01:
            self.position = self.position * (1 - alpha) + position * alpha
            self.rotation = slerp(self.rotation, rotation, alpha)

    def feed(self, kind: str, t: float, p: np.ndarray, q: np.ndarray, v: np.ndarray, score: float = 0.0) -> None:
        """A sample of any kind; scans themselves change nothing until they are matched."""
        if kind == "video":
            self.feed_video(p, q)
        elif kind == "imu":
            self.feed_imu(q)
        elif kind == "encoder":
            self.feed_encoder(t, p, v)
        elif kind == "match":
            self.feed_match(p, q, score)
