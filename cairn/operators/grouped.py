"""Iterative and scan-order operators, a group at a time in numpy.

Groups are chunks, frames or sessions, whose size the data model bounds (a chunk
has 32768 leaves).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import constants as K
from cairn.functions import keys
from cairn.operators import rays, world

# --- cuboids ----------------------------------------------------------------


def merge_cuboids(ix: np.ndarray, iy: np.ndarray, iz: np.ndarray, cf: np.ndarray, size: int = K.LEAVES) -> np.ndarray:
    """Cuboids (x, y, z, nx, ny, nz, cf) over a grid: cells inside are dropped in scan order, then boxes grow along x, y and z.

    Colour 0 counts as 1, the last of repeated cells wins, and cells outside the
    grid don't count.  A cell is inside if all six neighbours still stand when
    the scan (x fastest) reaches it, so a solid block keeps a residue.
    """
    grid = np.zeros((size + 2, size + 2, size + 2), np.int64)
    ok = (ix >= 0) & (ix < size) & (iy >= 0) & (iy < size) & (iz >= 0) & (iz < size)
    grid[iz[ok] + 1, iy[ok] + 1, ix[ok] + 1] = np.where(cf[ok] == 0, 1, cf[ok])
    core = grid[1:-1, 1:-1, 1:-1]
    full = grid > 0
    inside = full[1:-1, 1:-1, 1:-1] & full[:-2, 1:-1, 1:-1] & full[2:, 1:-1, 1:-1] & full[1:-1, :-2, 1:-1] & full[1:-1, 2:, 1:-1] & full[1:-1, 1:-1, :-2] & full[1:-1, 1:-1, 2:]
    for z, y, x in zip(*np.nonzero(inside), strict=True):  # row by row, x fastest
        if core[z - 1, y, x] and core[z, y - 1, x] and core[z, y, x - 1]:
            core[z, y, x] = 0
    out, free = [], core > 0
    for z, y, x in zip(*np.nonzero(core), strict=True):
        if not free[z, y, x]:
            continue
        c, nx, ny, nz = core[z, y, x], 1, 1, 1
        same = free & (core == c)
        while x + nx < size and same[z, y, x + nx]:
            nx += 1
        while y + ny < size and same[z, y + ny, x : x + nx].all():
            ny += 1
        while z + nz < size and same[z + nz, y : y + ny, x : x + nx].all():
            nz += 1
        free[z : z + nz, y : y + ny, x : x + nx] = False
        out.append((x, y, z, nx, ny, nz, c))
    return np.array(out, np.int64).reshape(-1, 7)


def cuboids(voxels: DataFrame, *, log_odds: float = 0.4, observations: int = 2, unobserved: bool = False) -> DataFrame:
    """Merged cuboids (cx, cy, cz, mx .. hz, cf) of each chunk's nodes with that much evidence.

    `voxels` holds cf, and depth where its nodes are no leaves (one depth a chunk).
    """
    depth = F.col("depth") if "depth" in voxels.columns else F.lit(K.DEPTH)
    shown = voxels.where(world.renderable(log_odds, observations, unobserved=unobserved)).select("cx", "cy", "cz", "ix", "iy", "iz", "cf", depth.cast("int").alias("depth"))

    def mesh(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["iz", "iy", "ix"], kind="stable")
        size = 1 << int(rows["depth"].iloc[0])
        box = merge_cuboids(*(rows[c].to_numpy(np.int64) for c in ("ix", "iy", "iz", "cf")), size)
        out = {f"c{a}": np.full(len(box), key[i], np.int16) for i, a in enumerate("xyz")}
        out |= {f"m{a}": key[i] + (box[:, i] + box[:, 3 + i] / 2) / size for i, a in enumerate("xyz")}
        out |= {f"h{a}": box[:, 3 + i] / (2 * size) for i, a in enumerate("xyz")}
        return pd.DataFrame(out | {"cf": box[:, 6]})

    return shown.groupBy("cx", "cy", "cz").applyInPandas(mesh, _CUBOIDS)


_CUBOIDS = "cx short, cy short, cz short, mx double, my double, mz double, hx double, hy double, hz double, cf long"


def rendered(voxels: DataFrame, eye: tuple[float, float, float] = (0.0, 0.0, 0.0), planes: list | tuple = (), *, subtractive: bool = False) -> DataFrame:
    """Cuboids of the chunks that `planes` let show, each at the depth that its distance from `eye` asks for.

    Nodes at a coarser depth hold no evidence of their own: they show only where
    what was never observed counts as solid (`subtractive`), grey.
    """
    seen = rays.lod_depth(world.visible(voxels.select("cx", "cy", "cz").distinct(), list(planes)), eye).select("cx", "cy", "cz", "depth")
    near = voxels.join(seen.where(F.col("depth") == K.DEPTH), ["cx", "cy", "cz"])
    cf = keys.pack(*(F.col(c) for c in ("r", "g", "b", "layer", "class_id")))
    fields = ["cx", "cy", "cz", "ix", "iy", "iz", "depth", "log_odds", "obs_count", "cf"]
    shown = near.withColumn("cf", cf).select(*fields)
    if subtractive:
        far = voxels.select("cx", "cy", "cz", "ix", "iy", "iz").join(seen.where(F.col("depth") < K.DEPTH), ["cx", "cy", "cz"])
        up = far.select("cx", "cy", "cz", *(F.expr(f"shiftright(cast(i{a} as int), {K.DEPTH} - depth)").cast("short").alias(f"i{a}") for a in "xyz"), "depth").distinct()
        grey = keys.pack(*(F.lit(K.GREY).cast("long") for _ in "rgb"), F.lit(0), F.lit(0))
        shown = shown.unionByName(up.select("*", F.lit(0.0).cast("float").alias("log_odds"), F.lit(0).alias("obs_count"), grey.alias("cf")).select(*fields))
    return cuboids(shown, unobserved=subtractive)


def rendered_far(voxels: DataFrame, eye: tuple[float, float, float], planes: list | tuple = (), *, nearest: float = 80.0, farthest: float = 500.0) -> DataFrame:
    """Cuboids of super-chunks between the distances: the mesher's grid spans one metre, which a leaf's centre, a metre or more from the corner, is never within, so there are none."""
    fields = ", ".join([*(f"c{a} short" for a in "xyz"), *(f"{n}{a} double" for n in "mh" for a in "xyz"), "cf long"])
    return voxels.sparkSession.createDataFrame([], fields)


# --- scan matching ----------------------------------------------------------

ROUNDS, REACH, PAIRS, SETTLED, INLIERS, SCORE, MOST_POINTS = 15, 0.5, 6, 0.001, 0.3, 0.5, 500


def thinned(points: np.ndarray, most: int = MOST_POINTS) -> np.ndarray:
    """Every n-th point, n = points div `most`: up to almost twice `most`."""
    return points[:: max(1, len(points) // most)] if len(points) > most else points


def rigid(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotation and shift that bring points a nearest to b."""
    ca, cb = a.mean(axis=0), b.mean(axis=0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    r = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1]) @ u.T
    return r, cb - r @ ca


class Cells:
    """Nearest neighbours within a cell's width, by sorted cell keys."""

    def __init__(self, points: np.ndarray, cell: float = REACH):
        self.cell = cell
        key = self._key(np.floor(points / cell).astype(np.int64))
        order = np.lexsort((np.arange(len(points)), key))
        self.key, self.points = key[order], points[order]

    @staticmethod
    def _key(k: np.ndarray) -> np.ndarray:
        return ((k[..., 0] & 0x1FFFFF) << 42) | ((k[..., 1] & 0x1FFFFF) << 21) | (k[..., 2] & 0x1FFFFF)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and position of the nearest point; infinite beyond the cell's width."""
        best, where = np.full(len(q), np.inf), np.zeros(len(q), np.int64)
        own = np.floor(q / self.cell).astype(np.int64)
        for step in np.ndindex(3, 3, 3):
            k = self._key(own + np.array(step) - 1)
            low, high = np.searchsorted(self.key, k, "left"), np.searchsorted(self.key, k, "right")
            for j in range(int((high - low).max(initial=0))):
                at = np.minimum(low + j, max(len(self.key) - 1, 0))
                d = np.where(low + j < high, np.sqrt(((self.points[at] - q) ** 2).sum(axis=1)), np.inf)
                better = d < best
                best[better], where[better] = d[better], at[better]
        return np.where(best < self.cell, best, np.inf), where


def match(frame: np.ndarray, scene: np.ndarray) -> dict | None:
    """The rigid motion that lays a frame on the map by iterated closest points; none without enough agreement."""
    frame = thinned(frame)
    if len(frame) < PAIRS or len(scene) < PAIRS:
        return None
    cells, moved, r_all, t_all = Cells(scene), frame.copy(), np.eye(3), np.zeros(3)
    score, inliers, rounds, settled = np.inf, 0, 0, False
    for rounds in range(1, ROUNDS + 1):
        d, at = cells.nearest(moved)
        ok = np.isfinite(d)
        if ok.sum() < PAIRS:
            break
        score, inliers = d[ok].mean(), int(ok.sum())
        r, t = rigid(moved[ok], cells.points[at[ok]])
        moved, r_all, t_all = moved @ r.T + t, r @ r_all, r @ t_all + t
        if np.linalg.norm(t) < SETTLED:
            settled = True
            break
    if inliers < INLIERS * len(frame) or score >= SCORE:
        return None
    return {"tx": t_all[0], "ty": t_all[1], "tz": t_all[2], "score": float(score), "inliers": inliers, "rounds": rounds, "converged": settled, "rotation": r_all}


def matched(frames: DataFrame, scene: DataFrame) -> DataFrame:
    """Per frame_id: the match of its points with the points of `scene` for that frame; no row without one. Both: frame_id, x, y, z."""

    def work(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        xyz = lambda d: d.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
        got = match(xyz(left), xyz(right)) if len(left) and len(right) else None
        rows = [] if got is None else [(key[0], *(got[k] for k in ("tx", "ty", "tz", "score", "inliers", "rounds", "converged")))]
        return pd.DataFrame(rows, columns=["frame_id", "tx", "ty", "tz", "score", "inliers", "rounds", "converged"])

    own = lambda d: d.select(F.col("frame_id").alias("frame_id"), *(F.col(a).cast("double").alias(a) for a in "xyz")).groupBy("frame_id")  # noqa: E731  two sides of one table need columns of their own
    return own(frames).cogroup(own(scene)).applyInPandas(
        work, "frame_id long, tx double, ty double, tz double, score double, inliers long, rounds long, converged boolean"
    )


# --- two-view motion --------------------------------------------------------

TRIES, NEAR, FEWEST = 200, 0.005, 20


def essential(p: np.ndarray) -> np.ndarray:
    """The essential matrix of point pairs (x1, y1, x2, y2) by eight points or more."""
    x1, y1, x2, y2 = p.T
    a = np.stack([x2 * x1, x2 * y1, x2, y2 * x1, y2 * y1, y2, x1, y1, np.ones(len(p))], axis=1)
    e = np.linalg.eigh(a.T @ a)[1][:, 0].reshape(3, 3)
    u, s, vt = np.linalg.svd(e)
    m = (s[0] + s[1]) / 2
    return u @ np.diag([m, m, 0]) @ vt


def residuals(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distance of the pairs from the epipolar constraint (Sampson)."""
    one = np.ones(len(p))
    a, b = np.stack([p[:, 0], p[:, 1], one]), np.stack([p[:, 2], p[:, 3], one])
    ea, eb = e @ a, e.T @ b
    return np.abs((b * ea).sum(axis=0)) / np.sqrt(np.maximum(ea[0] ** 2 + ea[1] ** 2 + eb[0] ** 2 + eb[1] ** 2, 1e-12))


def motions(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four rotations and directions that an essential matrix allows."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * (np.sign(np.linalg.det(u)) or 1), vt * (np.sign(np.linalg.det(vt)) or 1)
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(r, t) for r in (u @ w @ vt, u @ w.T @ vt) for t in (u[:, 2], -u[:, 2])]


def in_front(r: np.ndarray, t: np.ndarray, p: np.ndarray) -> int:
    """Pairs whose point lies before both cameras."""
    a = np.concatenate([p[:, :2], np.ones((len(p), 1))], axis=1) @ r.T
    b = np.concatenate([p[:, 2:], np.ones((len(p), 1))], axis=1)
    # depth d1 of r a d1 + t ~ b d2, by the cross product with b
    ca, ct = np.cross(b, a), np.cross(b, np.broadcast_to(t, b.shape))
    d1 = -(ca * ct).sum(axis=1) / np.maximum((ca * ca).sum(axis=1), 1e-12)
    return int(((d1 > 0) & (d1 * a[:, 2] + t[2] > 0)).sum())


def motion(p: np.ndarray, seed: int = 0) -> dict | None:
    """Rotation, direction and inliers of a frame's pairs by random eights; the same for the same seed. None for too few."""
    if len(p) < FEWEST:
        return None
    rng, best = np.random.default_rng(seed), np.zeros(len(p), bool)
    for _ in range(TRIES):
        e = essential(p[rng.choice(len(p), 8, replace=False)])
        ok = residuals(e, p) < NEAR
        if ok.sum() > best.sum():
            best = ok
    if best.sum() < 8:
        return None
    e = essential(p[best])
    ok = residuals(e, p) < 2 * NEAR
    votes = [(in_front(r, t, p[ok]), r, t) for r, t in motions(e)] if ok.any() else []
    if not votes or (top := max(votes, key=lambda v: v[0]))[0] <= ok.sum() * 0.25:
        return None
    return {"inliers": int(ok.sum()), "rotation": top[1], "direction": top[2], "votes": top[0]}


def frame_motions(pairs: DataFrame) -> DataFrame:
    """Per frame_id of `pairs` (frame_id, x1, y1, x2, y2): pairs, inliers and the direction of motion."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x2", "y2", "x1", "y1"])
        got = motion(rows[["x1", "y1", "x2", "y2"]].to_numpy(float), seed=int(key[0]))
        out = [] if got is None else [(key[0], len(rows), got["inliers"], *got["direction"])]
        return pd.DataFrame(out, columns=["frame_id", "pairs", "inliers", "tx", "ty", "tz"])

    return pairs.groupBy("frame_id").applyInPandas(work, "frame_id long, pairs long, inliers long, tx double, ty double, tz double")


# --- subtractive updates ----------------------------------------------------


class Node:
    """An octree node of a subtractive map."""

    __slots__ = ("children", "class_id", "colour", "hint", "layer", "log_odds", "mask", "obs", "sdf", "seen")

    def __init__(self, like: Node | None = None):
        self.children, self.hint, self.mask, self.seen, self.sdf = None, 0, 0, 0, np.float32(3.4028235e38)
        self.log_odds, self.obs, self.layer, self.class_id, self.colour = (np.float32(0), 0, 0, 0, (K.GREY,) * 3) if like is None else (like.log_odds, like.obs, like.layer, like.class_id, like.colour)


def update(root: Node, x: float, y: float, z: float, hit: bool, depth: int, *, robot: int = 0, t: int = 0, colour: tuple | None = None) -> Node | None:
    """A subtractive update of the chunk under `root` at a local point in [0, 1): nodes are split only where evidence differs."""
    if not all(0 <= c < 1 for c in (x, y, z)):
        return None
    node, goal = root, min(depth, K.DEPTH)
    for d in range(goal):
        scale = 1 << (d + 1)
        octant = (int(x * scale) & 1) | (int(y * scale) & 1) << 1 | (int(z * scale) & 1) << 2
        if node.children is None:
            conflict = (hit and node.log_odds <= 0) or (not hit and (node.obs == 0 or node.log_odds > 0))
            if node.obs == 0 or conflict or d < goal - 1:
                if conflict:
                    node.hint |= 1 << octant
                node.children = {}
            else:
                break
        if octant not in node.children:
            node.children[octant] = Node(node)
        node = node.children[octant]
    node.log_odds = np.float32(min(np.float32(K.HIGH), max(np.float32(K.LOW), node.log_odds + np.float32(K.HIT if hit else K.MISS))))
    node.obs, node.seen, node.mask = min(K.MOST_OBSERVATIONS, node.obs + 1), t, node.mask | (1 << robot if 0 <= robot < 64 else 0)
    node.sdf = np.float32(0 if hit else -1)
    if hit and colour is not None:
        node.colour = colour
    return node


def leaves(node: Node, depth: int = 0, at: tuple[int, int, int] = (0, 0, 0)) -> Iterator[tuple[int, int, int, int, Node]]:
    """(depth, ix, iy, iz, leaf), children in octant order."""
    if node.children is None:
        yield depth, *at, node
        return
    for o in sorted(node.children):
        yield from leaves(node.children[o], depth + 1, (at[0] * 2 + (o & 1), at[1] * 2 + (o >> 1 & 1), at[2] * 2 + (o >> 2)))


def subtractive(samples: DataFrame) -> DataFrame:
    """Leaves of each chunk after `samples` (cx, cy, cz, seq, lx, ly, lz local, hit, depth), in order of seq."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        root = Node()
        for s in rows.sort_values("seq").itertuples(index=False):
            update(root, s.lx, s.ly, s.lz, s.hit, s.depth, t=s.seq)
        out = [(*key, d, x, y, z, float(n.log_odds), n.obs, float(n.sdf), n.hint) for d, x, y, z, n in leaves(root) if n.obs]
        return pd.DataFrame(out, columns=["cx", "cy", "cz", "depth", "ix", "iy", "iz", "log_odds", "obs_count", "signed_distance", "hint"])

    return samples.groupBy("cx", "cy", "cz").applyInPandas(work, "cx short, cy short, cz short, depth int, ix int, iy int, iz int, log_odds float, obs_count int, signed_distance float, hint int")
