"""A Merkle manifest of a table: a tree over each group's rows, a tree over the groups' roots, and every leaf's authentication path.

A node is the SHA-256, in lowercase hex, of its children's hex digests, of
ARITY consecutive nodes (the last run of a level: fewer, even one), level by
level while several nodes remain.

No tree is brought together in a task.  Leaves are hashed where the rows lie,
numbered within their group by ranges, and dealt into aligned blocks of
ARITY ** LEVELS.  A block's root is a leaf one table up, until each group has
one node; these roots are leaves of the tree over groups in the same way.
Paths come down again: a traversal of each block hands every leaf its
siblings, and the path that all leaves of the block share is appended.

The traversal emits paths in order of leaves.  For each level it holds the run
of siblings around the current leaf and a treehash stack that makes the next
run of that level from the leaves ahead, one leaf a step, so that a run is
ready when the traversal enters it: work per leaf is a few steps, memory ARITY
nodes a level and stack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import checkpointed, small

#: Children of a node, and levels of a block of leaves that one task walks.
ARITY, LEVELS = 16, 3
BLOCK = ARITY**LEVELS
#: Characters of a digest in hex.
HEX = 64
#: A row's group: false for null, which sorts first, and its name.
GROUP = ("given", "grp")


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above `n` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Treehash:
    """A stack of unfinished runs, a list for each level up to `top`, whose nodes are kept."""

    def __init__(self, top: int):
        self.runs: list[list[bytes]] = [[] for _ in range(top + 1)]

    def push(self, node: bytes) -> None:
        runs, level = self.runs, 0
        while level < len(runs) - 1:
            runs[level].append(node)
            if len(runs[level]) < ARITY:
                return
            node, runs[level] = digest(*runs[level]), []
            level += 1
        runs[level].append(node)

    def close(self) -> list[bytes]:
        """The nodes of the top level, those below that are unfinished becoming short runs."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                node, self.runs[level] = digest(*self.runs[level]), []
                self.runs[level + 1].append(node)
        return self.runs[-1]


def root_of(leaves: Sequence[bytes], levels: int) -> bytes:
    """The node `levels` above leaves that it spans."""
    stack = Treehash(levels)
    for leaf in leaves:
        stack.push(leaf)
    return stack.close()[0]


def traversal(leaves: Sequence[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each of the leaves under one node `levels` above, in order: its siblings left and right of it, level by level."""
    n, spans = len(leaves), [ARITY ** (h + 1) for h in range(levels)]
    runs, ahead, sides = [], [], [(b"", b"")] * levels
    for h, span in enumerate(spans):
        first = Treehash(h)
        for leaf in leaves[:span]:
            first.push(leaf)
        runs.append(b"".join(first.close()))
        ahead.append(Treehash(h))
    for i in range(n):
        for h, span in enumerate(spans):
            below = span // ARITY
            if i % below:
                break  # the node above is the one of the leaf before, and so are those above it
            if i and not i % span:
                runs[h], ahead[h] = b"".join(ahead[h].close()), Treehash(h)
            at = i // below % ARITY * HEX
            sides[h] = (runs[h][:at], runs[h][at + HEX :])
        for h, span in enumerate(spans):
            if i + span < n:
                ahead[h].push(leaves[i + span])
        yield list(sides)


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of the columns' values: `-` for null, else the length of its text in UTF-8 bytes, a colon and the text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with pos, a row's place within its group by `order` (nulls first), and n, the group's rows.

    Rows are dealt by ranges of group and order, so a group of any size lies in
    many tasks; only counts a range and group are added up.
    """
    spark, keys = df.sparkSession, [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    placed = checkpointed(dealt.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = placed.groupBy("range", *group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    each = Window.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(each.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("range", *group, (before - F.col("first")).alias("shift"), F.sum("rows").over(each).alias("n"))
    return placed.join(small(checkpointed(starts)), ["range", *group]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def _inside(n: int) -> int:
    """Levels of a block in a group of `n` nodes."""
    return LEVELS if n > BLOCK else height(n)


def _column(t: pa.Table, name: str) -> list[bytes]:
    return t.column(name).cast(pa.binary()).to_pylist()


def _block_root(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("pos")
    n = t.column("n")[0].as_py()
    node = root_of(_column(t, "node"), _inside(n)).decode()
    return pa.table({"given": t.column("given").slice(0, 1), "grp": t.column("grp").slice(0, 1), "pos": [t.column("pos")[0].as_py() // BLOCK], "n": [-(-n // BLOCK)], "node": [node]}, schema=_NODES)


_NODES = pa.schema([("given", pa.bool_()), ("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
_NODE_COLUMNS = "given boolean, grp string, pos long, n long, node string"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH_COLUMN = "path array<struct<left: string, right: string>>"


def _blocks(level: DataFrame) -> DataFrame:
    return level.withColumn("block", F.floor(F.col("pos") / BLOCK))


def lifted(level: DataFrame) -> DataFrame:
    """The blocks' roots of a table of nodes, as a table of nodes."""
    return checkpointed(_blocks(level).groupBy(*GROUP, "block").applyInArrow(_block_root, _NODE_COLUMNS))


def forest(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes (given, grp, pos, n, node): the leaves, roots of their blocks, and so on to one node a group."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while True:
        levels.append(lifted(levels[-1].select(*GROUP, "pos", "n", "node")))
        if most <= BLOCK:
            return levels
        most = -(-most // BLOCK)


def _paths(key: tuple, t: pa.Table, upper: pa.Table) -> pa.Table:
    t = t.sort_by("pos")
    shared = upper.column("path")[0].as_py()
    found = [[{"left": a.decode(), "right": b.decode()} for a, b in sides] + shared for sides in traversal(_column(t, "node"), _inside(t.column("n")[0].as_py()))]
    return t.select(["given", "grp", "pos"]).append_column("path", pa.array(found, _PATH))


def _cogrouped(level: DataFrame, uppers: DataFrame, work, columns: str) -> DataFrame:
    """work(block's nodes, its shared path) for every block of `level`; `uppers` (given, grp, pos, path, ...) has a row for each."""
    files = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _blocks(level).repartition(files, *GROUP, "block").groupBy(*GROUP, "block")
    return left.cogroup(uppers.withColumnRenamed("pos", "block").groupBy(*GROUP, "block")).applyInArrow(work, columns)


def descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The shared path of every block of leaves of `levels`, from those of the groups' roots, `tops`."""
    uppers = tops
    for level in reversed(levels[1:-1]):
        uppers = checkpointed(_cogrouped(level.select(*GROUP, "pos", "n", "node"), uppers, _paths, f"given boolean, grp string, pos long, {_PATH_COLUMN}"))
    return uppers


@dataclass(frozen=True)
class Manifest:
    """leaves: a row each, with doc_id, group (given, grp), pos, n, node and what was carried along; uppers: shared paths of the leaves' blocks; subroots: a node each group."""

    leaves: DataFrame
    uppers: DataFrame
    subroots: DataFrame
    root: str


def manifest(df: DataFrame, doc_id: str, group: str, columns: Sequence[str], carried: dict[str, Column] | None = None) -> Manifest:
    """The trees over `df`: leaves are digests of `columns`, by `group` in order of `doc_id`.

    Null groups are a group of their own, first in order; null ids come first
    within a group, and rows with equal ids are ordered by digest, so that
    repeated rows are leaves of their own and reruns agree.  Other columns,
    whatever their names, play no part.  `carried`: more columns (of `df`) that
    go with each leaf.  An empty table has no leaf and the empty text as root.
    """
    g = F.col(group)
    hashed = df.select(F.col(doc_id).alias("doc_id"), g.isNotNull().alias("given"), F.coalesce(g.cast("string"), F.lit("")).alias("grp"), leaf([F.col(c) for c in columns]).alias("node"), *(c.alias(n) for n, c in (carried or {}).items()))
    levels = forest(numbered(checkpointed(hashed), GROUP, ["doc_id", "node"]))
    subroots = levels[-1].select(*GROUP, "node")
    one = subroots.select(F.lit(True).alias("given"), F.lit("").alias("grp"), F.col("given").alias("is_given"), F.col("grp").alias("name"), "node")
    everything = numbered(one, GROUP, ["is_given", "name"])  # all groups' roots as one group
    above = forest(everything)
    last = above[-1].select("node").first()
    nothing = above[-1].select(*GROUP, "pos", F.array().cast(_PATH_COLUMN.split(" ", 1)[1]).alias("path"))
    paths = _cogrouped(everything.select(*GROUP, "pos", "n", "node"), descended(above, nothing), _paths, f"given boolean, grp string, pos long, {_PATH_COLUMN}")
    named = everything.select("pos", F.col("is_given").alias("given"), F.col("name").alias("grp"))
    tops = checkpointed(named.join(paths.select("pos", "path"), "pos").select(*GROUP, F.lit(0).cast("long").alias("pos"), "path"))
    return Manifest(levels[0], descended(levels, tops), subroots, last["node"] if last else "")


def proofs(made: Manifest) -> DataFrame:
    """(given, grp, pos, path): the whole authentication path of every leaf, from its siblings up to the root's children."""
    return _cogrouped(made.leaves.select(*GROUP, "pos", "n", "node"), made.uppers, _paths, f"given boolean, grp string, pos long, {_PATH_COLUMN}")


def folded(made: Manifest, claimed: str) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    proof_sha256 is the digest of all siblings, level by level, left to right;
    folded_root is recomputed from the digest in the carried column `claimed`
    (null: the leaf) and the original siblings, and verified tells whether it
    equals the root.  Paths stay within the task.
    """
    kind, root = dict(made.leaves.dtypes)["doc_id"], made.root

    def work(key: tuple, t: pa.Table, upper: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        nodes, subroot = _column(t, "node"), upper.column("subroot")[0].as_py()
        shared = [(p["left"].encode(), p["right"].encode()) for p in upper.column("path")[0].as_py()]
        tail = b"".join(a + b for a, b in shared)
        proof, ends = [], []
        start = _column(t.append_column("start", pc.coalesce(t.column(claimed), t.column("node"))), "start")
        for x, sides in zip(start, traversal(nodes, _inside(t.column("n")[0].as_py())), strict=True):
            proof.append(digest(*(side for pair in sides for side in pair), tail).decode())
            for a, b in (*sides, *shared):
                x = digest(a, x, b)
            ends.append(x.decode())
        same = [t.column("doc_id"), t.column("node"), pa.array([subroot] * len(t), pa.string()), pa.array([root] * len(t), pa.string())]
        return pa.table([*same, pa.array(proof, pa.string()), pa.array(ends, pa.string()), pa.array([x == root for x in ends], pa.bool_())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    uppers = made.uppers.join(small(made.subroots.withColumnRenamed("node", "subroot")), list(GROUP))
    columns = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _cogrouped(made.leaves.select("doc_id", *GROUP, "pos", "n", "node", claimed), uppers, work, columns)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def lowered(text: str) -> Column:
    """`text` with A to Z in lower case, nothing else."""
    return F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def oracle(levels: int = 6) -> str:
    """The same columns in another engine's SQL, for up to ARITY ** levels rows a source and as many sources; level by level, with nodes' siblings as strings."""
    crc = "list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8), CAST(4294967295 AS BIGINT))"
    field = " || ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in COLUMNS)
    own = {c: c for c in COLUMNS}
    lower = own | {"text": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}
    steps, chain, last = [], [], "leaves"
    for tree, key, equal, at in (("s", "source, ", "x.source IS NOT DISTINCT FROM y.source AND ", "pos"), ("r", "", "", "gpos")):
        for k in range(levels):
            of, run = f"{tree}{k}", f"pos // {ARITY}"
            # runs of level k; where a group has one node left, it stays
            steps.append(f"{tree}{k + 1} AS MATERIALIZED (SELECT {key}{run} AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node, (max(n) + {ARITY - 1}) // {ARITY} AS n FROM {of} GROUP BY {key}{run})")
            sides = ", ".join(f"coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos {sign} x.pos), '') AS {name}" for sign, name in (("<", "l"), (">", "r")))
            steps.append(f"p{of} AS MATERIALIZED (SELECT {'x.source, ' if key else ''}x.pos, x.n, {sides} FROM {of} x JOIN {of} y ON {equal}x.{run} = y.{run} WHERE x.n > 1 GROUP BY ALL)")
            same = f"p.pos = d.{at} // {ARITY**k}" + (" AND p.source IS NOT DISTINCT FROM d.source" if key else "")
            chain.append(f"f{of} AS (SELECT d.* EXCLUDE (x, proof), CASE WHEN p.n > 1 THEN sha256(p.l || d.x || p.r) ELSE d.x END AS x, d.proof || coalesce(p.l || p.r, '') AS proof FROM {last} d LEFT JOIN p{of} p ON {same})")
            last = f"f{of}"
        if key:
            steps.append(f"r0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, node, count(*) OVER () AS n, source FROM s{levels})")
    return f"""
WITH crc AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
hashed AS MATERIALIZED (
  SELECT doc_id, source, sha256({field.format(**own)}) AS node,
         CASE WHEN doc_id IS NOT NULL AND xor({crc}, CAST(4294967295 AS BIGINT)) % 5 = 0 THEN sha256({field.format(**lower)}) END AS claimed
  FROM documents, crc),
s0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed),
{", ".join(steps)},
leaves AS (SELECT d.doc_id, d.source, d.pos, g.pos AS gpos, d.node AS leaf, g.node AS subroot, coalesce(d.claimed, d.node) AS x, '' AS proof FROM s0 d JOIN r0 g ON d.source IS NOT DISTINCT FROM g.source),
{", ".join(chain)}
SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.node AS verified FROM {last}, r{levels} r
"""
