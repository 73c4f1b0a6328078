"""Merkle dataset manifest with incremental witnesses.

Each row is a leaf. Leaves of a group stand in order; every eight consecutive nodes make a node of
the next level until one remains, the group's subroot; subroots make the root in the same way. A
witness of a leaf lists, level by level, the nodes to its left and right in its run: with it the
root can be recomputed from the leaf alone.

Trees are built by appending. Where a node is appended it opens a partial witness with what stands
to its left; each later sibling that is completed extends the witnesses of all leaves below the
nodes before it. The work is cut in aligned blocks of 8^4 leaves: a task appends the leaves of a
block, and the block's root is itself a leaf that is appended, with the other block roots of its
group, one storey higher, until one node is left. Witnesses then go down the storeys again: a
block's own witness ends those of its leaves.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, ship

ARITY = 8
#: Levels of a block: it has 8^4 leaves.
LEVELS = 4

#: One level of a witness: the digests to the left and to the right, as text.
Step = tuple[str, str]
_PATH = "array<struct<l: string, r: string>>"


def digest(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Appender:
    """A tree that grows by appends. `open` has, for each level, the run that is not full yet: its
    nodes, and the witnesses of the leaves below each. A witness is a list of levels; a level is a
    list of the text to the left and of the digests to the right, which later siblings extend."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[str, list, list]]] = []
        self.count: list[int] = []  # nodes that each level has had

    def append(self, leaf: str) -> list:
        """Add a leaf; returns its witness, which grows with later appends."""
        witness: list = []
        self._put(0, leaf, [witness])
        return witness

    def _put(self, level: int, node: str, below: list) -> None:
        if level == len(self.open):
            self.open.append([])
            self.count.append(0)
        run = self.open[level]
        self.count[level] += 1
        for _, _, step in run:
            step[1].append(node)
        own = ["".join(n for n, _, _ in run), []]
        for witness in below:
            witness.append(own)
        run.append((node, below, own))
        if len(run) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._put(level + 1, digest(n for n, _, _ in run), [w for _, below, _ in run for w in below])

    def finish(self, height: int = 0) -> str:
        """Close the runs that are not full, up to `height` levels at least and until one node
        remains; returns it. Witnesses end below it."""
        level = 0
        while level < height or self.count[level] > 1:
            if self.open[level]:
                self._close(level)
            level += 1
        node, below, _ = self.open[level][0]
        for witness in below:
            witness.pop()
        return node


def tree(leaves: list[str], height: int = 0) -> tuple[str, list[list[Step]]]:
    """The root of some leaves (at least one), and the witness of each."""
    grown = Appender()
    witnesses = [grown.append(x) for x in leaves]
    root = grown.finish(height)
    return root, [[(left, "".join(right)) for left, right in w] for w in witnesses]


def fold(leaf: str, path: list[Step]) -> str:
    """The root that a leaf and its witness give."""
    for left, right in path:
        leaf = digest((left, leaf, right))
    return leaf


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with `rank` (from 0) and `total` in their group, by `order`. Rows are sorted by ranges
    of group and order, so that a group of any size is spread over partitions, and counted there."""
    spread = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    held = materialize(spread.withColumn("seq", F.monotonically_increasing_id()), "manifest-sorted").withColumn("part", F.shiftright("seq", 33))
    parts = held.groupBy(group, "part").agg(F.min("seq").alias("least"), F.count("*").alias("n"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "part", "least", before.alias("before"), F.sum("n").over(own).alias("total"))
    return held.join(parts, [group, "part"]).withColumn("rank", F.col("seq") - F.col("least") + F.col("before")).drop("seq", "part", "least", "before")


def _height(total: int, levels: int) -> int:
    return levels if total > ARITY**levels else 0


def _block(levels: int) -> Column:
    return F.floor(F.col("rank") / ARITY**levels).cast("long").alias("block")


def storeys(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The storeys of the trees over nodes (grp, rank, total, node), the lowest first, and the trees'
    roots (grp, node). Each storey holds the block roots of the one below; there are as many as the
    largest group takes."""

    def roots(own: pd.DataFrame) -> pd.DataFrame:
        total = int(own["total"].iloc[0])
        node, _ = tree(own.sort_values("rank")["node"].tolist(), _height(total, levels))
        return pd.DataFrame({"grp": [own["grp"].iloc[0]], "rank": [own["block"].iloc[0]], "total": [-(-total // ARITY**levels)], "node": [node]})

    out = [nodes]
    while True:
        now = out[-1].select("grp", "rank", "total", "node", _block(levels)).groupBy("grp", "block").applyInPandas(roots, "grp string, rank long, total long, node string")
        now = materialize(now, "manifest-roots")
        if (now.agg(F.max("total")).first()[0] or 1) <= 1:
            return out, now.select("grp", "node")
        out.append(now)


def _steps(path: list) -> list[Step]:
    return [(s["l"], s["r"]) for s in path]


def descend(nodes: DataFrame, above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Witnesses (grp, rank, path, subroot, root) of a storey's nodes, from those of the storey above."""

    def run(own: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        own, top = own.sort_values("rank"), up.iloc[0]
        _, paths = tree(own["node"].tolist(), _height(int(own["total"].iloc[0]), levels))
        ended = [{"l": s["l"], "r": s["r"]} for s in top["path"]]
        made = pd.DataFrame({"grp": own["grp"], "rank": own["rank"], "subroot": top["subroot"], "root": top["root"]})
        made["path"] = [[{"l": left, "r": right} for left, right in p] + ended for p in paths]
        return made[["grp", "rank", "path", "subroot", "root"]]

    up = above.withColumnRenamed("rank", "block").groupBy("grp", "block")
    return nodes.select("grp", "rank", "total", "node", _block(levels)).groupBy("grp", "block").cogroup(up).applyInPandas(run, f"grp string, rank long, path {_PATH}, subroot string, root string")


def build(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The storeys over leaves (grp, rank, total, node), and the witnesses (grp, rank 0, path,
    subroot, root) of the groups' subroots in the tree over groups, ordered by grp."""
    floors, subroots = storeys(nodes, levels)
    top = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "node"), "grp", "own")
    above, root = storeys(top, levels)
    ends = root.select("grp", F.lit(0).cast("long").alias("rank"), F.array().cast(_PATH).alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    for storey in reversed(above):
        ends = materialize(descend(storey, ends, levels), "manifest-paths")
    named = ends.join(top.select("rank", "own", "node"), "rank")
    return floors, named.select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("rank"), "path", F.col("node").alias("subroot"), "root")


def field(value: Column) -> Column:
    """A value in a leaf: `-` if null, else its length in bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """For each document: its leaf, its language's subroot, the root, the hash of its witness, the
    root recomputed from a copy of the document by that witness, and whether that is the root. The
    copies of documents whose crc32 of the id is divisible by 3 are tampered with: their texts are
    in lower case.

    Nulls are leaves like any other (a null language is a group of its own, the first one; null ids
    come first and are not tampered with); empty texts have length 0; texts of any length are hashed
    whole before anything is shuffled; repeated ids go by their leaves and each have a row; no rows
    give none; other columns are not looked at, whatever their names."""
    ship(docs.sparkSession)
    c = F.col
    values = lambda text: (c("doc_id"), c("source"), c("lang"), c("n_chars"), text)
    tampered = F.when(F.crc32(c("doc_id").cast("string")) % 3 == 0, leaf(*values(lowered(c("text")))))
    # in order of UTF-8 bytes, null before all else
    group = F.when(c("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), c("lang"))).alias("grp")
    slim = docs.select(group, c("doc_id").cast("long").alias("doc_id"), leaf(*values(c("text"))).alias("node"), tampered.alias("tampered"))
    leaves = materialize(ranked(slim, "grp", "doc_id", "node"), "manifest-leaves")
    floors, ends = build(leaves, levels)
    for storey in reversed(floors[1:]):
        ends = materialize(descend(storey, ends, levels), "manifest-paths")

    def run(own: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        own, top = own.sort_values("rank"), up.iloc[0]
        _, paths = tree(own["node"].tolist(), _height(int(own["total"].iloc[0]), levels))
        ended = _steps(top["path"])
        proofs, folded = [], []
        for node, copy, path in zip(own["node"], own["tampered"], paths, strict=True):
            path = path + ended
            proofs.append(digest(part for step in path for part in step))
            folded.append(fold(copy if isinstance(copy, str) else node, path))
        made = pd.DataFrame({"leaf": own["node"].tolist(), "subroot": top["subroot"], "root": top["root"], "proof_sha256": proofs, "folded_root": folded})
        # ids come as text: a column with nulls reaches pandas as doubles
        made.insert(0, "doc_id", pd.array([None if d is None else int(d) for d in own["doc_id"]], dtype="Int64"))
        return made.assign(verified=made["folded_root"] == made["root"])

    rows = leaves.select("grp", "rank", "total", "node", "tampered", c("doc_id").cast("string").alias("doc_id"), _block(levels))
    return rows.groupBy("grp", "block").cogroup(ends.withColumnRenamed("rank", "block").groupBy("grp", "block")).applyInPandas(run, _OUT)
