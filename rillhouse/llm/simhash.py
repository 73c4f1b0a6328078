"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

A fingerprint has bit b set if more than half of the text's word shingles have it set in their
XXH64. Two fingerprints at distance 4 or less have a common point within distance 2 of both, so
every fingerprint emits all 2081 points of its ball of radius 2, the points are shuffled, and
fingerprints that meet are linked. Any two that meet lie within 2 + 2 bits, so a star to the
smallest of a meeting point loses no link and no group is expanded into pairs.

Emitting 2081 points for each fingerprint of a corpus would move many times the corpus. Most
fingerprints have no neighbour at all, and an exact test shows it first: cut the 64 bits in three
blocks; of four differing bits some two blocks hold at most two, so two linked fingerprints meet
within one bit of each other's middle on one of the three block pairs (132 keys each). Only
fingerprints that meet another there emit their ball. The test never loses a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, ship, spread_join

RADIUS = 4
SHINGLE = 4
SEED = 42
_ROWS = 1 << 14  # shingles whose bits are counted at a time


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text; without words it is 0."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _ROWS):
        part = np.array(hashes[at : at + _ROWS], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """`docs` with a bigint fingerprint column. Null and empty texts get 0. Where `docs` has a column
    named `out`, the new one gets underscores before its name; it comes last."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def compute(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([simhash(t) for t in part], dtype="int64")

    return docs.withColumn(free_name(docs, out), compute(F.col(text)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(radius: int) -> list[int]:
    """XOR masks of all points within `radius` bits, as signed 64-bit values."""
    return [_signed(sum(1 << b for b in bits)) for r in range(radius + 1) for bits in combinations(range(64), r)]


def projections() -> list[tuple[int, int, int]]:
    """(flip, mask, tag) of the keys on pairs of the three blocks. The tag keeps the three kinds
    of key apart in the masked-out bits; a chance clash only lets one more fingerprint through."""
    blocks, out = [range(0, 21), range(21, 42), range(42, 64)], []
    for left in range(3):
        kept = [b for k, block in enumerate(blocks) if k != left for b in block]
        mask, tag = sum(1 << b for b in kept), (left + 1) << blocks[left][0]
        out += [(_signed(flip), _signed(mask), _signed(tag)) for flip in [0, *(1 << b for b in kept)]]
    return out


def neighbour_candidates(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (`fp`) that meet another one on some pair of blocks."""
    keys = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(m).alias("m"), F.lit(t).alias("t")) for f, m, t in projections()])
    key = F.transform(keys, lambda k: F.col("fp").bitwiseXOR(k["f"]).bitwiseAND(k["m"]).bitwiseOR(k["t"]))
    # one shuffle: each key's rows are sorted together, and a large group spills instead of being held
    cell = Window.partitionBy("key")
    met = fps.select("fp", F.explode(key).alias("key")).select("fp", F.min("fp").over(cell).alias("lo"), F.max("fp").over(cell).alias("hi"))
    return met.where("lo < hi").select("fp").distinct()


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (`fp` > `hub`) whose connected components are those of all pairs of distinct
    fingerprints within `radius` bits (4 at most). `fps`: distinct bigints in `fp`.

    Two fingerprints within `radius` have a point within half of it, rounded down, of one and half
    of it, rounded up, of the other. A point's hub is the least fingerprint within the lesser half,
    so all that have the point in their balls are within `radius` of the hub."""
    if radius > RADIUS:
        raise ValueError("the block test holds for 4 bits at most")
    near = materialize(neighbour_candidates(fps), "simhash-near")
    points = F.transform(F.lit(np.array(ball((radius + 1) // 2), dtype=np.int64)), lambda x: F.col("fp").bitwiseXOR(x))
    met = near.repartition("fp").select("fp", F.explode(points).alias("point"))
    # at most 2081 distinct fingerprints have a point in their balls, so no window is large
    inner = F.col("fp") if radius % 2 == 0 else F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("point"))) <= radius // 2, F.col("fp"))
    pairs = met.withColumn("hub", F.min(inner).over(Window.partitionBy("point"))).where("fp <> hub")
    pairs = pairs.select(F.greatest("fp", "hub").alias("fp"), F.least("fp", "hub").alias("hub")).distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (two bigint columns): (node, root), root the smallest node
    reachable. Alternates large-star and small-star steps until no edge changes. A node of many
    edges is joined with its least neighbour by a broadcast, see `spread_join`."""
    a, b = edges.columns
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # only edges to larger nodes are joined, so only these count
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        low = materialize(low.select("u", F.least("u", "m").alias("m"), "n"), "cc")
        large = spread_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc")
        small = spread_join(large, low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialize(small, "cc")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def classes(fps: DataFrame, doc_id: str, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id, n) for each distinct fingerprint: its component's smallest
    fingerprint, the smallest non-null `doc_id` of all rows whose fingerprints can be reached over
    links (null if there is none), and its number of rows."""
    nodes = materialize(fps.groupBy("fp").agg(F.min(doc_id).alias("rep"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = materialize(nodes.join(roots, "fp", "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root")), "simhash-named")
    least = materialize(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "simhash-least")
    return materialize(spread_join(named, least, "root", "members").select("fp", "root", "component_id", "n"), "simhash-classes")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of `docs`: doc_id, fp (bigint), component_id.

    Null or blank texts have fingerprint 0 and are linked like any other; texts of any length are
    taken whole; rows with equal ids each get their row; a null id names no component but its row
    still links; no rows give none; no other column is looked at, whatever its name."""
    fps = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "simhash-fp")
    return spread_join(fps, classes(fps, "doc_id", radius), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """`docs` with one row of each component: the smallest id (nulls last), of repeated rows one. No
    rows give none; all columns stay, whatever their names."""
    fp, row = free_name(docs, "fp"), free_name(docs, "row")
    held = materialize(fingerprints(docs, text, fp).withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    slim = held.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    named = spread_join(slim, classes(slim, "doc_id", radius), "fp")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("best"))
    kept = best.select(F.col("best.row").alias(row))
    return held.join(kept, row, "left_semi").select(*docs.columns)
