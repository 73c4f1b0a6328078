"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut in clauses, clauses make paragraphs (lines), paragraphs make sections, and sections
make the document. A leaf is the hash of a clause's bytes; each node above hashes its children's
hashes. Equal roots mean equal texts; where roots differ, a walk down the differing branches
finds the edits. All cuts depend on the text next to them alone (punctuation, line ends, certain
last letters of words; a section ends at a blank line or after a paragraph whose hash is divisible
by 4), so that an edit leaves the other branches as they were.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, partitions, ship

#: A clause ends after a line end, after sentence punctuation, or at the space after a word whose
#: last letter's code is 4 modulo 16.
_clauses = re.compile(r"[^\n.!?]*?(?:\n|[.!?]+ ?|[dtDT4$] )|[^\n.!?]+\Z").findall
_NEXT, _GUARD = 0, 1


@dataclass
class Node:
    digest: bytes
    start: int  # code points
    end: int
    children: tuple[Node, ...] = ()


def _join(parts: list[Node], start: int) -> Node:
    return Node(blake2b(b"".join(p.digest for p in parts), digest_size=16).digest(), parts[0].start if parts else start, parts[-1].end if parts else start, tuple(parts))


def tree(text: str | None) -> Node:
    """The Merkle tree of a text: document, sections, paragraphs, clauses. Null counts as empty."""
    sections: list[Node] = []
    paragraphs: list[Node] = []
    leaves: list[Node] = []
    at = 0

    def close_section() -> None:
        if paragraphs:
            sections.append(_join(paragraphs, at))
            paragraphs.clear()

    def close_paragraph() -> None:
        if leaves:
            p = _join(leaves, at)
            blank = p.end - p.start == 1
            leaves.clear()
            paragraphs.append(p)
            if blank or not p.digest[0] & 3:
                close_section()

    for clause in _clauses(text or ""):
        leaves.append(Node(blake2b(clause.encode("utf-8", "surrogatepass"), digest_size=16).digest(), at, at + len(clause)))
        at += len(clause)
        if clause[-1] == "\n":
            close_paragraph()
    close_paragraph()
    close_section()
    return _join(sections, 0)


def leaves(node: Node) -> Counter:
    """Code points under each distinct clause hash of a document tree."""
    found: Counter = Counter()
    for section in node.children:
        for paragraph in section.children:
            for leaf in paragraph.children:
                found[leaf.digest] += leaf.end - leaf.start
    return found


def likeness(a: Node, b: Node) -> float:
    """Share of both texts under equal leaves, by length: 1 if the roots are equal, else
    2 * common / (length of a + length of b)."""
    if a.digest == b.digest:
        return 1.0
    x, y = leaves(a), leaves(b)
    common = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return 2 * common / max(1, sum(x.values()) + sum(y.values()))


def edits(a: Node, b: Node) -> list[tuple[int, int]]:
    """Spans of `b` that differ from `a`, found by going down only into branches whose hash does
    not occur on the same level of `a`; touching spans are merged."""
    out: list[tuple[int, int]] = []

    def walk(was: list[Node], now: tuple[Node, ...]) -> None:
        left = Counter(n.digest for n in was)
        for n in now:
            if left[n.digest] > 0:
                left[n.digest] -= 1
            elif n.children:
                walk([c for w in was for c in w.children], n.children)
            elif out and out[-1][1] == n.start:
                out[-1] = (out[-1][0], n.end)
            else:
                out.append((n.start, n.end))

    if a.digest != b.digest:
        walk([a], (b,))
    return out


_BRANCHES = "array<struct<digest: string, start: long, end: long, paragraphs: array<struct<digest: string, start: long, end: long>>>>"


def branches(node: Node) -> list[dict]:
    """Sections of a document tree with their paragraphs, hashes in hex."""
    own = lambda n: {"digest": n.digest.hex(), "start": n.start, "end": n.end}
    return [own(s) | {"paragraphs": [own(p) for p in s.children]} for s in node.children]


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with a struct column: root (hex) and the sections and paragraphs below it with their
    hashes and spans in code points. Equal texts have equal trees.

    Null texts have the root of the empty text and no sections; texts of any length are taken
    whole; repeated rows each get their tree; no rows give none. Where `docs` has a column named
    `out`, the new one gets underscores before its name; it comes last."""
    ship(docs.sparkSession)

    @F.pandas_udf(f"root string, sections {_BRANCHES}")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            trees = [tree(t) for t in part]
            yield pd.DataFrame({"root": [n.digest.hex() for n in trees], "sections": [branches(n) for n in trees]})

    return docs.withColumn(free_name(docs, out), run(F.col(text)))


#: Rows that a range holds about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 4096, 65_536
_LOWEST = -(1 << 63)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, text, guard, range), a range to each partition, sorted there, so that each row's
    next one (ascending id, nulls first, then the text's hash, then the text) follows it: the first
    row of a range is also put, as a guard, behind the range before, and the very first one behind
    the last. The bounds are sampled quantiles of the ids, and, for an id that holds more than a
    range, of its texts' hashes; texts are shuffled once."""
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOWEST))
    n = ranges or min(MOST_RANGES, max(2 * partitions(spark), docs.count() // RANGE_ROWS))
    slim = docs.select(key.alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    quantiles = lambda c, k: F.percentile_approx(c, [(i + 1) / k for i in range(k - 1)] or [0.5], 20 * n)
    hashed = F.shiftright(F.xxhash64("text"), 12)  # 52 bits: quantiles go through doubles
    # counted from the least id, so that large ids close together are told apart; nulls before it
    lo, hi = slim.where("doc_id is not null").agg(F.min("key"), F.max("key")).first()
    close = lo is not None and hi - lo < 1 << 62
    counted = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("key") - F.lit(lo)) if close else F.col("key")
    r = slim.agg(F.min("key"), quantiles(counted, n)).first()
    counts = Counter((_LOWEST if q < 0 else q + lo) if close else q for q in r[1] or [])
    rough = np.array(sorted({r[0], *counts}) if r[0] is not None else [0], dtype=np.int64)

    @F.pandas_udf("int")
    def cell(part: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(rough, part.to_numpy(), side="right"), dtype="int32")

    # quantiles of large ids are rounded: a range starts with the least id that it has
    starts = [x["k"] for x in slim.groupBy(cell("key").alias("c")).agg(F.min("key").alias("k")).collect()]
    hot = [k for k, c in counts.items() if c > 1]  # each holds over an n-th of the rows
    per = slim.where(F.col("key").isin(hot)).groupBy("key").agg(F.min(hashed).alias("lo"), quantiles(hashed, 1 + max(counts.values())).alias("q")).collect() if hot else []
    bounds = {(k, _LOWEST) for k in starts} - {(x["key"], _LOWEST) for x in per} | {(x["key"], h) for x in per for h in {x["lo"], *x["q"]}}
    keys, hashes = np.array(sorted(bounds) or [(0, _LOWEST)], dtype=np.int64).T

    @F.pandas_udf("range int, first boolean")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for key, hashed in parts:
            k, h = key.to_numpy(), hashed.to_numpy()
            at = np.searchsorted(keys, k, side="right") - 1
            # within a hot id's bounds, the last whose hash is not above the row's
            for i in np.flatnonzero((keys[at] == k) & (hashes[at] != _LOWEST)):
                low = np.searchsorted(keys, k[i], side="left")
                at[i] = low + np.searchsorted(hashes[low : at[i] + 1], h[i], side="right") - 1
            yield pd.DataFrame({"range": at.astype("int32"), "first": (keys[at] == k) & ((hashes[at] == _LOWEST) | (hashes[at] == h))})

    kind = lambda k, g: F.struct(k.alias("range"), F.lit(g).alias("guard"))
    placed = slim.withColumn("hash", hashed).withColumn("p", place("key", "hash"))
    before = F.when(F.col("p.range") > 0, F.col("p.range") - 1).otherwise(F.lit(len(keys) - 1))
    both = F.when(F.col("p.first"), F.array(kind(F.col("p.range"), _NEXT), kind(before, _GUARD))).otherwise(F.array(kind(F.col("p.range"), _NEXT)))
    rows = placed.select("key", "hash", "doc_id", "text", F.explode(both).alias("e")).select("e.range", "e.guard", "key", "hash", "doc_id", "text")
    return rows.repartitionById(len(keys), F.col("range")).sortWithinPartitions("range", "guard", "key", "hash", "text")


def edited(text: str, following: str) -> str:
    """The last half of `text` (rounded down) replaced by as much of the start of `following`."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_PAIRS = f"doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections long, n_paragraphs long, first_edit long, edited_chars long, sections {_BRANCHES}"
_PAIR_NAMES = [c.split()[0] for c in _PAIRS.split(", ")][:12]


def compare_edits(docs: DataFrame) -> DataFrame:
    """For each document: its root, the root of its edited text (see `edited`, with the next
    document), the likeness of its tree to the edited text's and to the next document's, the size
    of its tree, where the first difference of the edited text starts (null if none), how many of
    its characters lie in differing branches, and the sections and paragraphs of its tree.

    Null texts count as empty; a lone document follows itself; rows of one id go by the hash of
    their texts; two empty texts are alike (1); texts of any length are taken whole; no rows give
    none; no other column is looked at, whatever its name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for batch in batches:
            out = []
            # ids come through `key`: a column with nulls reaches pandas as doubles
            for k, g, none, key, t in zip(batch["range"], batch["guard"], batch["doc_id"].isna(), batch["key"], batch["text"], strict=True):
                t, d = t or "", None if none else int(key)
                here = (k, d, t, tree(t))
                if last is not None and last[0] == k:
                    _, d0, t0, a = last
                    e = edited(t0, t)
                    b = tree(e)
                    spans = edits(a, b)
                    out.append((d0, len(t0), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), a.digest.hex(), b.digest.hex(), likeness(a, b), likeness(a, here[3]), len(a.children), sum(len(s.children) for s in a.children), spans[0][0] if spans else None, sum(y - x for x, y in spans), branches(a)))
                last = None if g else here
            made = pd.DataFrame(out, columns=_PAIR_NAMES)
            for c in ("doc_id", "first_edit"):
                made[c] = pd.array([r[_PAIR_NAMES.index(c)] for r in out], dtype="Int64")
            yield made

    return with_next(docs).mapInPandas(run, _PAIRS)
