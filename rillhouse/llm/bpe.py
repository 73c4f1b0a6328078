"""Byte-level BPE encoding and decoding with a segment tree.

Each piece of text that the splitting pattern finds is merged on its own. Its byte positions are
the leaves of a segment tree; the leaf of a token's first byte holds the rank of the pair that the
token forms with its right neighbour, and each inner node the smallest (rank, position) below, so
that the root is the leftmost pair of least rank. A merge changes three leaves: the pair's own,
its left neighbour's and that of the token that went, each in logarithmic time.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, free_name, ship

_NONE = 1 << 62
_KEEP = 120_000  # pieces in each of the two halves of a worker's memory
_LONG = 48  # longer pieces are not remembered


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    at = size
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[at] = r * n + i
        at += 1
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (top := tree[1]) < _NONE:
        i = top % n
        gone = after[i]
        j = after[gone]
        after[i] = j
        before[j] = i
        r = get(piece[i : after[j]]) if j < n else None
        changed = [(i, _NONE if r is None else r * n + i)]
        if gone < n - 1:
            changed.append((gone, _NONE))
        p = before[i]
        if p >= 0:
            r = get(piece[p:j])
            changed.append((p, _NONE if r is None else r * n + p))
        for at, value in changed:
            at += size
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


#: The one pattern that `latin_pattern` is right for; `regex` runs every other on all texts.
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def latin_pattern(pattern: str) -> str:
    """The splitting pattern `LATIN` for texts of code points below 256 alone, with its letter,
    number and space classes written out, so that the faster `re` can run it."""
    sets = {k: "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
    space = "".join(re.escape(c) for c in "\t\n\x0b\x0c\r \x85\xa0")
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{space}{sets['L']}{sets['N']}]"), (r"\p{L}", f"[{sets['L']}]"), (r"\p{N}", f"[{sets['N']}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        pattern = pattern.replace(old, new)
    return pattern


class Codec(Remembered):
    """Maps a piece of text to its ids as little-endian unsigned 32-bit bytes, remembering a
    bounded number of short pieces."""

    def __init__(self, path: str, pattern: str):
        import regex

        super().__init__(_KEEP)
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.find_latin = re.compile(latin_pattern(pattern)).findall if pattern == LATIN else self.find
        by_id = {i: b for b, i in self.ranks.items()}
        words = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.length = np.array([len(w) for w in words])
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def make(self, piece: str) -> bytes:
        found = merge(piece.encode(), self.ranks)
        return pack("<%dI" % len(found), *found)

    def worth(self, piece: str) -> bool:
        return len(piece) <= _LONG

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_latin(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        k = np.frombuffer(ids, "<u4").astype(np.int64)
        n = self.length[k]
        at = np.repeat(self.start[k] - np.cumsum(n) + n, n)
        return self.bytes[at + np.arange(len(at))].tobytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _each(df: DataFrame, source: str, targets: list[str], work, keep: list[str]) -> DataFrame:
    """`keep` of `df`, and `targets` with the binaries that `work` makes of each value of `source`."""
    ship(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{t}` binary" for t in targets)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = [work(x.as_py()) for x in part.column(at)]
                made = [pa.array([r[k] for r in rows], pa.binary()) for k in range(len(targets))]
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, *targets])

    return df.select(*dict.fromkeys([*keep, source])).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all but the text, if not given) and `out`: the ids of the whole text as
    little-endian unsigned 32-bit values in one binary.

    Null and empty texts have no ids; special tokens in a text are ordinary text; pieces of any
    length are merged whole; repeated rows each get theirs; no rows give none. Where a kept column
    is named `out`, the new one gets underscores before its name; it comes last."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    return _each(df, text, [free_name(df.select(*keep), out)], lambda t: (codec(path, pattern).encode(t or ""),), keep)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all, if not given) and `out`: the bytes that the packed ids stand for; null
    ids stand for none. Names clash and rows count as in `encode`."""
    keep = df.columns if keep is None else keep
    return _each(df, ids, [free_name(df.select(*keep), out)], lambda b: (codec(path, pattern).decode(b or b""),), keep)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", out: tuple[str, str] = ("ids", "decoded"), keep: list[str] | None = None) -> DataFrame:
    """`encode`, then `decode` of its ids, in one pass: `keep` columns and the two of `out`. A task has
    one Python worker for both, so one memory of pieces. Names clash and rows count as in `encode`."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    first = free_name(df.select(*keep), out[0])
    second = free_name(df.select(*keep, F.lit(None).alias(first)), out[1])

    def work(t: str | None) -> tuple[bytes, bytes]:
        own = codec(path, pattern)
        ids = own.encode(t or "")
        return ids, own.decode(ids)

    return _each(df, text, [first, second], work, keep)


def digests(encoded: DataFrame) -> DataFrame:
    """Of encoded and decoded documents: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
