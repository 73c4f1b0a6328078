"""N-gram Jaccard join: documents whose sets of word shingles overlap by a given share, by
T-occurrence search over inverted lists with DivideSkip.

A search takes a query's shingles, the inverted lists of an index of documents, and the number T of
lists that a document must occur in. The longest lists are set aside; the short ones are merged by a
heap that skips ahead to documents that can still reach T less the number of long lists; each
candidate is then looked up in the long lists by binary search.

What is searched together is found by the shingles' global order, rare ones first: two documents
that are similar enough share one of their first few shingles. Rows that share such a shingle make a
cell. Each cell elects a pivot, the row with the fewest rarer shingles, and cells of one pivot make a
group. First every row of a group is searched against its pivot alone, so that a group of near copies
becomes a star and is never expanded into pairs. Distances are a metric, so what is left to search
in a group are the rows that are not linked with the pivot, and those that are, only where some row
lies within twice the distance. These are searched in blocks of bounded size.

Before any text is sent to be searched, sketches meet in its place: a sketch holds the parity of a set's
shingles by hash, so that two of them never differ in more bits than their sets do in shingles. Rows that
share a shingle by chance, which grow faster than the documents, are told apart by these few bytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship, spread_join
from .simhash import components

PERCENT, SHINGLE = 80, 5
SEED = 42
#: Frequent shingles kept at most; a shingle of more than this share of all is always among them.
FREQUENT = 1 << 16
#: A shingle found in more than a 200th of the documents is counted before its rows meet.
HOT = 200
#: Shingles of a block, about, but for a larger document: a search takes one block or two.
BLOCK = 1_000_000
#: Up to so many candidates are looked for by a broadcast when their texts are read again; beyond,
#: by a shuffle.
BROADCAST_ROWS = 100_000
#: How much a lookup in a long list costs against a step of the merge.
LOOKUP = 0.02
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BYTES = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of text that are cut and hashed at a time, but for a longer text.
_TEXT = 1 << 16


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL[1]
    x = (x ^ (x >> np.uint64(27))) * _MUL[2]
    return x ^ (x >> np.uint64(31))


def _places(n: int) -> np.ndarray:
    """Odd 64-bit factors of the places in a word."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * _MUL[0]) | np.uint64(1)


_near_places = _places(256)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def _cut(data: np.ndarray, ends: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sets of texts that lie in UTF-8 one behind the other in `data`."""
    letter = ~_SPACE[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    cut = ends[:-1][ends[:-1] < len(data)]
    begins[cut] |= letter[cut]  # a text's first word
    at = np.flatnonzero(letter)
    if not len(at):
        yield from (np.zeros(0, np.uint64) for _ in ends)
        return
    first = np.flatnonzero(begins[at])  # of each word, in `at`
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    factors = _near_places if size.max() <= len(_near_places) else _places(int(size.max()))
    # words are hashed by sums of byte values times factors of their places
    each = _mixed(np.add.reduceat(_BYTES[data[at]] * factors[place], first) + size.astype(np.uint64))
    last = np.searchsorted(at[first], ends)  # words before the end of each text
    whole = each + np.uint64(k)
    for i in range(1, k):
        whole = _mixed(whole)[: max(0, len(each) - i)] * _MUL[0] + each[i:]
    whole, low = _mixed(whole), 0
    for high in last.tolist():
        n = high - low
        if n >= k:
            yield _distinct(whole[low : high - k + 1])
        elif n:
            one = each[low : low + 1] + np.uint64(n)
            for i in range(low + 1, high):
                one = _mixed(one) * _MUL[0] + each[i : i + 1]
            yield _mixed(one)
        else:
            yield np.zeros(0, np.uint64)
        low = high


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the distinct 64-bit hashes of its shingles of k words, ascending; a text of fewer
    words is one shingle, a null one and one without words have none. Only A-Z are taken as a-z,
    only ASCII white space splits."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _TEXT, side="right")) - 1)
        yield from _cut(data[offsets[start] : offsets[stop]], offsets[start + 1 : stop + 1] - offsets[start], k)
        start = stop


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), k))


def required(n: int, percent: int) -> int:
    """The least overlap of a set of n with any similar set."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int) -> int:
    """How many first shingles of a set of n hold one of every similar set's, in any order."""
    return n - required(n, percent) + 1


def index_prefix(n: int, percent: int) -> int:
    """As `prefix`, for similar sets that are no smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


#: Rows of a block of sketches, and shingles that these stand for, about.
SKETCH_ROWS, SKETCH_BLOCK = 1 << 13, 1 << 24


def sketch(x: np.ndarray) -> bytes:
    """The parity of a set's shingles by their low bits: one to two bits for each shingle, 64 at least."""
    bits = max(64, 1 << len(x).bit_length())
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many shingles two sets differ at least, by their sketches. The longer one is folded."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    x, size = int.from_bytes(b, "little"), 8 * len(b)
    while size > 8 * len(a):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(a, "little")).bit_count()


def may_reach(differ, n, percent: int):
    """Whether sets of `n` shingles together can be similar by `percent`, if they differ in so many."""
    return differ * (100 + percent) <= (100 - percent) * n


def met(n: np.ndarray, asks: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Of some rows those with another one that may be similar by `percent`, one of the two asking."""
    order = np.argsort(n, kind="stable")
    n, asks, found = n[order], asks[order], np.zeros(len(n), bool)
    widths = np.array([len(sketches[i]) for i in order])
    starts = np.flatnonzero(np.append(True, widths[1:] != widths[:-1]))
    ends = np.append(starts[1:], len(n))
    rows = [np.frombuffer(b"".join(sketches[i] for i in order[low:high]), np.uint64).reshape(high - low, -1) for low, high in zip(starts, ends, strict=True)]
    last = np.searchsorted(n, 100 * n // percent, side="right")
    for k, (low, high) in enumerate(zip(starts, ends, strict=True)):
        # sets of a fitting size have sketches of the same length or, folded once, of the next
        sides = [(low, rows[k])]
        if k + 1 < len(rows) and rows[k + 1].shape[1] == 2 * rows[k].shape[1]:
            half = rows[k].shape[1]
            sides.append((high, rows[k + 1][:, :half] ^ rows[k + 1][:, half:]))
        for r in range(low, high):
            own = rows[k][r - low]
            for begin, side in sides:
                a, b = max(begin, r + 1), min(begin + len(side), last[r])
                if a < b:
                    differ = np.bitwise_count(side[a - begin : b - begin] ^ own).sum(axis=1, dtype=np.int64)
                    hit = may_reach(differ, n[a:b] + n[r], percent) & (asks[a:b] | asks[r])
                    found[a:b] |= hit
                    found[r] |= hit.any()
    out = np.empty(len(n), bool)
    out[order] = found
    return out


class Index:
    """Inverted lists over some sets of shingles."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, first = np.unique(tokens[order], return_index=True)
        self.posting, self.first = owner[order].tolist(), np.append(first, len(tokens))

    def search(self, query: np.ndarray, need: int, skip: Callable[[int], bool] = lambda _: False) -> list[tuple[int, int]]:
        """(place, overlap) of the indexed sets that share at least `need` (1 or more) shingles with
        the query, but for places that `skip` passes over."""
        at = np.searchsorted(self.tokens, query)
        at = at[at < len(self.tokens)] if len(self.tokens) else at[:0]
        at = at[self.tokens[at] == query[: len(at)]] if len(at) else at
        low, high = self.first[at], self.first[at + 1]
        if len(at) < need:
            return []
        order = np.argsort(high - low, kind="stable")
        low, high = low[order].tolist(), high[order].tolist()
        longest = high[-1] - low[-1]
        aside = min(need - 1, int(need / (LOOKUP * log2(longest + 1) + 1)))
        n_short, posting, out = len(low) - aside, self.posting, []
        floor = need - aside
        heap = [(posting[low[s]], s) for s in range(n_short)]
        heapify(heap)
        while len(heap) >= floor:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heappop(heap)[1])
            if len(popped) >= floor:
                if not skip(top):
                    found, left = len(popped), aside
                    for s in range(n_short, len(low)):
                        p = bisect_left(posting, top, low[s], high[s])
                        found += p < high[s] and posting[p] == top
                        left -= 1
                        if found + left < need:
                            break
                    if found >= need:
                        out.append((top, found))
                target = top + 1
            else:
                # the next place that can still occur often enough
                while heap and len(popped) < floor - 1:
                    popped.append(heappop(heap)[1])
                if not heap:
                    break
                target = heap[0][0]
            for s in popped:
                low[s] = bisect_left(posting, target, low[s], high[s])
                if low[s] < high[s]:
                    heappush(heap, (posting[low[s]], s))
        return out


# --- frequent shingles


class Counter:
    """Misra-Gries counts of at most `keep` shingles: each is too low by at most the number of all
    shingles added, divided by keep + 1."""

    def __init__(self, keep: int):
        self.keep, self.waiting, self.n = keep, [], 0
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.n += len(tokens)
        if self.n > 1 << 21:
            self.settle()

    def settle(self) -> None:
        new, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        tokens, at = np.unique(np.concatenate((self.tokens, new)), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate((self.counts, count)), minlength=len(tokens)).astype(np.int64)
        if len(counts) > self.keep:
            counts = counts - np.partition(counts, len(counts) - self.keep - 1)[len(counts) - self.keep - 1]
        self.tokens, self.counts, self.waiting, self.n = tokens[counts > 0], counts[counts > 0], [], 0


def frequent(docs: DataFrame, text: str, k: int, keep: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all documents (ascending), and about how many documents have
    each. Counts are kept where the texts are and added up; at most `keep` come here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(2 * keep)
        for batch in batches:
            for x in shingle_sets(batch.column(0), k):
                counter.add(x)
        counter.settle()
        often = counter.counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(counter.tokens[often].view(np.int64)), pa.array(counter.counts[often])], ["token", "n"])

    counts = docs.select(text).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "token").limit(keep).toArrow()
    tokens, n = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


# --- cells


def _key(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def classes(docs: DataFrame, doc_id: str, text: str, percent: int, k: int) -> DataFrame:
    """A row for each distinct text: c (a number), key, rep (its least id), n_docs, n (its
    shingles), cold (how many of them are not frequent), prefix (its first ones, rare ones first), sketch."""
    spark = docs.sparkSession
    total = docs.count()
    tokens, counts = frequent(docs, text, k)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    shared = spark.sparkContext.broadcast((tokens, rank, counts * HOT > total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, hot = shared.value
        for batch in batches:
            n, cold, sketches, ends, parts = [], [], [], [0], [np.zeros(0, np.uint64)]
            for x in shingle_sets(batch.column("text"), k):
                at = np.minimum(np.searchsorted(known, x), max(0, len(known) - 1))
                often = known[at] == x if len(known) else np.zeros(len(x), bool)
                late = x[often][np.argsort(rank[at[often]])]
                parts.append(np.concatenate((x[~often], late))[: prefix(len(x), percent) if len(x) else 0])
                n.append(len(x))
                sketches.append(sketch(x))
                cold.append(len(x) - int(hot[at[often]].sum()) if len(known) else len(x))
                ends.append(ends[-1] + len(parts[-1]))
            first = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int32()), pa.array(cold, pa.int32()), pa.array(sketches, pa.binary()), first], ["doc_id", "key", "n", "cold", "sketch", "prefix"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _key(text).alias("key"), F.col(text).alias("text"))
    rows = slim.mapInArrow(run, "doc_id long, key binary, n int, cold int, sketch binary, prefix array<long>")
    each = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), *[F.first(x).alias(x) for x in ("n", "cold", "sketch", "prefix")])
    return materialize(each.withColumn("c", F.monotonically_increasing_id()), "jaccard-classes")


def members(found: DataFrame, percent: int) -> DataFrame:
    """Rows (g, c, n, n_g, near, mate) of the groups: c shares a cell with the pivot g. `near`: the places in
    the cells allow c and g twice the distance of a link at most. `mate`: a cell of the two has a third
    row of a size that c may be similar to."""
    # n, pos and whether the shingle is hot, in one number
    cells = found.where("n > 0").select("c", "n", "cold", F.posexplode("prefix").alias("pos", "t"))
    packed = F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos") * 2
    cells = cells.select("t", "c", packed.alias("np"), (F.col("pos") >= F.col("cold")).alias("hot"))
    n, pos = F.shiftright("np", 32).cast("int"), F.shiftright(F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")
    # a row that is similar to no smaller one by this shingle
    indexed = pos < n - F.ceil(n * (2 * percent) / F.lit(100 + percent)) + 1
    elected, kept = F.min(F.struct(pos.alias("pos"), "c", n.alias("n"))), (F.col("size") > 1) & F.col("some")
    w = Window.partitionBy("t")
    names = ["t", "c", n.alias("n"), pos.alias("pos")]
    few = cells.where("not hot").select("t", "c", "np").select(*names, F.count("*").over(w).alias("size"), F.max(indexed).over(w).alias("some"), elected.over(w).alias("p")).where(kept)
    many = cells.where("hot").select("t", "c", "np")
    tops = materialize(many.groupBy("t").agg(F.count("*").alias("size"), F.max(indexed).alias("some"), elected.alias("p")).where(kept), "jaccard-tops")
    # rows that have another beside the pivot in the cell, of a size that may be similar
    few = few.where(F.col("c") != F.col("p.c"))
    beside = Window.partitionBy("t").orderBy("n")
    mate = (F.lag("n").over(beside) * 100 >= F.col("n") * percent) | (F.lead("n").over(beside) * percent <= F.col("n") * 100)
    few = few.withColumn("mate", F.coalesce(mate, F.lit(False)))
    both = few.unionByName(spread_join(many, tops, "t", "size").select(*names, "size", "some", "p").withColumn("mate", F.col("size") > 2))
    both = both.select(F.col("p.c").alias("g"), "c", "n", F.col("p.n").alias("n_g"), "pos", F.col("p.pos").alias("at"), "mate").where("c <> g")
    bound = F.least("pos", "at") + F.least(F.col("n") - F.col("pos"), F.col("n_g") - F.col("at"))
    wide = 2 * percent - 100
    return both.groupBy("g", "c").agg(F.max("n").alias("n"), F.max("n_g").alias("n_g"), F.bool_and((100 + wide) * bound >= wide * (F.col("n") + F.col("n_g"))).alias("near"), F.max("mate").alias("mate"))


# --- searches


#: What a row is in its group: not searched against the pivot or too far from it, within twice the
#: distance of a link, or linked with it.
_FAR, _RING, _LINKED = 0, 1, 2
_HIT = "g long, c long, other long, overlap int, n int, n_other int"


_TURN = "g: long, i: int, j: int, side: int, asks: boolean, state: int"


def placed(rows: DataFrame, blocks: Column) -> DataFrame:
    """`rows` (g, c, n, asks, pivot, state) once for each unit (g, i, j) that they take part in. Rows of a
    group are cut in so many `blocks`; with a pivot in the group, each block meets it in a unit of its own, else
    each pair of blocks (i <= j) has one. `side`: 0 for block i, 1 for block j or the pivot."""
    sizes = rows.groupBy("g").agg(F.ceil(blocks).cast("int").alias("b"), F.max("pivot").alias("star"), F.count("*").alias("m"), F.count_if("asks").alias("a"))
    sizes = materialize(sizes.where("a > 0 and m > 1").select("g", "b", "star", F.col("m").alias("n")), "jaccard-sizes")
    own = F.pmod(F.xxhash64("c"), "b").cast("int")
    turn = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    all_, pivot = F.sequence(F.lit(0), F.col("b") - 1), F.lit(-1)
    turns = (
        F.when(F.col("star") & ~F.col("pivot"), F.array(turn(own, pivot, F.lit(0))))
        .when(F.col("star"), F.transform(all_, lambda x: turn(x, pivot, F.lit(1))))
        .otherwise(F.transform(all_, lambda x: turn(F.least(own, x), F.greatest(own, x), F.when(own > x, 1).otherwise(0))))
    )
    cut = spread_join(rows.withColumnRenamed("n", "size"), sizes, "g")
    return cut.select("g", "c", "asks", "state", F.explode(turns).alias("e")).select("g", "e.i", "e.j", "e.side", "asks", "c", "state")


def search(units: DataFrame, k: int, percent: int, spanning: bool) -> DataFrame:
    """(g, c, other, overlap, n, n_other) for rows c that ask and other rows of the same unit (g, i, j),
    of the same block or of another, that are similar by `percent`. With `spanning`, links between rows
    that are joined already, by links of the unit or with the pivot, are left out, and so are rows
    linked with the pivot for those too far from it to reach them."""

    def hits(unit: tuple, first: list, second: list) -> list[tuple]:
        out: list[tuple] = []
        top = {c: unit[0] for c, state, *_ in first + second if state == _LINKED} if spanning else {}

        def root(x: int) -> int:
            while (up := top.get(x, x)) != x:
                top[x] = top.get(up, up)
                x = up
            return x

        def ask(queries: list, listed: list) -> None:
            if not queries or not listed:
                return
            index, ids = Index([x for *_, x in listed]), [c for c, *_ in listed]
            for c, state, _, x in queries:
                if spanning:
                    skip = lambda p, c=c, far=state == _FAR: root(ids[p]) == root(c) or far and listed[p][1] == _LINKED
                else:
                    skip = lambda p, c=c: ids[p] == c
                for p, overlap in index.search(x, max(1, required(len(x), percent)), skip):
                    n = len(listed[p][3])
                    if 100 * overlap >= percent * (len(x) + n - overlap):
                        out.append((unit[0], c, ids[p], overlap, len(x), n))
                        if spanning:
                            top[root(c)] = root(ids[p])

        asking = lambda rows: [r for r in rows if r[2]]
        if unit[1] == unit[2]:
            ask(asking(first), first)
        else:
            ask(asking(first), second)
            ask(asking(second), [r for r in first if not r[2]])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _HIT.split(", ")]
        schema = pa.schema([(x, pa.int64() if x in ("g", "c", "other") else pa.int32()) for x in names])
        made = lambda rows: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
        unit, sides = None, ([], [])
        for batch in batches:
            out = []
            columns = [column.to_pylist() for column in batch.columns[:7]]
            for *now, side, asks, c, state, grams in zip(*columns, shingle_sets(batch.column(7), k), strict=True):
                if tuple(now) != unit:
                    out += hits(unit, *sides) if unit else []
                    unit, sides = tuple(now), ([], [])
                if not sides[side] or sides[side][-1][0] != c:  # a row may come from several tasks
                    sides[side].append((c, state, asks, grams))
            yield made(out)
        if unit:
            yield made(hits(unit, *sides))

    rows = units.select("g", "i", "j", "side", "asks", "c", "state", "text")
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "c").mapInArrow(run, _HIT)


def shipped(docs: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts (g, i, j, asks, c, state, text) of `rows` (see `placed`), read again from `docs` (doc_id,
    text): one row of each class goes to all its blocks."""
    turns = placed(rows, F.sum("n") / BLOCK).groupBy("c").agg(F.collect_list(F.struct("g", "i", "j", "side", "asks", "state")).alias("turns"))
    side = materialize(found.select("c", "key", "rep").join(turns, "c"), "jaccard-turns")
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    texts = docs.select(_key("text").alias("key"), "doc_id", "text").join(side, "key").where(F.col("doc_id").eqNullSafe(F.col("rep")))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated rows of one id and text: one of a task is enough."""
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for c in batch.column(0).to_pylist():
                keep.append(c not in seen)
                seen.add(c)
            yield batch.filter(pa.array(keep, pa.bool_()))

    kept = texts.select("c", "text", "turns").mapInArrow(once, f"c long, text string, turns array<struct<{_TURN}>>")
    return kept.select("c", "text", F.explode("turns").alias("e")).select("e.g", "e.i", "e.j", "e.side", "e.asks", "c", "e.state", "text")


def near_pivots(groups: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Rows of `groups` whose sketches allow c and g to be similar by `percent`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, n_g, a, b = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [may_reach(apart(x, y), m + m_g, percent) for m, m_g, x, y in zip(n, n_g, a, b, strict=True)]
            yield batch.select(["g", "c", "n", "n_g"]).filter(pa.array(keep, pa.bool_()))

    slim = found.select("c", "sketch")
    pivots = groups.groupBy("g").agg(F.count("*").alias("m")).join(slim.select(F.col("c").alias("g"), F.col("sketch").alias("sketch_g")), "g")
    both = spread_join(groups, materialize(pivots, "jaccard-pivots"), "g", "m").join(slim, "c")
    return both.select("g", "c", "n", "n_g", "sketch", "sketch_g").mapInArrow(run, "g long, c long, n int, n_g int")


def beside(rows: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """`rows` (g, c, n, asks, pivot, state) that have another in their group whose sketch allows the two to be
    similar by `percent`, one of them asking."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int64()), ("c", pa.int64())])
        unit, held = None, []

        def kept() -> pa.RecordBatch:
            c, n, asks, sketches = zip(*held, strict=True)
            some = met(np.array(n, np.int64), np.array(asks, bool), list(sketches), percent)
            out = np.array(c, np.int64)[some]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(out), unit[0], np.int64)), pa.array(out)], schema=schema)

        for batch in batches:
            for *now, c, n, asks, own in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if tuple(now) != unit:
                    if held:
                        yield kept()
                    unit, held = tuple(now), []
                held.append((c, n, asks, own))
        if held:
            yield kept()

    units = placed(rows, F.count("*") / SKETCH_ROWS + F.sum("n") / SKETCH_BLOCK).join(found.select("c", "n", "sketch"), "c")
    units = units.select("g", "i", "j", "c", "n", "asks", "sketch").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return rows.join(units.mapInArrow(run, "g long, c long").distinct(), ["g", "c"], "left_semi")


def links(docs: DataFrame, found: DataFrame, percent: int, k: int) -> DataFrame:
    """Edges (c, other) whose connected components are those of all similar pairs of classes."""
    groups = materialize(members(found, percent), "jaccard-groups")
    yes, no, wide = F.lit(True), F.lit(False), 2 * percent - 100
    # each row against its pivot
    near = materialize(near_pivots(groups.where("near").select("g", "c", "n", "n_g"), found, wide), "jaccard-near").withColumn("state", F.lit(_FAR))
    star = near.select("g", "c", "n", yes.alias("asks"), no.alias("pivot"), "state").unionByName(near.groupBy("g").agg(F.first("n_g").alias("n"), F.first("state").alias("state")).select("g", F.col("g").alias("c"), "n", no.alias("asks"), yes.alias("pivot"), "state"))
    linked = F.col("overlap") * 100 >= F.lit(percent) * (F.col("n") + F.col("n_other") - F.col("overlap"))
    hits = search(shipped(docs, found, star), k, wide, False)
    hits = materialize(hits.select("g", "c", F.when(linked, _LINKED).otherwise(_RING).alias("state")).distinct(), "jaccard-star")
    # what is left of the groups: rows linked with the pivot stay only where there is a ring
    rings = hits.where(F.col("state") == _RING).select("g").distinct().withColumn("ringed", yes)
    state, asks = F.coalesce("state", F.lit(_FAR)), F.coalesce("state", F.lit(_FAR)) != _LINKED
    rest = groups.where("mate").select("g", "c", "n").join(hits, ["g", "c"], "left").join(rings, "g", "left").where(asks | F.col("ringed").isNotNull())
    rest = materialize(rest.select("g", "c", "n", state.alias("state"), asks.alias("asks"), no.alias("pivot")), "jaccard-rest")
    # of these, the rows that may be similar to another
    rest = materialize(beside(rest, found, percent), "jaccard-beside")
    more = search(shipped(docs, found, rest), k, percent, True).select("c", "other")
    return hits.where(F.col("state") == _LINKED).select("c", F.col("g").alias("other")).unionByName(more).distinct()


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, and component_id, the smallest id that can
    be reached over links: two documents are linked when their sets of shingles overlap by
    `percent` of their union (51 to 99).

    Shingles are compared by 64-bit hashes. Null texts and texts without words have no shingles and
    are linked with nothing, not with each other either; a text of fewer words than a shingle is one
    shingle; texts are taken whole; rows of equal ids each get their row; a null id names no
    component, but its row still links; no rows give none; no other column is looked at."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = classes(docs, "doc_id", "text", percent, shingle)
    roots = components(links(docs, found, percent, shingle))
    named = materialize(found.select("c", "key", "rep", "n_docs", "n").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")), "jaccard-named")
    least = materialize(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "jaccard-least")
    named = materialize(spread_join(named, least, "root", "members").select("key", "n", "n_docs", "component_id"), "jaccard-ends")
    rows = spread_join(docs.select("doc_id", _key("text").alias("key")), named, "key", "n_docs")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
