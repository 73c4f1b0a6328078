"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped
under the frequent form they vary, by dense prefix-suffix tiling.

Two words of at most M code points, one of them M long, differ by a single edit exactly when their
common prefix and common suffix together reach M - 1. Then one of the two reaches half of M, so
words are dealt to cells by their first and by their last half. The words of a cell are laid out as
padded matrices of code points, one aligned left and one right, and all rows of a block are compared
with all rows of another at once. Many small cells are stacked into one tensor; cells of more than
`BLOCK` words are cut, and their pairs of blocks are dealt to different tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, spread_join

#: Words of a block, cells stacked up to this size, and comparisons of code points at a time.
BLOCK, SMALL, CELLS = 1024, 32, 1 << 22
#: Rows, or bytes of rows, taken together by a task, but for a larger unit; and words counted before a
#: task hands their counts on.
_ROWS, _BYTES, _WORDS = 1 << 14, 1 << 24, 200_000
#: Words of more code points are laid out apart, those of one length together.
WIDE = 64
LEAST_CHARS, LEAST_COUNT, DELETED = 5, 3, 97

#: Runs of letters in lower-cased UTF-8: a to z, and the two bytes of U+00C0 to U+00FF.
_runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def words_of(doc_id: int | None, text: str | None, deleted: int = DELETED) -> Iterator[tuple[bytes, int]]:
    """The words of a text (UTF-8) and how often it has each: its runs of letters with A-Z in lower
    case, but where the crc32 of id and run is divisible by `deleted`, one code point less."""
    begun = crc32(b"" if doc_id is None else str(doc_id).encode())
    begun = crc32(b":", begun)
    for run, n in Counter(_runs.findall((text or "").encode("utf-8", "surrogatepass").lower())).items():
        h = crc32(run, begun)
        if h % deleted == 0:
            chars = run.decode()
            i = h % len(chars)
            run = (chars[:i] + chars[i + 1 :]).encode()
        yield run, n


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words (see `words_of`) of at least `least_chars` code points that occur at least
    `least_count` times. Texts are taken whole; counts are added up where they are found."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in words_of(d.as_py(), t.as_py()):
                    if len(word) >= least_chars and len(word) - word.count(b"\xc3") >= least_chars:
                        found[word] += n
                if len(found) > _WORDS:
                    yield out()
                    found.clear()
        yield out()

    counted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Matrix:
    """Words as rows of code points, aligned left and right. The first `pad` and the second never meet
    as equals; the last row is no word."""

    def __init__(self, words: list[str]):
        self.length = np.array([*map(len, words), -1])
        width = max(1, int(self.length.max()))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64) + 2
        kind = np.uint8 if not len(flat) or flat.max() < 256 else np.uint32
        flat, column = flat.astype(kind), np.arange(width)
        shape = (len(words) + 1, width)
        left, right = column < self.length[:, None], column >= width - self.length[:, None]
        self.sides = []
        for mask in (left, right):
            for pad in (0, 1):
                m = np.full(shape, pad, kind)
                m[mask] = flat
                self.sides.append(m)
        self.width = width

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the common prefix and suffix of each word in a[..., i] with each in b[..., j]."""
        first, other, last, opposite = self.sides
        apart = first[a][..., :, None, :] != other[b][..., None, :, :]
        behind = (last[a][..., :, None, :] != opposite[b][..., None, :, :])[..., ::-1]
        # a word equals itself up to its end, where the pads differ; beyond the width there is none
        at = lambda x: np.where(x.any(-1), x.argmax(-1), self.width)
        return at(apart), at(behind)

    def near(self, a: np.ndarray, b: np.ndarray, longest: np.ndarray, by_prefix: np.ndarray) -> np.ndarray:
        """Which words differ by one edit, the longer being `longest` long. A pair that shares both halves
        is taken by its prefix cell alone."""
        prefix, suffix = self.common(a, b)
        of_a, of_b = self.length[a][..., :, None], self.length[b][..., None, :]
        fit = (np.maximum(of_a, of_b) == longest) & (np.minimum(of_a, of_b) >= longest - 1)
        k = longest // 2  # the prefix reaches this, or the suffix the rest
        mine = np.where(by_prefix, prefix >= k, (prefix < k) & (suffix >= longest - k))
        return fit & (prefix < longest) & (prefix + suffix >= longest - 1) & mine


class _Found:
    """Near words counted for each row, and the first of them in the rows' order."""

    def __init__(self, n: int):
        self.count, self.best = np.zeros(n, np.int64), np.full(n, -1)

    def add(self, rows: np.ndarray, others: np.ndarray, near: np.ndarray) -> None:
        """`near[..., i, j]` for rows[..., i] and others[..., j]; earlier calls have earlier others."""
        some = near.any(-1)
        first = np.take_along_axis(np.broadcast_to(others[..., None, :], near.shape), near.argmax(-1)[..., None], -1)[..., 0][some]
        at = rows[some]
        self.count[at] += near.sum(-1)[some]
        self.best[at] = np.where(self.best[at] < 0, first, self.best[at])


def tile(units: list[tuple[int, bool, int, int, int]], words: list[str]) -> _Found:
    """Compare the words of each unit (longest, by prefix, start, middle, end): with middle = end all words
    of it with each other, else those before the middle with those from it on. Words of a side are in
    the order in which they are preferred."""
    m, found = Matrix(words), _Found(len(words) + 1)
    small: dict[tuple[int, int, bool], list[tuple[int, int]]] = {}
    for longest, by_prefix, start, middle, end in units:
        if middle == end and end - start <= SMALL:
            small.setdefault((1 << (end - start - 1).bit_length(), longest, by_prefix), []).append((start, end))
            continue
        a, b = (np.arange(start, end),) * 2 if middle == end else (np.arange(start, middle), np.arange(middle, end))
        step = max(1, CELLS // (len(b) * m.width))
        for x in range(0, len(a), step):
            near = m.near(a[x : x + step], b, np.array(longest), np.array(by_prefix))
            found.add(a[x : x + step], b, near)
            if middle != end:
                found.add(b, a[x : x + step], near.T)
    for (size, longest, by_prefix), cells in small.items():
        step = max(1, CELLS // (size * size * m.width))
        for x in range(0, len(cells), step):
            some = np.array(cells[x : x + step])
            rows = some[:, :1] + np.arange(size)
            rows = np.where(rows < some[:, 1:], rows, len(words))
            found.add(rows, rows, m.near(rows, rows, np.array(longest), np.array(by_prefix)))
    return found


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for each word of `words` (distinct `word`, `n`) with near words: how
    many, and the most frequent of them (the smallest of equally frequent ones)."""
    ship(words.sparkSession)
    length = F.char_length("word")

    def cell(longest, by_prefix: bool):
        k = F.floor(longest / 2).cast("int")
        part = F.substring("word", F.lit(1), k) if by_prefix else F.right("word", longest - k)
        return F.struct(longest.cast("int").alias("longest"), F.lit(by_prefix).alias("by_prefix"), F.xxhash64(longest.cast("int"), F.lit(by_prefix), part).alias("cell"))

    cells = F.array(*[cell(length + more, side) for more in (0, 1) for side in (True, False)])
    rows = materialize(words.select("word", "n", F.explode(cells).alias("e")).select("word", "n", "e.*"), "spelling-cells")
    sizes = materialize(rows.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1"), "spelling-sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = spread_join(rows, sizes, "cell", "size").withColumn("b", F.pmod(F.xxhash64("word", F.lit(1)), blocks).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least("b", x).alias("i"), F.greatest("b", x).alias("j"), (F.col("b") > x).alias("second")))
    units = dealt.select("cell", "longest", "by_prefix", F.explode(pair).alias("e"), "word", "n").select("cell", "longest", "by_prefix", "e.*", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []
        size = 0

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            units, start = {}, 0
            while start < len(rows):
                first = rows[start][:5]
                middle = end = start
                while end < len(rows) and rows[end][:5] == first:
                    end += 1
                    middle += not rows[end - 1][5]
                if first[3] == first[4] or start < middle < end:
                    # long words don't widen the others' rows
                    units.setdefault(first[1] if first[1] > WIDE else 0, []).append((first[1], first[2], start, end if first[3] == first[4] else middle, end))
                start = end
            for own in units.values():
                yield hits([rows[r] for *_, low, _, high in own for r in range(low, high)], own)

        def hits(rows: list[tuple], units: list[tuple]) -> pa.RecordBatch:
            texts, moved, at = [r[6] for r in rows], [], 0
            for longest, by_prefix, start, middle, end in units:
                moved.append((longest, by_prefix, at, at + middle - start, at + end - start))
                at += end - start
            found = tile(moved, texts)
            hit, best = np.flatnonzero(found.count[:-1]).tolist(), found.best
            return pa.RecordBatch.from_arrays([pa.array([texts[r] for r in hit], pa.string()), pa.array(found.count[hit], pa.int64()), pa.array([texts[best[r]] for r in hit], pa.string()), pa.array([rows[best[r]][7] for r in hit], pa.int64())], ["word", "n_near", "form", "form_n"])

        for batch in batches:
            open_ += zip(*[c.to_pylist() for c in batch.columns], strict=True)
            size += batch.nbytes
            if len(open_) >= _ROWS or size >= _BYTES:
                size = 0
                # the last unit may go on
                cut = len(open_)
                while cut and open_[cut - 1][:5] == open_[-1][:5]:
                    cut -= 1
                if cut:
                    yield from done(open_[:cut])
                    open_ = open_[cut:]
        if open_:
            yield from done(open_)

    keys = ["cell", "longest", "by_prefix", "i", "j"]
    ordered = units.select(*keys, "second", "word", "n").repartition(*keys).sortWithinPartitions(*keys, "second", F.desc("n"), "word")
    each = ordered.mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("least"), "form"))
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.least")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last. Each round follows as many steps as
    all before it; counts at least double at each step, so there are few."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def group_words(words: DataFrame, times: int = 2) -> DataFrame:
    """`words` (distinct `word`, and `n`, neither null) with n_near (near words), form (the near word of
    largest n, ties to the smallest in code-point order, if its n is at least `times` times the word's own, 2 or
    more), form_n, and root: the last word that forms lead to, the word itself if it has none. Empty words and
    words of any code points and lengths are compared; no rows give none."""
    near = materialize(near_words(words), "spelling-near")
    named = words.select("word", "n").join(near, "word", "left")
    follows = F.col("form_n") >= times * F.col("n")
    named = materialize(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n")), "spelling-named")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all documents, grouped (see `count_words` and `group_words`).

    Null, empty and letterless texts have no words; a null id counts as no characters in the check sum;
    repeated rows count each; texts and words of any length are taken whole; no rows give none; no other
    column is looked at, whatever its name."""
    return group_words(materialize(count_words(docs, doc_id, text), "spelling-words"))
