"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Features of a text are its lower-case words and their prefixes, as far as training chose them:
those much more frequent in toxic than in other labelled texts. A feature's value is
log(1 + count), and two features more count the words with any chosen feature, and those after the
first. Labels say toxic or not. Severity grades come from models that have not seen the text: the
labelled texts are dealt to folds (near copies to the same one), each fold is scored by a two-grade
model whose features and weights come from the other folds, and toxic texts get grades 1 to 3 by
thirds of these scores; texts not labelled toxic have grade 0.
With one weight vector w for all grades and ordered thresholds c1 <= c2 <= c3,
P(grade >= k) = sigmoid(w.x - ck); the expected severity is the sum of these over k.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, free_name, ship

#: Labelled rows that a fit uses at most, not toxic and toxic; the smallest hashes of their ids.
MAX_ROWS = (5000, 2500)
GRADES = 3
#: Folds of the cross-fitted scores that toxic texts are graded by.
FOLDS = 3
#: What choosing a feature takes, in nats; and cells that features are counted in by hash.
LEAST_GAIN, _CELLS = 11.0, 1 << 20
_words = re.compile(r"\w+").findall
_PREFIXES = (4, 5, 6, 7)
_KEEP = 50_000  # words in each of the two halves of a worker's memory
#: The features that count words with any chosen feature, and those after the first.
ANY, MORE = "*", "**"


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in _PREFIXES if n < len(word))]


@dataclass
class Model:
    weights: dict[str, float]
    cuts: list[float]

    def scorer(self) -> Scorer:
        return Scorer(self)

    def severity(self, eta: float) -> list[float]:
        """P(grade >= k) for k = 1.."""
        return [1 / (1 + float(np.exp(np.clip(c - eta, -50, 50)))) for c in self.cuts]


class Scorer(Remembered):
    """Maps a word to its chosen features, or None. Remembers a bounded number of words."""

    def __init__(self, model: Model):
        super().__init__(_KEEP)
        self.model = model

    def make(self, word: str) -> tuple[str, ...] | None:
        return tuple(f for f in features_of(word) if f in self.model.weights) or None

    def values(self, text: str | None) -> tuple[Counter, int, int]:
        """Counts of chosen features, words with one, and words."""
        words = _words((text or "").lower())
        hits = list(filter(None, map(self.__getitem__, words)))
        counts = Counter(f for h in hits for f in h)
        if hits:
            counts[ANY], counts[MORE] = len(hits), len(hits) - 1
        return counts, len(hits), len(words)

    def eta(self, text: str | None) -> float:
        counts, _, _ = self.values(text)
        return float(sum(self.model.weights.get(f, 0.0) * np.log1p(n) for f, n in counts.items()))


class Sample:
    """Labelled texts as numbers: each text's words, each word's features, and groups of texts of
    one label with the same two smallest word hashes, such as near copies, which count as one."""

    def __init__(self, texts: list[str | None], toxic: list[bool]):
        vocabulary: dict[str, int] = {}
        own = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _words((t or "").lower())], np.int32) for t in texts]
        self.toxic = np.array(toxic, bool)
        self.flat, self.text = np.concatenate([np.zeros(0, np.int32), *own]), np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
        hashes = np.array([zlib.crc32(w.encode()) for w in vocabulary], np.int64)
        groups: dict[tuple, list[np.ndarray]] = {}
        for x, words in zip(toxic, map(np.unique, own), strict=True):
            groups.setdefault((bool(x), *np.sort(hashes[words])[:2].tolist()), []).append(words)
        words_of = [np.unique(np.concatenate(words)) for words in groups.values()]
        fold_of = {k: zlib.crc32(repr(k).encode()) % FOLDS for k in groups}
        self.fold = np.array([fold_of[bool(x), *np.sort(hashes[np.unique(w)])[:2].tolist()] for x, w in zip(toxic, own, strict=True)], int)
        self.group_toxic, self.group_fold = np.array([k[0] for k in groups], bool), np.array(list(fold_of.values()), int)
        # only features that enough toxic groups may have are named: they are counted by hash first
        cells = np.full((len(vocabulary), 1 + len(_PREFIXES)), _CELLS, np.int32)
        for i, w in enumerate(vocabulary):
            found = [zlib.crc32(f.encode()) % _CELLS for f in features_of(w)]
            cells[i, : len(found)] = found
        counts = np.zeros(_CELLS + 1, np.int64)
        for words, bad in zip(words_of, self.group_toxic, strict=True):
            if bad:
                counts[np.unique(cells[words])] += 1
        counts[_CELLS] = 0
        index: dict[str, int] = {}
        least = self.least_groups()
        lists = [[index.setdefault(f, len(index)) for f, c in zip(features_of(w), cells[i], strict=False) if counts[c] >= least] if counts[cells[i]].max() >= least else () for i, w in enumerate(vocabulary)]
        self.names = list(index)
        self.size = np.array([len(x) for x in lists], np.int64)
        self.start, self.ids = np.cumsum(self.size) - self.size, np.array([f for x in lists for f in x], np.int32)
        found = [np.unique(self.features(words)) for words in words_of]
        self.group = np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found])
        self.feature = np.concatenate([np.zeros(0, np.int32), *found])

    def least_groups(self) -> float:
        """Toxic groups that a feature needs to reach the least gain, in all folds or without one:
        k groups gain k times the logarithm of the share's inverse at most."""
        ratios = [1.0]
        for without in [None, *range(FOLDS)]:
            use = self.group_fold != without if without is not None else np.ones(len(self.group_toxic), bool)
            p = (use & self.group_toxic).sum()
            ratios.append(use.sum() / p if p else 1.0)
        return LEAST_GAIN / max(np.log(max(ratios)), 1e-9)

    def features(self, words: np.ndarray) -> np.ndarray:
        n = self.size[words]
        return self.ids[np.repeat(self.start[words] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def choose(self, without: int | None = None) -> np.ndarray:
        """Features more frequent in toxic texts (of all folds but `without`), and by more than
        chance: the log-likelihood ratio of their document frequencies is at least `LEAST_GAIN`
        nats, and twenty in 21 of their texts are toxic after the classes are brought to equal size."""
        use = np.ones(len(self.group_toxic), bool) if without is None else self.group_fold != without
        p, n = (use & self.group_toxic).sum(), (use & ~self.group_toxic).sum()
        if not p or not n:
            return np.zeros(0, np.int64)
        count = lambda groups: np.bincount(self.feature[groups[self.group]], minlength=len(self.names))
        k, m = count(use & self.group_toxic), count(use & ~self.group_toxic)
        at = np.flatnonzero(k)
        k, m = k[at], m[at]
        gain = k * np.log(k / (k + m) * (p + n) / p) + m * np.log(np.maximum(m, 1) / (k + m) * (p + n) / n)
        good = (gain >= LEAST_GAIN) & (k / p >= 20 * m / n)
        return at[good][np.argsort(-gain[good], kind="stable")]

    def values(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse (text, column, value) of the chosen features, of `ANY` and of `MORE` after them."""
        column = np.full(len(self.names), -1)
        column[chosen] = np.arange(len(chosen))
        good = column[self.ids] >= 0
        hit = np.bincount(np.repeat(np.arange(len(self.size)), self.size), good, len(self.size)) > 0
        words, text = self.flat[hit[self.flat]], self.text[hit[self.flat]]
        cols = column[self.features(words)]
        rows = np.repeat(text.astype(np.int64), self.size[words])[cols >= 0]
        cell, count = np.unique(rows * (len(chosen) + 2) + cols[cols >= 0], return_counts=True)
        own, n = np.unique(text, return_counts=True)
        more = n > 1
        rows, cols = np.concatenate((cell // (len(chosen) + 2), own, own[more])), np.concatenate((cell % (len(chosen) + 2), np.full(len(own), len(chosen)), np.full(more.sum(), len(chosen) + 1)))
        return rows, cols, np.log1p(np.concatenate((count, n, n[more] - 1)))


def likelihood(w: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood of grades `y`, and its gradients by `w` and `c`. Features are sparse:
    text rows[i] has value vals[i] in feature cols[i]. `c` holds the first threshold and the logs of
    the gaps to the next ones, so that thresholds stay ordered."""
    grades, at = len(c), np.arange(len(y))
    cuts = np.cumsum(np.concatenate((c[:1], np.exp(c[1:]))))
    eta = np.bincount(rows, vals * w[cols], len(y))
    p = np.column_stack([np.ones(len(y)), 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts, -40, 40))), np.zeros(len(y))])
    like = np.maximum(p[at, y] - p[at, y + 1], 1e-12)
    slope = p * (1 - p)
    g_eta = (slope[at, y] - slope[at, y + 1]) / like * mass
    g_cut = np.array([((y + 1 == k) * slope[:, k] / like - (y == k) * slope[:, k] / like) @ mass for k in range(1, grades + 1)])
    g_c = np.concatenate(([g_cut.sum()], [g_cut[k:].sum() * np.exp(c[k]) for k in range(1, grades)]))
    return float(np.log(like) @ mass), np.bincount(cols, vals * g_eta[rows], len(w)), g_c


def ascend(cells: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, y: np.ndarray, grades: int, steps: int = 600, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of `n` columns and thresholds, by gradient ascent (Adam) on the penalised likelihood
    of the grades, toxic texts (y > 0) and others weighing the same in all."""
    mass = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    w, c = np.full(n, 0.5), np.array([2.0, *[0.0] * (grades - 1)])
    m, v = np.zeros(n + grades), np.zeros(n + grades)
    for step in range(1, steps + 1):
        _, g_w, g_c = likelihood(w, c, *cells, y, mass)
        g = np.concatenate((g_w - decay * w, g_c))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, c = w + move[:n], c + move[n:]
    return w, np.cumsum(np.concatenate((c[:1], np.exp(c[1:]))))


def cross_fitted(sample: Sample) -> np.ndarray:
    """A score for each text from a two-grade model whose features and weights come from the other
    folds alone; 0 where these choose no feature."""
    out = np.zeros(len(sample.toxic))
    for k in range(FOLDS):
        chosen = sample.choose(without=k)
        if len(chosen):
            rows, cols, vals = sample.values(chosen)
            learn = sample.fold != k
            place = np.cumsum(learn) - 1
            own = learn[rows]
            w, _ = ascend((place[rows[own]], cols[own], vals[own]), len(chosen) + 2, sample.toxic[learn].astype(int), 1, steps=200)
            score = np.bincount(rows, vals * w[cols], len(out))
            out[~learn] = score[~learn]
    return out


def fit(texts: list[str | None], toxic: list[bool]) -> Model:
    """The model of `GRADES` grades above 0. Without both kinds of label, or without features,
    nothing is toxic."""
    sample = Sample(texts, toxic)
    chosen = sample.choose()
    if not len(chosen):
        return Model({}, [4.0 + k for k in range(GRADES)])
    scores, y = cross_fitted(sample), np.zeros(len(texts), int)
    thirds = np.quantile(scores[sample.toxic], [(k + 1) / GRADES for k in range(GRADES - 1)])
    y[sample.toxic] = 1 + np.searchsorted(thirds, scores[sample.toxic], side="left")
    w, cuts = ascend(sample.values(chosen), len(chosen) + 2, y, GRADES)
    return Model(dict(zip([*(sample.names[f] for f in chosen), ANY, MORE], map(float, w), strict=True)), list(map(float, cuts)))


def train(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> Model:
    """Fit on labelled documents: of each class, the `max_rows` with the smallest id hashes.
    Null labels are left out; of a document labelled twice the highest label counts."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = [
        r
        for kind in (0, 1)
        for r in docs.select("doc_id", "text")
        .join(marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows[kind]).select("doc_id"), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        .limit(max_rows[kind])
        .collect()
        for r in [(r["text"], bool(kind))]
    ]
    return fit([t for t, _ in rows], [x for _, x in rows])


def grade(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with a struct column: severity (expected grade, 0 to 3), grade (the most grades with
    probability of a half or more), p_toxic, toxic (p_toxic >= 0.5).

    Null, empty and wordless texts have no features and are not toxic; texts of any length are
    taken whole; repeated rows each get their grade; no rows give none. Where `docs` has a column
    named `out`, the new one gets underscores before its name; it comes last."""
    ship(docs.sparkSession)

    @F.pandas_udf("severity double, grade int, p_toxic double, toxic boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for part in parts:
            p = np.array([model.severity(scorer.eta(t)) for t in part]).reshape(-1, len(model.cuts))
            yield pd.DataFrame({"severity": p.sum(1), "grade": (p >= 0.5).sum(1).astype("int32"), "p_toxic": p[:, 0], "toxic": p[:, 0] >= 0.5})

    return docs.withColumn(free_name(docs, out), run(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the toxic ones."""
    graded = grade(docs, train(docs, labels))
    out = graded.columns[-1]
    return graded.where(~F.col(f"{out}.toxic")).drop(out)
