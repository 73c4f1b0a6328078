"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 3- and 4-byte windows of the lower-case UTF-8 text, word ends included, that
hold no space inside. Each is hashed to a row of an embedding table; a text is the average of its
rows, and a linear layer with softmax gives the language. Both are trained together by stochastic
gradient descent in numpy. A temperature fitted on texts kept from training calibrates the
probabilities, and a threshold on them marks predictions to reject.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, ship

#: Training documents: those with the smallest id hashes among the learnable ones; and so many of
#: each language at least, or all that it has, again those with the smallest id hashes.
MAX_DOCS, LANG_DOCS = 3000, 200
#: Languages learned at most, the most frequent ones; documents of those that are rare in the sample.
MAX_LANGS, RARE_DOCS = 1000, 20_000
#: Characters of a document that are learned from at most, in so many pieces from all over it.
EXCERPT, PIECES = 9600, 16
BUCKETS = 1 << 14
_CHUNK = 1 << 20  # bytes scored at a time
_letter = regex.compile(r"\p{L}").search  # letters alone: no number forms, no combining marks


def _clean_table() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    for c in range(ord("a"), ord("z") + 1):
        t[c] = c
    return t


_CLEAN = _clean_table()


def subwords(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(position, bucket) of each subword of lower-case UTF-8 bytes."""
    a = _CLEAN[np.frombuffer(data, np.uint8)].astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h3 = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)
    ok3 = np.flatnonzero((a[1:-1] != 32))
    h4 = h3[:-1] * np.uint32(0x27D4EB2F) + a[3:] * np.uint32(0x165667B1)
    ok4 = np.flatnonzero((a[1:-2] != 32) & (a[2:-1] != 32))
    at = np.concatenate((ok3, ok4))
    h = np.concatenate((h3[ok3], h4[ok4]))
    return at, ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18)).astype(np.int64)


def prepare(text: str | None) -> bytes:
    return b" " + (text or "").lower().encode() + b" "


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # a row of class logits for each bucket: embedding times linear layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Raw logits of each text: a row for each, over all its subwords."""
        out = np.zeros((len(texts), len(self.langs)))
        group, size, first = [], 0, 0
        for i, t in enumerate(texts):
            group.append(prepare(t))
            size += len(group[-1])
            if size >= _CHUNK or i + 1 == len(texts):
                out[first : i + 1] = self._group(group)
                group, size, first = [], 0, i + 1
        return out

    def _group(self, parts: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(p) for p in parts])
        total, count = np.zeros((len(parts), len(self.langs))), np.zeros(len(parts))
        data = b"".join(parts)  # parts start and end with a space, so no subword spans two
        for at in range(0, len(data), _CHUNK):
            where, bucket = subwords(data[at : at + _CHUNK + 3])
            own = where < _CHUNK
            doc = np.searchsorted(ends, where[own] + at, side="right")
            count += np.bincount(doc, minlength=len(parts))
            rows = self.logits[bucket[own]]
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc, rows[:, k], len(parts))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, probability); `und` and 0 for null, letterless texts or an empty model."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.scores(texts) / self.temperature)
        best = p.argmax(1)
        known = np.array([bool(t) and _letter(t) is not None for t in texts], bool)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, p.max(1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return e / e.sum(1, keepdims=True) if len(z) else z


def fit(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 4, batch: int = 64, rate: float = 4.0, seed: int = 7) -> Model:
    """Train on windows of 30 to 600 bytes of the texts, so that short texts are learned too."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    data, y = [prepare(t) for t in texts], np.array([names.index(x) for x in langs])
    order = rng.permutation(len(data))
    held, learn = order[: len(data) // 10], order[len(data) // 10 :]
    table, layer, bias = rng.normal(0, 0.1, (BUCKETS, dim)), np.zeros((dim, len(names))), np.zeros(len(names))

    def window(i: int) -> np.ndarray:
        n = int(rng.integers(30, 600))
        at = int(rng.integers(0, max(1, len(data[i]) - n)))
        return subwords(data[i][at : at + n])[1]

    steps, step = max(1, epochs * -(-len(learn) // batch)), 0
    for _ in range(epochs):
        mixed = rng.permutation(learn)
        for k in range(0, len(mixed), batch):
            own = mixed[k : k + batch]
            bags = [window(i) for i in own]
            n = np.array([len(b) for b in bags])
            ids, doc = np.concatenate(bags), np.repeat(np.arange(len(own)), n)
            mean = np.zeros((len(own), dim))
            np.add.at(mean, doc, table[ids])
            mean /= np.maximum(n, 1)[:, None]
            g = softmax(mean @ layer + bias)
            g[np.arange(len(own)), y[own]] -= 1
            g /= len(own)
            down = rate * (1 - step / steps)
            into = g @ layer.T / np.maximum(n, 1)[:, None]
            layer -= down * mean.T @ g
            bias -= down * g.sum(0) * 0.1
            np.add.at(table, ids, -down * len(own) * into[doc])
            step += 1
    model = Model(names, (table @ layer).astype(np.float32), bias)
    if len(held):
        z = model.scores([data[i].decode(errors="ignore") for i in held])
        nll = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in np.geomspace(0.05, 20, 60)}
        model.temperature = float(min(nll, key=nll.get))
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y[held]]
        model.threshold = float(min(0.5, np.quantile(right, 0.005))) if len(right) else 0.0
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is held out as well."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def excerpt(text: str) -> str:
    """A text of at most `EXCERPT` characters whole; of a longer one pieces from all over it, about as
    much in all."""
    if len(text) <= EXCERPT:
        return text
    step = len(text) / PIECES
    return " ".join(text[int(k * step) : int(k * step) + EXCERPT // PIECES] for k in range(PIECES))


def sample(docs: DataFrame, max_docs: int = MAX_DOCS, lang_docs: int = LANG_DOCS, max_langs: int = MAX_LANGS, rare_docs: int = RARE_DOCS) -> list[tuple[str, str]]:
    """(excerpt, lang) of the training documents: of those not held out, text and lang not null, of
    the `max_langs` languages with the most documents: the `max_docs` of smallest id hashes, and for each
    language that has fewer than `lang_docs` of these its own of smallest hashes, as many or all it has;
    where that were over `rare_docs` in all, fewer of each. Hashes are bounded first, so that only about
    as many texts as are asked for are ordered; a count for each of these languages and excerpts come
    to the driver."""
    spark, order = docs.sparkSession, ["h", "doc_id", "text", "lang"]
    ship(spark)

    @F.pandas_udf("string")
    def cut(part: pd.Series) -> pd.Series:
        return part.map(excerpt)

    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not counts:
        return []

    def lowest(wanted: dict[str, tuple[int, int]]) -> DataFrame:
        """Rows of the languages below a bound on their hashes, for k of n rows: about as many, and
        hardly ever fewer."""
        share = lambda k, n: min(1.0, (k + 6 * k**0.5 + 10) / n)
        top = lambda x: (1 << 63) - 1 if x >= 1 else int((2 * x - 1) * (1 << 63))
        bounds = spark.createDataFrame([(lang, top(share(k, n))) for lang, (k, n) in wanted.items()], "lang string, bound long")
        # at most `max_langs` bounds
        return rows.join(F.broadcast(bounds), "lang").where("h <= bound").select("h", "doc_id", cut("text").alias("text"), "lang")

    all_ = sum(counts.values())
    found = lowest(dict.fromkeys(counts, (max_docs, all_))).orderBy(*order).limit(max_docs).collect()
    own = Counter(r["lang"] for r in found)
    rare = [k for k, n in counts.items() if own[k] < min(lang_docs, n)]
    if rare:
        quota = min(lang_docs, max(1, rare_docs // len(rare)))
        place = F.row_number().over(Window.partitionBy("lang").orderBy(*order[:3]))
        more = lowest({k: (quota, counts[k]) for k in rare}).withColumn("n", place).where(F.col("n") <= quota).drop("n").collect()
        found = sorted([*(r for r in found if r["lang"] not in rare), *more], key=lambda r: (r["h"], r["doc_id"] or 0, r["text"], r["lang"]))
    return [(r["text"], r["lang"]) for r in found]


def train(docs: DataFrame, max_docs: int = MAX_DOCS, lang_docs: int = LANG_DOCS) -> Model:
    """Fit on the sample of the documents that may be learned from."""
    rows = sample(docs, max_docs, lang_docs)
    return fit([t for t, _ in rows], [k for _, k in rows])


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """`docs` with a struct column: lang_pred, score (calibrated probability, 0 to 1), rejected
    (score below the model's threshold, or `und`).

    Null texts and texts without a letter (Unicode category L) are `und` with score 0; texts of any
    length are averaged over all their subwords, a part at a time; repeated rows each get their
    row; no rows give none; without training rows all are `und`. Where `docs` has a column named
    `out`, the new one gets underscores before its name; it comes last."""
    ship(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            langs, p = model.predict(list(part))
            yield pd.DataFrame({"lang_pred": langs, "score": p, "rejected": (p < model.threshold) | (np.array(langs, object) == "und")})

    return docs.withColumn(free_name(docs, out), run(F.col(text)))
