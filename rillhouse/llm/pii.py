"""Personal data: base patterns, and a semi-Markov conditional random field over spans.

Base spans are found by four patterns with checks. The method looks at islands: runs of
space-separated pieces with a digit or an at sign. An island is cut in tokens, and a semi-Markov
model scores whole candidate segments: features describe the segment (its shape, digits,
separators, checksum, neighbours), a weight vector for each type scores it, and a dynamic program
over segments of at most `LONGEST` tokens finds the segmentation of highest score, boundaries and
types together. The weights are trained by the conditional likelihood of the base spans in a
bounded sample of islands, with the same program in its sum form.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below, free_name, hash_bounds, ship

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. The tail of an address is looked for first, as texts rarely
#: hold one; what stands before it is then taken from the left.
_tail = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile("[0-9]")
_mark, _edge = re.compile("[0-9@]"), re.compile(r"\s")
_tokens = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
#: A segment's most tokens; the most tokens of an island that training takes; and how many tokens'
#: segments are scored at a time. The program runs over an island as a whole, however long.
LONGEST, ISLAND, STRETCH = 16, 256, 2048
#: The most characters of an island that training takes.
ISLAND_CHARS = 4096
#: Documents whose islands train the model at most: the smallest id hashes of those with a digit
#: or an at sign; and the islands used of them.
SAMPLE_DOCS, SAMPLE_ISLANDS = 1500, 600
#: By how much an added segment must beat being no entity, in log odds.
MARGIN = 2.0

Span = tuple[int, int, int]  # kind, start, end
_SPANS = "array<struct<kind: int, start: int, end: int>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(_digit.findall(text))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    out: list[Span] = []
    last = 0
    if "@" in text:
        for m in _tail.finditer(text):
            # the run of local characters before the sign, no further back than the last match
            at = m.start()
            low = at
            while low > last:
                step = max(last, low - 64)
                run = _local.search(text[step:low])
                if run is None:
                    break
                low = step + run.start()
                if low > step:
                    break
            if low < at:
                out.append((0, low, m.end()))
                last = m.end()
    out += [(1, m.start(), m.end()) for m in _ip.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m.group().split("."))]
    for m in _card.finditer(text):
        d = only_digits(m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _phone.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of pieces with a digit or an at sign, single spaces between them, in one pass."""
    at, m = 0, _mark.search(text)
    while m:
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        while True:
            gap = _edge.search(text, m.end())
            at = gap.start() if gap else len(text)
            m = _mark.search(text, at)
            if not m or text[at] != " " or _edge.search(text, at + 1, m.start()):
                break
        yield start, at


_FEATURES = 26
_PART = re.compile("[0-9]{1,3}")
_WORD = np.zeros(128, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def four_bytes(text: str) -> bool:
    """Four numbers of one to three digits, at most 255, with dots between them. Other digits than
    0 to 9 (raised, circled, of other scripts) make no number."""
    parts = text.split(".")
    return len(parts) == 4 and all(_PART.fullmatch(p) and int(p) <= 255 for p in parts)


def _upto(mask: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(mask)))


class _Stretch:
    """Running counts over the characters of a part of an island: the features of all its segments
    are differences of them."""

    def __init__(self, island: str, low: int, high: int):
        """Segments lie between `low` and `high`; a character on either side is looked at too."""
        self.low, self.end = max(0, low - 1), len(island)
        self.text = text = island[self.low : high + 1]
        n = len(text)
        code = np.fromiter(map(ord, text), np.int64, n)
        small = np.minimum(code, 127)
        self.digit, self.alnum = (code >= 48) & (code <= 57), _WORD[small]
        alpha, plain = self.alnum & ~self.digit, self.alnum.copy()
        for i in np.flatnonzero(code > 127).tolist():
            alpha[i], self.alnum[i] = text[i].isalpha(), text[i].isalnum()
        is_ = {c: code == ord(c) for c in "@._%+-/= ()"}
        self.code, self.is_, self.upto = code, is_, {c: _upto(is_[c]) for c in "@.+() -"}
        self.digits, self.letters = _upto(self.digit), _upto(alpha)
        self.odd = _upto(~(plain | np.logical_or.reduce([is_[c] for c in "@._%+ ()-"])))
        # the next at sign and the next character that is no dot from each place on; the last before
        places, dot = np.arange(n), is_["."]
        ahead = lambda mask: np.append(np.minimum.accumulate(np.where(mask, places, n)[::-1])[::-1], n)
        self.next_at, self.next_other = ahead(is_["@"]), ahead(~dot)
        self.last_other = np.maximum.accumulate(np.concatenate(([-1], np.where(~dot, places, -1))))
        # checksums: sums of the digits at even and at odd places, as they are and doubled
        d = code[self.digit] - 48
        even, twice = np.arange(len(d)) % 2 == 0, 2 * d - 9 * (d > 4)
        self.once = np.stack([_upto(d * even), _upto(d * ~even)])
        self.twice = np.stack([_upto(twice * even), _upto(twice * ~even)])

    def luhn(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = self.digits[a], self.digits[b]
        last = (q - 1) % 2  # the last digit and every other one before it stand as they are
        return (self.once[last, q] - self.once[last, p] + self.twice[1 - last, q] - self.twice[1 - last, p]) % 10 == 0

    def features(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Features of the whole segments from `a` to `b` (places in the island)."""
        a, b = a - self.low, b - self.low
        n, x, size = b - a, np.zeros((len(a), _FEATURES)), len(self.text)
        count = lambda sums: sums[b] - sums[a]
        d, letters, signs, dots, blanks = count(self.digits), count(self.letters), count(self.upto["@"]), count(self.upto["."]), count(self.upto[" "])
        x[:, 0] = 1
        x[:, 1] = np.minimum(n, 40) / 10
        x[:, 2] = d / n
        x[:, 3] = letters / n
        x[:, 4] = signs == 1
        # a dot after the first at sign that is neither first nor last there
        begin, end = self.next_other[np.minimum(self.next_at[a] + 1, size)], self.last_other[b]
        x[:, 5] = (signs > 0) & (end > begin) & (self.upto["."][np.maximum(end, 0)] > self.upto["."][np.minimum(begin, size)])
        for k in np.flatnonzero((dots == 3) & (d + 3 == n) & (n <= 15)).tolist():
            x[k, 6] = four_bytes(self.text[a[k] : b[k]])
        x[:, 7] = self.is_["+"][a]
        x[:, 8] = (d >= 13) & (d <= 19)
        x[:, 9] = (d >= 13) & (d <= 19) & self.luhn(a, b)
        x[:, 10] = (d >= 9) & (d <= 15)
        x[:, 11] = (count(self.upto["("]) == 1) & (count(self.upto[")"]) == 1)
        x[:, 12] = blanks / 4
        x[:, 13] = count(self.upto["-"]) / 4
        x[:, 14] = dots / 4
        before, after = np.maximum(a - 1, 0), np.minimum(b, size - 1)
        x[:, 15] = (a > 0) & (self.alnum[before] | np.logical_or.reduce([self.is_[c][before] for c in "@._%+-/="]))
        x[:, 16] = (b < size) & (self.alnum[after] | self.is_["@"][after])
        x[:, 17] = d == n
        x[:, 18] = d < 9
        x[:, 19] = d > 19
        x[:, 20] = (letters > 0) & (signs == 0)
        x[:, 21] = ~(self.alnum[a] | self.is_["+"][a] | self.is_["("][a])
        x[:, 22] = ~self.alnum[b - 1]
        x[:, 23] = count(self.odd) > 0
        x[:, 24] = (signs > 0) & (blanks > 0)
        x[:, 25] = self.upto["+"][b] > self.upto["+"][a + 1]
        return x


def candidates(island: str, offsets: Sequence[int], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate entity segments that start in a range of tokens (they may end beyond it), as first
    and past-the-end tokens, and their features: they start and end off spaces and hold an at sign
    or four digits."""
    n = len(offsets) - 1
    if last <= first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, _FEATURES))
    stop = min(n, last - 1 + LONGEST)
    own = np.array(offsets[first : stop + 1], dtype=np.int64)
    stretch = _Stretch(island, int(own[0]), int(own[-1]))
    i = np.repeat(np.arange(last - first), LONGEST)
    j = i + np.tile(np.arange(1, LONGEST + 1), last - first)
    i, j = i[j < len(own)], j[j < len(own)]
    a, b = own[i], own[j]
    p, q, blank = a - stretch.low, b - stretch.low, stretch.is_[" "]
    some = (stretch.upto["@"][q] > stretch.upto["@"][p]) | (stretch.digits[q] - stretch.digits[p] >= 4)
    kept = (b - a >= 6) & some & ~blank[p] & ~blank[q - 1]
    i, j, a, b = i[kept], j[kept], a[kept], b[kept]
    return i + first, j + first, stretch.features(a, b)


def segments(island: str, offsets: Sequence[int]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """All candidate segments of an island (token ranges), and their features."""
    i, j, x = candidates(island, offsets, 0, len(offsets) - 1)
    return list(zip(i.tolist(), j.tolist(), strict=True)), x


@dataclass
class Model:
    weights: np.ndarray  # a row for each type; being no entity scores 0 for each token

    def decode(self, island: str) -> list[tuple[int, int, int, float]]:
        """Entities (kind, start, end, score) of the best segmentation of an island. Segments are
        scored in stretches of `STRETCH` starts; those that end beyond a stretch wait in `ends`."""
        offsets = array("q", [0])
        offsets.extend(m.end() for m in _tokens.finditer(island))
        n = len(offsets) - 1
        value = array("d", bytes(8 * (n + 1)))
        # the best segment that ends at each token: its tokens (0: none), kind and score
        size, kind, score = array("b", bytes(n + 1)), array("b", bytes(n + 1)), array("d", bytes(8 * (n + 1)))
        ends: dict[int, list[tuple[int, int, float]]] = {}
        for at in range(0, n, STRETCH):
            stop = min(n, at + STRETCH)
            begin, end, x = candidates(island, offsets, at, stop)
            scores = x @ self.weights.T
            kinds, best = scores.argmax(1), scores.max(1)
            hit = best > 0  # others lose against tokens that are no entity
            for i, j, k, v in zip(begin[hit].tolist(), end[hit].tolist(), kinds[hit].tolist(), best[hit].tolist(), strict=True):
                ends.setdefault(j, []).append((i, k, v))
            for j in range(at + 1, stop + 1):
                value[j] = value[j - 1]
                for i, k, v in ends.pop(j, ()):
                    if value[i] + v > value[j]:
                        value[j], size[j], kind[j], score[j] = value[i] + v, j - i, k, v
        out, j = [], n
        while j:
            if size[j]:
                out.append((kind[j], offsets[j - size[j]], offsets[j], score[j]))
            j -= size[j] or 1
        return out[::-1]


def likelihood_gradient(weights: np.ndarray, found: list[tuple[int, int]], x: np.ndarray, n: int, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Gradient of the log-likelihood of the gold segments: observed minus expected features, the
    expectation by the forward and backward sums over segmentations of n tokens."""
    scores = x @ weights.T
    top = np.logaddexp.reduce(scores, axis=1)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for s, (i, j) in enumerate(found):
        by_end.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(fwd[found[s][0]] + top[s] for s in by_end.get(j, ()))])
    for i in range(n - 1, -1, -1):
        bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[found[s][1]] + top[s] for s in by_start.get(i, ()))])
    start, end = np.array([i for i, _ in found]), np.array([j for _, j in found])
    p = np.exp(scores + (fwd[start] + bwd[end] - fwd[n])[:, None])
    seen = np.zeros_like(p)
    for s, span in enumerate(found):
        if span in gold:
            seen[s, gold[span]] = 1
    return (seen - p).T @ x


def training_islands(text: str | None) -> Iterator[tuple[str, list[Span]]]:
    """Islands of a text that are short enough to train on, with the base spans in them."""
    base = base_spans(text or "")
    for start, end in islands(text or ""):
        own = (text or "")[start:end]
        if len(own) <= ISLAND_CHARS and sum(1 for _ in _tokens.finditer(own)) < ISLAND:
            yield own, [(k, a - start, b - start) for k, a, b in base if a >= start and b <= end]


def fit(islands: list[tuple[str, list[Span]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Model:
    """Train on islands by AdaGrad, their base spans as gold. Islands whose gold is no candidate
    segment are passed over. Without islands nothing is added."""
    weights, seen = np.zeros((len(KINDS), _FEATURES)), np.full((len(KINDS), _FEATURES), 1e-6)
    weights[:, 0] = -4
    cases = []
    for own, base in islands:
        offsets = [0, *(k.end() for k in _tokens.finditer(own))]
        found, x = segments(own, offsets)
        place = {o: i for i, o in enumerate(offsets)}
        gold = {(place.get(a), place.get(b)): k for k, a, b in base}
        if found and all(g in set(found) for g in gold):
            cases.append((found, x, len(offsets) - 1, gold))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for c in rng.permutation(len(cases)):
            g = likelihood_gradient(weights, *cases[c]) - decay * weights
            seen += g * g
            weights += rate * g / np.sqrt(seen)
    return Model(weights)


def well_formed(kind: int, span: str) -> bool:
    """Whether an added span has what every entity of its type must have."""
    d = only_digits(span)
    if kind == 0:
        return span.count("@") == 1
    if kind == 1:
        return four_bytes(span)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def find(text: str | None, model: Model, base: list[Span] | None = None) -> list[Span]:
    """Base spans (those given, or found here), and the model's segments that overlap none of them;
    by kind, then start."""
    text = text or ""
    base = base_spans(text) if base is None else base
    starts, ends = [], []  # base spans merged, so that these are in order
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    added = []
    for start, end in islands(text):
        if end - start < 6:
            continue
        for k, a, b, score in model.decode(text[start:end]):
            a, b = a + start, b + start
            if score > MARGIN and bisect_right(ends, a) == bisect_left(starts, b) and well_formed(k, text[a:b]):
                added.append((k, a, b))
    return sorted(base + added)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a bounded sample of the documents with four digits in a row or an at sign: those with
    the smallest id hashes, about `sample_docs`. Their islands are found where the texts are; only
    `SAMPLE_ISLANDS` distinct ones, each of `ISLAND_CHARS` characters at most, come to the driver."""
    ship(docs.sparkSession)
    h, digits = F.xxhash64(F.col(doc_id)), F.col(text).rlike("[0-9]{4}|@")
    bounds = hash_bounds(docs.where(digits).select(h.alias("h"), F.lit(0).alias("kind")), sample_docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(x, n, own, [{"kind": k, "start": a, "end": b} for k, a, b in base]) for x, t in zip(batch["h"], batch["text"], strict=True) for n, (own, base) in enumerate(training_islands(t))]
            yield pd.DataFrame(rows, columns=["h", "n", "island", "gold"])

    chosen = docs.where(below(h, F.lit(0), bounds)).where(digits).select(h.alias("h"), F.col(text).alias("text"))
    found = chosen.mapInPandas(cut, f"h long, n int, island string, gold {_SPANS}").groupBy("island").agg(F.min(F.struct("h", "n")).alias("at"), F.min("gold").alias("gold"))
    rows = found.orderBy("at", "island").limit(SAMPLE_ISLANDS).select("island", "gold").collect()
    return fit([(r[0], [(g["kind"], g["start"], g["end"]) for g in r[1]]) for r in rows])


def scan(docs: DataFrame, model: Model, text: str = "text", out: str = "pii") -> DataFrame:
    """`docs` with a struct column: base and spans, arrays of (kind, start, end) in code points, end
    exclusive, by kind (0 email, 1 ip, 2 card, 3 phone), then start.

    Null and empty texts have none; texts and islands of any length are taken whole; repeated rows
    each get theirs; no rows give none. Where `docs` has a column named `out`, the new one gets
    underscores before its name; it comes last."""
    ship(docs.sparkSession)
    @F.pandas_udf(f"base {_SPANS}, spans {_SPANS}")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packed = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for part in parts:
            base = [base_spans(t or "") for t in part]
            yield pd.DataFrame({"base": list(map(packed, base)), "spans": [packed(find(t, model, b)) for t, b in zip(part, base, strict=True)]})

    return docs.withColumn(free_name(docs, out), run(F.col(text)))


def redact(docs: DataFrame, model: Model, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """`docs` with each span, or union of overlapping ones, replaced by its type in angle brackets,
    and `n_chars` counted anew. Null texts stay null and keep their count; empty texts stay empty;
    repeated rows stay; no rows give none; other columns are left as they are, whatever their names."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if t is None else replaced(t, find(t, model)) for t in part], dtype=object)

    changed = docs.withColumn(text, run(F.col(text)))
    if n_chars in docs.columns:
        changed = changed.withColumn(n_chars, F.when(F.col(text).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return changed.select(*docs.columns)


def replaced(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
