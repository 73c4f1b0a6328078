"""Secret scan: base patterns, and character Markov models compared by log-likelihood ratio.

Base spans are found by three patterns (assignments, access keys, hex strings). The method adds
long tokens that read like random strings: two first-order Markov models over characters, one of
random strings and one of ordinary identifiers and words, give each token the mean log-likelihood
ratio of its transitions; above a threshold it is a secret. Both models are counted by Spark from
labelled samples. Everything here is DataFrame functions: no Python on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import below, bind, free_name, hash_bounds, running, whole_text, word_list

#: The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: What the Markov models look at: runs of these characters, this long at least, without the parts
#: that base spans cover.
SHORTEST = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Mean log-likelihood ratio of a transition, in nats, above which a token is a secret.
THRESHOLD = 0.5
#: Documents whose words and base spans train the models: those with the smallest id hashes, of
#: those with base spans and of all.
SAMPLE_DOCS = 1000
_SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches as (start, kind, end, value), in code points: the
    pieces between matches and the matches' own lengths, summed up."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(value_group + 1))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))

    def placed(m: Column) -> Column:
        lengths = F.transform(m, lambda x: F.length(x))
        ends = running(F.zip_with(F.slice(between, 1, F.size(m)), lengths, lambda a, b: a + b), F.lit(0), lambda a, b: a + b)
        parts = F.arrays_zip(ends.alias("end"), lengths.alias("n"), (value if value_group else m).alias("value"))
        return F.transform(parts, lambda p: F.struct((p["end"] - p["n"]).alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), p["value"].alias("value")))

    return bind(found, placed)


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans_of_kinds(text: Column) -> list[Column]:
    """Base spans of each kind, by start. Cheap tests go first: a pattern runs only over texts that
    hold what each of its matches must hold."""
    assign = F.when(_keyed(text), F.filter(_spans(text, ASSIGN, 0, 1), lambda s: F.length(s["value"]) >= 6)).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1)).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(_none())
    return [assign, access, hexes]


def _keyed(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(k)) for k in ("passw", "secret", "token", "api_key", "apikey")])


def base_spans(text: Column) -> Column:
    """Base spans of a non-null text, by start, then kind."""
    return F.array_sort(F.concat(*_spans_of_kinds(text)))


def marked(text: Column) -> Column:
    """True for texts that a base pattern matches somewhere."""
    return (_keyed(text) & text.rlike(ASSIGN)) | (F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS)) | text.rlike(HEX)


def labelled_samples(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random): labelled strings for training. Values of base spans are random strings
    (those that only dots, dashes or letters make up are not taken); words of documents without a
    base span are ordinary. Both come from the `sample_docs` documents with the smallest id hashes:
    hashes are bounded first, then only texts below a bound are ordered."""
    slim = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(doc_id)).alias("h"), whole_text(text).alias("t"))
    bounds = hash_bounds(slim.select("h", marked(F.col("t")).alias("kind")), sample_docs)
    low = slim.where(below(F.col("h"), marked(F.col("t")), bounds)).withColumn("kind", marked(F.col("t")))
    first = lambda kind: low.where(F.col("kind") == kind).orderBy("h", "d", "t").limit(sample_docs)
    random = first(True).select(F.explode(base_spans(F.col("t"))["value"]).alias("value")).where(F.col("value").rlike("[0-9]")).distinct()
    plain = first(False).select(F.explode(word_list(F.col("t"))).alias("value")).distinct()
    return random.select("value", F.lit(True).alias("random")).unionByName(plain.select("value", F.lit(False).alias("random")))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each transition between two ASCII characters:
    128 * 128 values at [128 * from + to]. Counts are smoothed over the 96 printable characters
    and line ends; letters of random strings count in both cases' shapes as they stand. Without
    samples of one kind its model is uniform."""
    chars = F.split(F.regexp_replace("value", r"[^\x20-\x7E]", ""), "")
    codes = samples.select("random", F.filter(F.transform(chars, lambda c: F.ascii(c)), lambda c: c > 0).alias("c")).where(F.size("c") > 1)
    pairs = codes.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.element_at("c", i) * 128 + F.element_at("c", i + 1))).alias("pair"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in pairs.groupBy("random", "pair").count().collect():  # 2 * 96 * 96 rows at most
        counts[r["random"]][r["pair"]] = r["count"]
    logs = {}
    for kind, found in counts.items():
        total: dict[int, int] = {}
        for pair, n in found.items():
            total[pair // 128] = total.get(pair // 128, 0) + n
        logs[kind] = [math.log((found.get(p, 0) + smoothing) / (total.get(p // 128, 0) + 96 * smoothing)) for p in range(128 * 128)]
    return [a - b for a, b in zip(logs[True], logs[False], strict=True)]


def likelihood_ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of an ASCII string of two characters or more, in
    one pass over its characters."""
    table = F.lit(np.array(model))  # one literal, not one a cell
    codes = F.filter(F.transform(F.split(value, ""), lambda c: F.ascii(c)), lambda c: c > 0)
    step = lambda acc, c: F.struct(c.alias("from"), (acc["sum"] + F.coalesce(F.get(table, acc["from"] * 128 + c), F.lit(0.0))).alias("sum"))
    # the first character comes from none: its cell lies outside the table
    start = F.struct(F.lit(len(model)).alias("from"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"]) / (F.length(value) - 1)


def _first_index(spans: Column, test: Callable[[Column], Column]) -> Column:
    """How many elements of a sorted array come before the first for which `test` holds (it holds
    from there on), by halving."""
    rounds = F.ceil(F.log2(F.size(spans) + 1)).cast("int")

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        here = (acc["lo"] < acc["hi"]) & test(F.get(spans, mid))
        low = F.when(here | (acc["lo"] >= acc["hi"]), acc["lo"]).otherwise(mid + 1)
        return F.struct(low.alias("lo"), F.when(here, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), rounds), start, halve, lambda acc: acc["lo"])


def _overlapping(spans: Column, run: Column) -> Column:
    """Those of one kind's spans, which never overlap each other, that overlap a run."""
    first = _first_index(spans, lambda s: s["end"] > run["start"])
    return bind(first, lambda a: F.slice(spans, a + 1, F.greatest(F.lit(0), _first_index(spans, lambda s: s["start"] >= run["end"]) - a)))


def uncovered(run: Column, kinds: list[Column]) -> Column:
    """The parts of a run (start, kind, end, value) that no base span covers, of the least token
    length. `kinds` holds each kind's base spans by start; spans of different kinds may overlap."""
    covers = F.array_sort(F.concat(*[_overlapping(k, run) for k in kinds]))

    def parts(cover: Column, chars: Column) -> Column:
        starts = F.concat(F.array(run["start"]), running(F.transform(cover, lambda s: s["end"]), run["start"], F.greatest))
        ends = F.concat(F.transform(cover, lambda s: s["start"]), F.array(run["end"]))
        long = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: p["b"] - p["a"] >= SHORTEST)
        text = lambda p: F.array_join(F.slice(chars, p["a"] - run["start"] + 1, p["b"] - p["a"]), "")
        return F.transform(long, lambda p: F.struct(p["a"].alias("start"), run["kind"].alias("kind"), p["b"].alias("end"), text(p).alias("value")))

    return bind(covers, lambda c: F.when(F.size(c) == 0, F.array(run)).otherwise(bind(F.split(run["value"], ""), lambda chars: parts(c, chars))))


def scan(docs: DataFrame, model: list[float], text: str = "text", out: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with a struct column: base and spans, arrays of (start, kind, end, value) in code
    points, end exclusive, by start, then kind (0 assign, 1 access, 2 hex, 3 markov). A Markov
    span never overlaps a base span.

    Null and blank texts have none; repeated rows each get theirs; no rows give none; a text or a
    token of any length takes time in proportion. Where `docs` has a column named `out`, the new
    one gets underscores before its name; it comes last."""
    whole, kinds, found = free_name(docs, "whole"), free_name(docs, "kinds"), free_name(docs, "found")
    own, out = docs.columns, free_name(docs, out)
    docs = docs.withColumn(whole, whole_text(text))
    docs = docs.withColumn(kinds, F.struct(*[k.alias(KINDS[i]) for i, k in enumerate(_spans_of_kinds(F.col(whole)))]))
    by_kind = [F.col(f"{kinds}.{k}") for k in KINDS[:3]]
    tokens = F.when(F.col(whole).rlike(TOKEN), _spans(F.col(whole), TOKEN, 3)).otherwise(_none())
    parts = F.when(sum(map(F.size, by_kind), F.lit(0)) == 0, tokens).otherwise(F.flatten(F.transform(tokens, lambda s: uncovered(s, by_kind))))
    docs = docs.withColumn(found, F.filter(parts, lambda s: likelihood_ratio(s["value"], model) > threshold))
    spans = F.struct(F.array_sort(F.concat(*by_kind)).alias("base"), F.array_sort(F.concat(*by_kind, F.col(found))).alias("spans"))
    return docs.select(*own, spans.alias(out))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
