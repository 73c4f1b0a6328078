"""The Jaccard join against all pairs."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from rillhouse.llm import jaccard


def plain_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain(rows, percent, k):
    """(doc_id, n_shingles, component_id) by comparing all pairs of rows (doc_id, text)."""
    sets = [plain_set(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def check(spark, rows, percent=85, k=4):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, g string, turns string").repartition(5)
    assert Counter(map(tuple, jaccard.similar_groups(docs, percent=percent, shingle=k).collect())) == plain(rows, percent, k)


def test_search_equals_counting():
    rng = np.random.default_rng(1)
    for n in range(60):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
        query = np.unique(rng.integers(0, 70, rng.integers(1, 50))).astype(np.uint64)
        for need in (1, 2, 5, 10, len(query)):
            want = sorted((i, len(np.intersect1d(s, query))) for i, s in enumerate(sets) if len(np.intersect1d(s, query)) >= need)
            assert sorted(jaccard.Index(sets).search(query, need)) == want
    assert jaccard.Index([]).search(query, 1) == []


def test_shingles_of_many_texts_equal_those_of_each():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB é\t\n 中") for _ in range(rng.choice([0, 1, 3, 20, 200]))) for _ in range(400)] + [None, "a b c d", "A  b\nc d ", "a b", "ab", "x" * 70000, "x" * 70001, "y " * 400_000]
    for k in (1, 4, 5):
        got = list(jaccard.shingle_sets(jaccard.pa.array(texts), k))
        known = {}
        for t, x in zip(texts, got, strict=True):
            assert np.array_equal(x, jaccard.shingles(t, k)) and len(x) == len(plain_set(t, k))
            # equal sets and none else have equal hashes
            assert known.setdefault(x.tobytes(), plain_set(t, k)) == plain_set(t, k)
        assert len(known) == len({frozenset(plain_set(t, k)) for t in texts})


def test_counts_of_frequent_shingles_are_bounded():
    rng, counter, all_ = np.random.default_rng(2), jaccard.Counter(50), Counter()
    for _ in range(200):
        part = np.concatenate((rng.integers(0, 8, 40), rng.integers(0, 1 << 40, 60))).astype(np.uint64)
        all_.update(part.tolist())
        counter.add(part)
        counter.settle()
    kept = dict(zip(counter.tokens.tolist(), counter.counts.tolist(), strict=True))
    for token, n in all_.items():
        assert n - sum(all_.values()) / 51 <= kept.get(token, 0) <= n


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for percent, k in ((85, 4), (80, 5)):
        assert Counter(map(tuple, jaccard.similar_groups(docs, percent=percent, shingle=k).collect())) == plain(rows, percent, k)


def near_copies(rng, n, words, edits, start):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        yield start + i, " ".join(own)


@pytest.mark.parametrize("block", [1_000_000, 900])
def test_groups_of_near_copies_rings_and_common_passages(spark, monkeypatch, block):
    """Groups whose rows link with each other only, with a pivot, or through rows in its ring; a
    passage that most rows share; sets at the very threshold."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(6)
    rows = [*near_copies(rng, 120, 60, 1, 0), *near_copies(rng, 120, 60, 3, 1000), *near_copies(rng, 60, 20, 1, 2000), *near_copies(rng, 60, 200, 8, 3000)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(4000 + i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 12)))) for i in range(150)]
    # a chain: each links with the next only
    chain = [f"c{i}" for i in range(400)]
    rows += [(5000 + i, " ".join(chain[i * 8 : i * 8 + 103])) for i in range(30)]
    # 17 of 20 shingles in common: just linked; 16 of 19 not
    rows += [(6000, " ".join(f"t{i}" for i in range(20))), (6001, " ".join(f"t{i}" for i in range(3, 23))), (6002, " ".join(f"u{i}" for i in range(23))), (6003, " ".join(f"u{i}" for i in range(20)))]
    rng.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (5, "ONE  two"), (6, "one two three four"), (None, "one two three four"), (None, "alone here"),
        (7, "É a b c d"), (8, "é a b c d"), (9, "x" * 70000), (10, "a " * 70000), (11, "A\n" * 50), (12, "one\x85two three\x1c four five"), (2**60 + 1, "big one big two"), (2**60 + 2, "big one big two"),
    ]
    check(spark, rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_groups(none).count() == 0


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    base = jaccard._mixed(np.arange(5000, dtype=np.uint64))
    for size in (0, 1, 3, 40, 63, 64, 65, 127, 128, 900, 1100, 3000):
        for other in (size, max(0, size - 1), int(size * 0.86), size // 2, 5):
            a, b = base[:size], np.sort(rng.permutation(base[: max(size, other)])[:other])
            differ = len(np.setxor1d(a, b))
            assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= differ and jaccard.apart(jaccard.sketch(b), jaccard.sketch(a)) <= differ
    sets = [np.sort(rng.permutation(base[k : k + 140])[: rng.integers(1, 140)]) for k in rng.integers(0, 600, 150)]
    for percent in (51, 85, 99):
        asks = rng.random(150) < 0.5
        got = jaccard.met(np.array([len(x) for x in sets]), asks, [jaccard.sketch(x) for x in sets], percent)
        for i, x in enumerate(sets):
            similar = any((asks[i] or asks[j]) and 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)) for j, y in enumerate(sets) if j != i)
            assert got[i] or not similar
    # unrelated sets of any size are told apart
    for n in (20, 60, 200, 1000, 20000):
        own = [jaccard._mixed(np.arange(k * n, (k + 1) * n, dtype=np.uint64)) for k in range(20)]
        assert jaccard.met(np.full(20, n), np.ones(20, bool), [jaccard.sketch(x) for x in own], 85).sum() == 0


def test_texts_that_share_shingles_by_chance_are_not_sent(spark, monkeypatch):
    rng, sent = random.Random(8), []
    # every text has a few of the same passages and is otherwise its own
    rows = [(i, " ".join(f"p{p} p{p}a p{p}b p{p}c " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(6)) for p in rng.sample(range(12), 5))) for i in range(120)]
    rows += list(near_copies(rng, 6, 60, 1, 1000))
    plainly = jaccard.shipped

    def counted(*args):
        out = jaccard.materialize(plainly(*args), "test-sent")
        sent.append(out.where("length(text) > 0").select("text").distinct().count())
        return out

    monkeypatch.setattr(jaccard, "shipped", counted)
    check(spark, rows)
    assert max(sent) <= 6
