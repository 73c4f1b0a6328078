"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from rillhouse.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    found = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def plain_groups(words, pairs=None):
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for k, own in by_length.items():
        for i, a in enumerate(own):
            for b in [*own[i + 1 :], *by_length.get(k + 1, [])]:
                if one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def rows_of(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_words_of_a_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    words = plain_words(rows)
    assert {(r.word, r.n) for r in spelling.count_words(docs).collect()} == set(words.items())
    assert rows_of(spelling.variants(docs)) == plain_groups(words) and len(words) > 500


@pytest.mark.parametrize(("block", "small", "cells"), [(1024, 32, 1 << 22), (5, 32, 50), (40, 1, 300)])
def test_dense_words_in_blocks_of_any_size(spark, monkeypatch, block, small, cells):
    """Few letters, so that cells are large and most words have near ones."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 9))): rng.choice([1, 2, 3, 4, 8, 16, 40]) for _ in range(900)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    assert rows_of(spelling.group_words(df)) == plain_groups(words)
    # the same tiles in one process
    monkeypatch.setattr(spelling, "SMALL", small)
    monkeypatch.setattr(spelling, "CELLS", cells)
    some = sorted(words, key=lambda w: (-words[w], w))
    for by_prefix in (True, False):
        for longest in (6, 7):
            own = [w for w in some if len(w) in (longest, longest - 1)][:60]
            k = longest // 2
            pair = lambda a, b: max(len(a), len(b)) == longest and one_edit(a, b) and ((a[:k] == b[:k]) if by_prefix else a[:k] != b[:k] and a[k - longest :] == b[k - longest :])  # noqa: B023, E731
            found = spelling.tile([(longest, by_prefix, 0, len(own), len(own))], own)
            assert found.count[:-1].tolist() == [sum(pair(a, b) for b in own) for a in own]
            cut = spelling.tile([(longest, by_prefix, 0, 25, len(own))], own)
            assert cut.count[:-1].tolist() == [sum(pair(a, b) for b in (own[25:] if i < 25 else own[:25])) for i, a in enumerate(own)]
            assert all(found.best[i] == next((j for j, b in enumerate(own) if pair(a, b)), -1) for i, a in enumerate(own))


def test_every_edit_of_every_length_is_found(spark):
    rng, words = random.Random(3), {}
    for length in range(1, 16):
        base = "".join(rng.choice("abcdefghij") for _ in range(length))
        for i in range(length):
            for v in (base[:i] + base[i + 1 :], base[:i] + "x" + base[i + 1 :], base[:i] + base[i] + base[i:], base[:i] + "中😀"[i % 2] + base[i:]):
                words.setdefault(v, rng.randint(1, 9))
        words[base] = 100
    words[""] = 2
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(spelling.group_words(df)) == plain_groups(words)


def test_long_words_are_laid_out_apart(spark, monkeypatch):
    """Words around the width where they are, and one so long that it must not widen the others' rows."""
    rng, words = random.Random(9), {}
    for length in (60, 63, 64, 65, 66, 90):
        base = "".join(rng.choice("abc") for _ in range(length))
        words[base] = 50
        for i in range(0, length, 7):
            words[base[:i] + base[i + 1 :]] = rng.randint(1, 9)
            words[base[:i] + "x" + base[i + 1 :]] = rng.randint(1, 9)
    want = plain_groups(words)
    long = {"y" * 200_000: 9, "y" * 200_001: 4}
    many = {f"w{i:05d}": 3 for i in range(0, 90_000, 30)}
    got = rows_of(spelling.group_words(spark.createDataFrame(list((words | long | many).items()), "word string, n long").coalesce(1)))
    assert {r for r in got if r[0] in words} == want
    assert {r[4] for r in got if r[0] in long} == {1} and len(got) == len(words) + len(long) + len(many)


def test_long_chain_of_forms(spark):
    words = {"a" * (5 + i): 3 * 2**i for i in range(30)}
    assert rows_of(spelling.group_words(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain_groups(words)


def test_odd_rows(spark):
    text = "The colour of COLOUR, color: Éclair éclair Éclairs ÀÉÿ×÷ naïve naïve naives " * 3
    rows = [(1, None), (2, ""), (3, " \t123 中文"), (4, text), (4, text), (None, text), (None, None), (5, "x" * 70000 + " " + "y" * 70000), (6, "x" * 70000), (7, "x" * 70000 + "z " + "longer " * 40000), (2**60 + 1, "longr " * 4 + "farbe farbe farbe farben farben farben")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string").repartition(3)
    words = plain_words(rows)
    short = {w: n for w, n in words.items() if len(w) < 100}
    got = rows_of(spelling.variants(docs))
    assert {r for r in got if len(r[0]) < 100} == plain_groups(short) and len(got) == len(words)
    assert spelling.variants(docs.where("doc_id = -1")).count() == 0
