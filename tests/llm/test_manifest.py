"""The Merkle manifest against trees built as a whole."""

import hashlib
import random
import zlib

import pytest

from rillhouse.llm import manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def whole(leaves):
    """Root of a list, and each leaf's siblings level by level as (left, right)."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        at = [i // 8 for i in at]
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    """All columns of the manifest from rows (doc_id, text, lang, source, n_chars)."""

    def leaf(r, text):
        values = (r[0], r[3], r[2], r[4], text)
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    groups = {}
    for r in rows:
        groups.setdefault(b"" if r[2] is None else b"+" + r[2].encode(), []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups)
    trees = [whole([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    root, tops = whole([t[0] for t in trees]) if trees else (None, [])
    out = []
    for g, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf(r, r[1] and "".join(c.lower() if c.isascii() else c for c in r[1]))
            for left, right in path + top:
                now = H(left, now, right)
            out.append((r[0], own, subroot, root, H(*[s for step in path + top for s in step]), now, now == root))
    return out


key = lambda r: tuple(map(str, r))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 513, 700])
def test_appended_trees_equal_whole_ones(n):
    leaves = [H(str(i)) for i in range(n)]
    assert manifest.tree(leaves) == whole(leaves)
    root, paths = manifest.tree(leaves)
    assert all(manifest.fold(x, p) == root for x, p in zip(leaves, paths, strict=True))


def test_witnesses_grow_with_appends():
    """At any time an open witness holds what stands beside it so far, and appends only add to it."""
    grown, witnesses = manifest.Appender(), []
    for i in range(70):
        before = [[(left, list(right)) for left, right in w] for w in witnesses]
        witnesses.append(grown.append(H(str(i))))
        for old, new in zip(before, witnesses, strict=False):
            assert all(a[0] == b[0] and b[1][: len(a[1])] == a[1] for a, b in zip(old, new, strict=False)) and len(new) >= len(old)
    assert grown.finish() == whole([H(str(i)) for i in range(70)])[0]


def test_manifest_equals_whole_trees(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = manifest.manifest(docs)
    assert sorted(map(key, got.collect())) == sorted(map(key, plain([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])))


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_several_storeys_and_a_hot_language(spark, levels):
    rng = random.Random(4)
    rows = [(i, f"Text {i}", rng.choice(["en"] * 6 + ["de", None, "é", "Z"]), "s", i) for i in rng.sample(range(10**6), 700)]
    rows += [(i, "nine", "nine", "s", i) for i in range(9)] + [(i, "65", "sixty-five", "s", i) for i in range(65)]
    rows += [(-k, "x", f"l{k}", None, None) for k in range(1, 40)]  # more languages than a run
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert sorted(map(key, manifest.manifest(docs, levels).collect())) == sorted(map(key, plain(rows)))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "É AZ é", "en", "a", 6), (3, "É AZ é", "en", "a", 6), (3, "other", "en", "a", 5),
        (None, "no ID", "en", "a", 5), (None, None, "", "a", None), (7, "Ab" * 70000, "de", "", 140000), (2**60 + 1, "中 X", "en", "b", 3),
    ]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp string, rank string, leaf string, node string").repartition(3)
    assert sorted(map(key, manifest.manifest(docs).collect())) == sorted(map(key, plain(rows)))
    assert manifest.manifest(docs.where("doc_id = -1")).count() == 0
