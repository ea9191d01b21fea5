"""Near-duplicate classes against all pairs."""

import random
import re

import numpy as np
import pytest

from feedloom.llm import common, near_dup, shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_sets(texts, size):
    out = []
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in data))
        out.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    return out


def brute(rows, size, percent):
    sets = brute_sets([t for _, t in rows], size)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, base = [], []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for d in range(n):
        kind = rng.random()
        if kind < 0.35 and base:
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
            if kind > 0.8:
                words = words[:20] + passage
            base.append(words)
        text = " ".join(words)
        rows.append((d, text.upper() if rng.random() < 0.1 else text.replace(" ", "\n", 3)))
    return rows


@pytest.mark.parametrize("seed,size,percent,k", [(1, 4, 80, 64), (2, 5, 80, 64), (3, 2, 60, 64)])
def test_classes_equal_all_pairs(spark, seed, size, percent, k):
    rows = corpus(seed, 220)
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent, k=k, star_shingles=300, block_rows=8)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, size, percent)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "ONE\ttwo"), (3, "one two"), (3, "one two"), (None, "one two"), (11, "long " * 50_000), (12, "long " * 50_000 + "end"), (13, "two one"), (14, "a\u00a0b c"), (14, "another text of the same id")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = near_dup.classes(df, size=4)
    told = [(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()]
    assert sorted(told, key=str) == brute(rows, 4, 80)
    assert near_dup.classes(df.limit(0)).count() == 0
    kept = near_dup.deduplicate(df, size=4)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.doc_id in (3, 8, 9, None)) == [("3", "one two")]
    # 3, 11, 12, 13, both texts of 14, and the three without words
    assert kept.count() == 9


def test_recall_against_all_pairs(spark):
    """Pairs at and around the threshold: every one that links is found."""
    rng = random.Random(21)
    rows = []
    for d in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 400]))]
        rows.append((2 * d, " ".join(words)))
        cut = round(len(words) * rng.uniform(0.08, 0.14))
        rows.append((2 * d + 1, " ".join(words[:-cut] + [f"v{rng.randrange(10**6)}" for _ in range(cut)])))
    rng.shuffle(rows)
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), size=4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, 4, 80)


def test_names_of_other_columns_dont_clash(spark):
    names = ["_id", "_print", "id", "print", "ID_", "uid", "hi", "lo", "first", "kept", "sketch", "n_shingles"]
    rows = [(i, "one two three four five six" if i < 3 else f"text {i}", *(f"{i}-{n}" for n in names)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names if n != "ID_") + ", `ID_` string")
    kept = near_dup.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]


def test_the_chance_of_a_miss_bounds_the_share():
    from math import comb

    for percent in (50, 60, 70, 80, 90):
        m = round(near_dup.least_share(percent, 64) * 64)
        below = lambda n, t=percent / 100: sum(comb(64, i) * t**i * (1 - t) ** (64 - i) for i in range(n))
        assert below(m) <= near_dup.MISS < below(m + 1)


def test_hashes_follow_the_words():
    texts = ["Ab c d e f", "ab  C\nd e f ", "", "x", "é É a b c", "a" * 1000 + " b"]
    got = list(shingles.shingle_sets(texts, 4, limit=16))
    want = brute_sets(texts, 4)
    assert [len(x) for x in got] == [len(x) for x in want]
    assert (got[0] == got[1]).all() and not set(got[3].tolist()) & set(got[5].tolist())
    whole = list(shingles.shingle_sets(texts, 4))
    assert all((a == b).all() for a, b in zip(got, whole, strict=True))


def test_overlaps_and_estimate():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, n)) for n in (0, 5, 200, 300)]
    got = shingles.overlaps(sets, sets[1:], width=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]
    a = rng.choice(1 << 40, 5000, replace=False)
    assert abs(near_dup.union_estimate(np.sort(a[:4500])[:256], np.sort(a[500:])[:256], 256) - 0.8) < 0.12
    assert near_dup.union_estimate(a[:0], a[:0], 8) == 0.0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    got = common.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
