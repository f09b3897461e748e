"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from squall.llm import jaccard_join
from squall.llm.common import table

SCHEMA = "doc_id long, text string"


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def plain(rows, percent=85, width=4):
    """(doc_id, size, component): texts of one id are linked each for themselves."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted((len(s), k) for k, s in enumerate(sets) if s and rows[k][0] is not None)
    for p, (n, i) in enumerate(order):
        for m, j in order[p:]:
            if 100 * n < percent * m:
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (n + m - both):
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return sorted(((d if d is not None else -1, len(s), least[root(k)] if d is not None else -1) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))))


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        words[k : k + rng.choice([0, 1, 1])] = rng.choice([[], [f"n{rng.randrange(10**6)}"], ["the"]])
        words = words or ["x"]
    return words


def sample(rng, families=12, copies=9, lengths=(1, 2, 4, 7, 9, 12, 20, 40, 90, 200)):
    """Near copies of texts of many sizes, with passages that all share, at similarities around the threshold."""
    passage = [f"common{k}" for k in range(30)]
    rows = []
    for f in range(families):
        base = [f"f{f}w{k % 50 if f % 3 else k}" for k in range(rng.choice(lengths))]
        for _ in range(copies):
            words = edited(rng, base, rng.randrange(1 + len(base) // 25 + rng.randrange(2)))
            words = words + passage[: rng.choice([0, 0, 30])] if rng.random() < 0.2 else words
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, rows[k][1]) for k in range(6)]
    return rows + [(3, "another text of id three " * 5), (None, rows[0][1]), (None, None), (900, None), (901, "  \n"), (902, ""), (903, "Ünï CÖDÉ"), (904, "ünï cÖDÉ"), (905, "Ünï cÖDÉ")]


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_prefixes_hold_enough(percent):
    """Sets at the threshold, in the worst order, share at least the depth in their prefixes."""
    for n in range(1, 300, 7):
        least = int(jaccard_join.least_overlap(n, percent))
        for m in range(least, n + 1):
            both = -(-percent * (n + m) // (100 + percent))
            if both > m:
                continue
            small = min(int(jaccard_join.depth(np.array(n))), int(jaccard_join.depth(np.array(m))), m)
            # all that isn't common comes first
            for size in (n, m):
                assert int(jaccard_join.prefix_length(np.array(size), percent)) - (size - both) >= min(small, both)


def test_join_against_all_pairs():
    rng = np.random.default_rng(5)
    for round_ in range(30):
        sets = []
        for _ in range(8):
            base = rng.integers(0, 10**6, rng.integers(1, 120), dtype=np.uint64)
            for _ in range(4):
                s = base.copy()
                change = rng.random(len(s)) < rng.choice([0, 0.03, 0.07, 0.1])
                s[change] = rng.integers(0, 10**6, change.sum(), dtype=np.uint64)
                sets.append(np.unique(s[: len(s) - rng.integers(0, 2)] if len(s) > 1 else s))
        n = np.array([len(s) for s in sets])
        tokens = [s[:k].view(np.int64) for s, k in zip(sets, jaccard_join.prefix_length(n, 85), strict=True)]
        names = list(range(len(sets)))
        left, right = (names, names) if round_ % 2 else (names[::2], names[3:])
        got = jaccard_join.join(np.array(names), tokens, sets, left, right, 85)
        want = []
        for i in left:
            for j in right:
                both = len(np.intersect1d(sets[i], sets[j]))
                if i != j and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want.append((i, j))

        def parts(pairs):
            parent = list(range(len(sets)))
            for x, y in pairs:
                p, q = parent[x], parent[y]
                parent = [q if z == p else z for z in parent]
            return {frozenset(k for k in names if parent[k] == p) for p in parent}

        assert parts(got) == parts(want)


@pytest.mark.parametrize("seed,small,task_bytes", [(1, None, 1 << 22), (2, 0, 1 << 22), (3, 1000, 1 << 22), (4, 15, 3000), (5, None, 500)])
def test_components_against_all_pairs(spark, seed, small, task_bytes):
    rows = sample(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(jaccard_join.jaccard_components(df, small=small, task_bytes=task_bytes)) == plain(rows)


def test_large_groups_in_many_tasks(spark):
    """One large group of near copies, and texts that share a passage only."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(3)))) for k in range(150)]
    rows += [(1000 + k, " ".join([f"o{k}x{i}" for i in range(rng.randrange(5, 60))] + base[:40])) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(jaccard_join.jaccard_components(df, task_bytes=4000)) == plain(rows)


def test_threshold_and_width(spark):
    rows = sample(random.Random(8))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(jaccard_join.jaccard_components(df, 70, 2)) == plain(rows, 70, 2)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(jaccard_join.jaccard_components(empty)) == []
    rows = [(None, None), (1, None), (2, " ")]
    assert found(jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    rows = sample(random.Random(6), 4, 4) + [(5000, "w " * 30_000 + "end"), (5001, "w " * 30_000), (5002, " ".join(f"u{k}" for k in range(20_000)))]
    more = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("n", "k1", "node", "label", "cluster", "tokens", "key", "size", "bytes")})
    assert found(jaccard_join.jaccard_components(more)) == plain(rows)


def test_query_on_the_given_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert found(jaccard_join.op13_jaccard_join(spark, "/root/testdata/sf0.001")) == plain(rows)
