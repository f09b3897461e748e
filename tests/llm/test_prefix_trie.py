"""The prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from squall.llm import prefix_trie
from squall.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, digest(role, text), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, q in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + q[h:])
    members, ends, children, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, q in built.items():
        ends[q].append(c)
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    for q in members:
        if q:
            children[q[:-1]] += 1
    for q, m in members.items():
        for d in range(len(q) + 1):
            leaves[q[:d]] += q not in children
            saved[q[:d]] += (len(m) - 1) * len(q[-1][1]) if q else 0
    hashed = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), children.get(q, 0), leaves[q], saved[q], hashed(ends.get(q, []))) for q, m in members.items())


def found(df):
    return sorted(tuple(r) for r in prefix_trie.trie(df).select(*NAMES).collect())


def sample(rng, n):
    """Conversations with common beginnings, missing bases, nulls, repeated turns and rows, negative ids."""
    rows = []
    for conv in rng.sample(range(-250, 2500), n):
        for turn in range(rng.randrange(9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "a", "Ünï", None, "x" * rng.randrange(3)])))
    rows += rng.sample(rows, len(rows) // 10)
    rows += [(None, 1, "user", "a"), (None, None, None, None), (77, 0, "user", "y" * 200_000), (78, 0, "user", "y" * 200_000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_against_plain(spark, seed):
    rows = sample(random.Random(seed), 150)
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_one_family_only_and_one_conversation(spark):
    rows = [(101, k, "user", str(k)) for k in range(7)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    rows += [(100, k, "user", str(k % 2)) for k in range(3)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_common_and_long_conversations(spark):
    """Many families hold one conversation; two long ones share all but their ends."""
    rows = [(100 * c + c % 100, k, "user", f"t{k}") for c in range(60) for k in range(4)]
    rows += [(c, k, "user", f"long {k if k < 298 else c}") for c in (70_001, 80_001, 90_003) for k in range(300)]
    rows += [(c, k, "user", "same") for c in (5_000, 5_100) for k in range(37)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_trie_of_odd_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = sample(random.Random(5), 40)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.withColumns({n: F.lit(1) for n in ("base", "key", "parent", "depth", "digest", "chars", "families", "ends", "place", "saved")})
    assert found(more) == plain(rows)


def test_query_on_the_given_table(spark):
    df = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.op11_prefix_trie(spark, "/root/testdata/sf0.001")
    assert tuple(got.columns) == NAMES
    assert sorted(map(tuple, got.collect())) == plain(rows)
