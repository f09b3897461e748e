"""Phrase mining against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from squall.llm import collocations
from squall.llm.common import table

SCHEMA = "doc_id long, text string, lang string"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, most_words=3, least=10, most_rows=2000, covered=50):
    f, total = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, most_words + 1):
                for i in range(len(w) - n + 1):
                    key = (lang, *w[i : i + n])
                    f[key] = f.get(key, 0) + 1
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    covers = Counter()
    for k, a in candidates.items():
        for n in range(2, len(k) - 1):
            for i in range(1, len(k) - n + 1):
                inner = (k[0], *k[i : i + n])
                covers[inner] = max(covers[inner], a)
    out = {}
    for k, a in candidates.items():
        if k in covers and 100 * covers[k] >= covered * a:
            continue
        score, _, l, r = min((1_000_000 * a * a // (f[k[: 1 + c]] * f[(k[0], *k[1 + c :])]), c, f[k[: 1 + c]], f[(k[0], *k[1 + c :])]) for c in range(1, len(k) - 1))
        out.setdefault(k[0], []).append((-score, -a, " ".join(k[1:]).encode(), l, r))
    made = []
    for lang, found in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:most_rows], 1):
            made.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(made)


def found(df):
    assert df.columns == NAMES
    return sorted(tuple(r) for r in df.collect())


def sample(rng, n, vocabulary="a b c d Ünï 東京 É x# (y) A".split()):
    rows = []
    for k in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\r\n", "\x0b", "\xa0", "  "]) for _ in range(rng.randrange(60)))
        rows.append((k, text, rng.choice(["en", "en", "de", None, "und", ""])))
    return rows + [(None, None, None), (None, None, "en"), (1, "", "en"), (1, " . , ", "de"), (2, "the end " * 3000, "fr"), (3, "the end " * 3000, "fr")]


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(7)
    for most in (1, 2, 3, 5, 8):
        lengths = rng.integers(1, 12, 40)
        ids = rng.integers(0, 3, lengths.sum())
        left = np.concatenate([np.arange(n, 0, -1) for n in lengths])
        order, common = collocations.suffix_array(ids, left, most)
        text = lambda p: tuple(ids[p : p + min(most, left[p])].tolist())
        assert sorted(order.tolist()) == list(range(len(ids)))
        assert [text(p) for p in order] == sorted(text(p) for p in range(len(ids)))
        for a, b, k in zip(order[:-1], order[1:], common[1:], strict=True):
            x, y = text(a), text(b)
            assert k == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905


def test_shards_are_cut_between_pieces():
    rng = random.Random(3)
    rows = sample(rng, 60)
    batch = pa.RecordBatch.from_pydict({"lang": pa.array([r[2] or "und" for r in rows]), "text": pa.array([r[1] for r in rows])})
    whole = Counter()
    for most in (1, 7, 100, 1 << 20):
        counts = Counter()
        for shard in collocations.shards([batch], most):
            for n, places, found_ in shard.phrases(4):
                langs = [shard.names[k] for k in shard.lang[shard.ids[places]]]
                for lang, phrase, c in zip(langs, shard.texts(places, n).to_pylist(), found_.tolist(), strict=True):
                    counts[lang, n, phrase] += c
        whole = whole or counts
        assert counts == whole
    assert sum(c for (_, n, _), c in whole.items() if n == 1) == sum(len(re.findall(r"[^\x20\x09-\x0D.,;:!?]+", r[1] or "")) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_against_plain(spark, seed):
    rows = sample(random.Random(seed), 150)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(collocations.collocations(df)) == plain(rows)
    assert found(collocations.collocations(df, 4, 5, 7, 80)) == plain(rows, 4, 5, 7, 80)


def test_ranks_in_parts(spark, monkeypatch):
    """Ties at the end of the list, with candidates ranked in many parts."""
    rows = [(k, " . ".join(f"p{i} q{i}" for i in range(300)), "en") for k in range(12)]
    monkeypatch.setattr(collocations, "RANKED_ROWS", 20)
    assert found(collocations.collocations(spark.createDataFrame(rows, SCHEMA), most_rows=50)) == plain(rows, most_rows=50)


def test_odd_tables(spark):
    assert found(collocations.collocations(spark.createDataFrame([], SCHEMA))) == []
    rows = sample(random.Random(9), 60)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.withColumns({n: F.lit(1) for n in ("words", "phrase", "f", "n", "a", "l", "r", "score", "rank", "part", "key", "longer")})
    assert found(collocations.collocations(more)) == plain(rows)


def test_large_counts_stay_exact(spark):
    """Products of counts pass 64 bits."""
    a, l, r = 3_000_000_007, 4_000_000_009, 5_000_000_021
    counts = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", l), ("en", 1, "y", r), ("en", 0, "", 10**12)], collocations.PHRASE)
    patched = pytest.MonkeyPatch()
    patched.setattr(collocations, "phrase_counts", lambda *_: counts)
    try:
        got = found(collocations.collocations(counts))
    finally:
        patched.undo()
    assert got == [("en", 1, "x y", a, l, r, 10**12, 1_000_000 * a * a // (l * r))]


def test_query_on_the_given_table(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang").collect()]
    assert found(collocations.op12_collocations(spark, "/root/testdata/sf0.001")) == plain(rows)
