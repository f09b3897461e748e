"""The pipeline against its stages in plain Python, and its registration."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_operators import ALNUM, WORD, lower, plain_components

from squall.llm import language, pii

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]


def test_run_matches_plain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language.train(docs)
    judged = {r.doc_id: r for r in language.identify(docs, model).collect()}
    left = [i for i in rows if judged[i].lang_pred != "und" and judged[i].score >= corpus_pipeline.MIN_SHARE]
    near = plain_components([(i, rows[i].text) for i in left], width=5, percent=80)
    left = [i for i in left if near[i][1] == i]
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = ALNUM.findall(lower(r.text))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}

    def clean(text):
        w = ALNUM.findall(lower(text))
        return not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    left = [i for i in left if clean(rows[i].text)]
    hidden = {r.doc_id: r.text for r in pii.redact(docs.where(F.col("doc_id").isin(left))).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert sorted(got) == sorted(left) and len(left) < len(rows)
    assert all(got[i]["size"] == len(WORD.findall(hidden[i])) and got[i].taken <= 2 * got[i]["size"] for i in left)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) for t in hidden.values())


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
