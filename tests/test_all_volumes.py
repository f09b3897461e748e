"""Volumes by a table of names, and a cache of many files."""

import pytest
from pyspark.sql import functions as F

from squall import api
from squall.plans import q_feed, registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(k * 100, [0.1] * 64, k % 3) for k in range(9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["a03_download_by_name", "a18_cached_volume"])
def test_every_volume(spark, tables, name):
    got = sorted(map(tuple, registry.QUERIES[name](spark, tables).collect()))
    assert got == sorted(map(tuple, registry.QUERIES["a02_load_file"](spark, tables).collect()))
    assert len({k for k, _, _ in got}) > 2 and sum(n for _, _, n in got) == 9


def test_a_missing_name_is_an_error(spark, tables):
    gone = spark.createDataFrame([("KTLX20240102_235959_V06",)], "name string")
    with pytest.raises(Exception, match="not found"):
        api.download(spark, q_feed._files(spark, tables), gone).collect()


def test_the_cache_copies_once(spark, tables, tmp_path):
    root = q_feed._files(spark, tables)
    paths = q_feed.listing.list_folder(spark, root).select("path")
    n = paths.count()
    assert api.cache_files(paths.limit(1), f"{tmp_path}/cache") == 1
    assert api.cache_files(paths, f"{tmp_path}/cache") == n - 1
    assert api.cache_files(paths, f"{tmp_path}/cache") == 0
    with pytest.raises(Exception, match="not found"):
        api.cache_files(paths.limit(1).select(F.concat("path", F.lit("x")).alias("path")), f"{tmp_path}/cache")
