"""Data sources: chunks as a stream, objects, files that appear on commit."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from squall.sources import chunk_source, objects, stores

KINDS = "SIE"


def put(root, site, slot, prefix, sequences, final=9):
    folder = root / site / str(slot)
    folder.mkdir(parents=True, exist_ok=True)
    for k in sequences:
        name = f"{prefix}-{k:03d}-{'S' if k == 1 else 'E' if k == final else 'I'}"
        (folder / name).write_bytes(f"{site} {slot} {name}".encode())


def test_spans():
    for seed in range(50):
        some = set(random.Random(seed).sample(range(40), seed % 30))
        assert chunk_source.numbers(chunk_source.spans(some)) == some
    assert chunk_source.spans([3, 1, 2, 7]) == "1-3,7" and chunk_source.spans([]) == ""


def test_newest_of_rounds():
    """Every rotation, with holes."""
    for n in range(1, 12):
        for turn in range(n):
            values = [(k - turn) % n for k in range(n)]
            for holes in itertools.chain([()], itertools.combinations(range(n), min(2, n - 1))):
                held = [None if k in holes else v for k, v in enumerate(values)]
                best = chunk_source.last_in_rounds(held, lambda v: v)
                assert held[best] == max(v for v in held if v is not None)
    assert chunk_source.last_in_rounds([], lambda v: v) is None and chunk_source.last_in_rounds([None, None], lambda v: v) is None


def test_schemes(tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        files, base = stores.store(path)
        assert stores.file_names(files, base) == ["a"] and stores.file_names(files, base + "/none") == []
    with pytest.raises(stores.UnknownStore):
        stores.store("nosuch://bucket/x")


def follow(spark, root, state, start="earliest", **options):
    """All that is new into a folder of Parquet."""
    stream = chunk_source.chunk_stream(spark, str(root), start, **options)
    query = stream.writeStream.format("parquet").option("path", str(state / "out")).option("checkpointLocation", str(state / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(str(state / "out")).select("site", "volume", "name", "sequence", "chunk_type", F.col("data").cast("string").alias("data"), "upload_ms").collect()
    assert all(r.data == f"{r.site} {r.volume} {r.name}" and r.upload_ms > 0 for r in rows)
    return sorted((r.site, r.volume, r.name[:15], r.sequence) for r in rows)


def there(root):
    return sorted((p.parts[-3], int(p.parts[-2]), p.name[:15], int(p.name[16:19])) for p in root.glob("*/*/*") if len(p.name) == 21)


def test_growing_folder_in_two_runs(spark, tmp_path):
    root = tmp_path / "chunks"
    put(root, "KTLX", 998, "20240101-000000", range(1, 10))
    put(root, "KTLX", 999, "20240101-001000", [1, 2, 4])
    put(root, "KDMX", 5, "20240101-000500", [1])
    (root / "KTLX" / "999" / "notes.txt").write_bytes(b"no chunk")
    assert follow(spark, root, tmp_path) == there(root)
    # late, further and new volumes, a slot of the next round, a new site, several volumes between two runs
    put(root, "KTLX", 999, "20240101-001000", [3, 5, 6, 7, 8, 9])
    for k in range(1, 6):
        put(root, "KTLX", k, f"20240101-00{k + 1}000", range(1, 10 if k < 5 else 4))
    put(root, "KFWS", 17, "20240101-003000", [1, 2])
    assert follow(spark, root, tmp_path) == there(root)
    assert follow(spark, root, tmp_path) == there(root)  # nothing new
    put(root, "KDMX", 5, "20240101-000500", [2, 3])
    put(root, "KTLX", 4, "20240101-005000", [])
    put(root, "KTLX", 5, "20240101-006000", [4])
    assert follow(spark, root, tmp_path) == there(root)


def test_joined_at_the_newest(spark, tmp_path):
    root = tmp_path / "chunks"
    put(root, "KTLX", 1, "20240101-000000", range(1, 10))
    put(root, "KTLX", 2, "20240101-001000", [1, 2, 3, 4])
    assert follow(spark, root, tmp_path, "latest") == [("KTLX", 2, "20240101-001000", 1), ("KTLX", 2, "20240101-001000", 4)]
    put(root, "KTLX", 2, "20240101-001000", [5])
    put(root, "KTLX", 3, "20240101-002000", [1])
    got = follow(spark, root, tmp_path, "latest")
    assert [x[1::2] for x in got] == [(2, 1), (2, 4), (2, 5), (3, 1)]


def test_no_site_yet_and_chosen_sites(spark, tmp_path):
    root = tmp_path / "chunks"
    root.mkdir()
    stream = chunk_source.chunk_stream(spark, str(root), "latest", ["KDMX"])
    run = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    run()
    put(root, "KDMX", 3, "20240101-000000", [1, 2])
    put(root, "KTLX", 3, "20240101-000000", [1, 2])
    run()
    assert sorted((r.site, r.sequence) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("KDMX", 1), ("KDMX", 2)]
    with pytest.raises(Exception, match="latest or earliest"):
        chunk_source.chunk_stream(spark, str(root), "now").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start().awaitTermination()


# ---- objects ----


def archive_folder(root):
    for site, day, names in (("KTLX", "2024/01/02", "abc"), ("KTLX", "2024/01/03", "d"), ("KDMX", "2024/01/02", "ef"), ("KDMX", "2023/12/31", "g"), ("KFWS", "2024/02/01", "h")):
        folder = root / day / site
        folder.mkdir(parents=True)
        for name in names:
            (folder / f"{site}_{name}").write_bytes(f"{site} {name}".encode())


@pytest.mark.parametrize("condition", [
    "true", "site = 'KTLX'", "site in ('KDMX', 'KXXX') and day = '2024-01-02'", "day >= '2024-01-02' and day < '2024-01-03'", "day > '2024-01-02'", "day <= '2023-12-31'", "day > '2024'", "day < '2024-01'", "day > '2024-01-02x'",
    "day >= '2024-01-02x' and site <> 'KFWS'", "day in ('2024-01-03', '2024-02-01')", "site = 'KTLX' or day = '2023-12-31'", "day = '2024-01-02' and day = '2024-01-03'", "day is null", "name like '%e'",
])
def test_filters_reach_the_listing(spark, tmp_path, condition):
    archive_folder(tmp_path)
    whole = spark.createDataFrame([(p.parts[-2], "-".join(p.parts[-5:-2]), p.name, p.stat().st_size) for p in tmp_path.glob("*/*/*/*/*")], "site string, day string, name string, size long")
    df = objects.objects(spark, str(tmp_path)).where(condition)
    assert sorted(tuple(r) for r in df.select("site", "day", "name", "size").collect()) == sorted(tuple(r) for r in whole.where(condition).collect())


def test_plan_shows_the_filters(spark, tmp_path):
    archive_folder(tmp_path)
    df = objects.objects(spark, str(tmp_path), True).where("site = 'KTLX' and day >= '2024-01-03'")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(site,KTLX), GreaterThanOrEqual(day,2024-01-03)]" in plan
    assert "isnotnull" in plan and "(site#" in plan and "= KTLX" not in plan  # Spark itself looks for nulls only
    assert df.rdd.getNumPartitions() == 1  # one day of one site
    assert [(r.name, bytes(r.data), r.error) for r in df.collect()] == [("KTLX_d", b"KTLX d", None)]


def test_objects_by_path(spark, tmp_path):
    archive_folder(tmp_path)
    here = f"{tmp_path}/2024/01/02/KTLX"
    rows = [(1, f"{here}/KTLX_a", 1), (2, f"file://{here}/KTLX_b", 1), (3, f"{here}/none", 1), (4, here, 1), (5, None, 1), (6, "nosuch://b/x", 1), (7, f"{here}/KTLX_a", 1)]
    got = {r.k: r for r in objects.fetch(spark.createDataFrame(rows, "k int, path string, size int")).collect()}
    assert {k: r.data and bytes(r.data) for k, r in got.items()} == {1: b"KTLX a", 2: b"KTLX b", 3: None, 4: None, 5: None, 6: None, 7: b"KTLX a"}
    assert all((r.error is None) == (r.data is not None) == (r.modified_ms is not None) for r in got.values())
    assert got[3].error == got[4].error == "not found" and got[5].error == "no path" and "nosuch" in got[6].error


# ---- files ----


def test_files_appear_on_commit(spark, tmp_path):
    df = spark.range(0, 200, 1, 7).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") != 3, F.encode(F.col("id").cast("string"), "UTF-8")).alias("data"))
    objects.save(df, str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {f"f{k}": str(k).encode() if k != 3 else b"" for k in range(200)}


def test_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 100, 1, 5).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("data"))
    with pytest.raises(Exception, match="broken"):
        objects.save(df, str(tmp_path))
    assert list(tmp_path.iterdir()) == []
    twice = spark.range(4).select(F.lit("same").alias("name"), F.lit("x").alias("data"))
    with pytest.raises(Exception, match="several rows"):
        objects.save(twice, str(tmp_path))
    bad = spark.range(1).select(F.lit("a/b").alias("name"), F.lit("x").alias("data"))
    with pytest.raises(Exception, match="no file name"):
        objects.save(bad, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_task_that_is_tried_again(tmp_path):
    """An attempt that dies in its midst, one that is told of twice: each file once."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"folder": pa.array([None, ""], pa.string()), "name": ["a", "b"], "data": pa.array([b"1", b"2"], pa.binary())})
    other = pa.RecordBatch.from_pydict({"folder": ["x/y"], "name": ["c"], "data": pa.array([b"3"], pa.binary())})
    writer = objects.FileWriter({"path": str(tmp_path)})

    def dying():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(dying())
    writer.write(iter([batch]))  # an attempt whose message never came
    messages = [writer.write(iter([batch])), writer.write(iter([other])), writer.write(iter([])), None]
    assert [p.name[:9] for p in tmp_path.iterdir()] == ["_staging-"]
    writer.commit(messages)
    assert {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()} == {"a": b"1", "b": b"2", "x/y/c": b"3"}
    again = objects.FileWriter({"path": str(tmp_path)})
    again.write(iter([other]))
    again.abort([None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "x"]
