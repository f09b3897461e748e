"""State of sites and assembly of volumes while chunks come, against tables of the whole."""

import random

from pyspark.sql import functions as F

from squall.functions import timing
from squall.streaming import assembly, chunk_stream, site_state

CHUNK = "site string, volume int, sequence int, chunk_type string, time_ms long"
DATA = CHUNK + ", data binary"


def test_retry_delays(spark):
    delays = [r[0] for r in spark.range(6).select(timing.retry_delay_ms(F.col("id"))).orderBy("id").collect()]
    assert delays == [500, 500, 1000, 2000, 4000, None]
    assert [timing.next_wait_ms(*x) for x in (("Start", [1]), ("Intermediate", []), ("End", [3000, 4001]))] == [8500, 4000, 3500]


class Stream:
    """Rows put into a folder, a part a run."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def run(self, rows, work):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.path / "in" / str(self.n)))
        stream = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(str(self.path / "in"))
        out = work(stream).writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "state"))
        out.trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(str(self.path / "out")).collect()


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    s = Stream(spark, tmp_path, CHUNK)
    key = lambda r: (r.site, r.time_ms, r.late)
    got = sorted(s.run([("KTLX", 1, 1, "Start", 1000), ("KTLX", 1, 2, "Intermediate", 5000), (None, 1, 1, "Start", 1), ("KDMX", 4, 1, "Start", None)], site_state.track), key=key)
    assert [(r.interval_ms, r.expected_ms, r.n_samples) for r in got] == [(None, 9500, 0), (4000, 9000, 1)]
    got = sorted(s.run([("KTLX", 1, 4, "End", 9000), ("KTLX", 1, 3, "Intermediate", 4000), ("KDMX", 4, 2, "Intermediate", 100)], site_state.track), key=key)
    assert [(r.site, r.sequence, r.interval_ms, r.gap, r.volume_done, r.late) for r in got] == [
        ("KDMX", 2, None, False, False, False), ("KTLX", 1, None, False, False, False), ("KTLX", 3, None, False, False, True), ("KTLX", 2, 4000, False, False, False), ("KTLX", 4, 4000, True, True, False),
    ]
    assert all(r.event == "chunk" for r in got)


def test_last_ten_intervals(spark, tmp_path):
    rng, t, rows = random.Random(1), 0, []
    for k in range(40):
        t += rng.randrange(1, 9000)
        rows.append(("K", 1, k + 1, rng.choice(["Intermediate", "End"]), t))
    s = Stream(spark, tmp_path, CHUNK)
    for i in range(0, 40, 7):
        got = s.run(rows[i : i + 7], site_state.track)
    kept = {}
    for row, before, r in zip(rows, [None, *rows[:-1]], sorted(got, key=lambda r: r.time_ms), strict=True):
        own = kept.setdefault(row[3], [])
        if before:
            own.append(row[4] - before[4])
        last = own[-10:]
        assert (r.n_samples, r.average_ms) == (len(last), sum(last) // len(last) if last else None)


def test_overdue_by_timer_once(spark, tmp_path):
    """Told when time passes on other sites, though the site is silent; not again when its chunk comes at last."""
    s = Stream(spark, tmp_path, CHUNK)
    track = lambda df: site_state.track(df, "1 second")
    got = s.run([("KTLX", 1, 1, "Start", 10_000), ("KDMX", 1, 1, "Start", 11_000)], track)
    assert [r for r in got if r.event == "overdue"] == []
    got = s.run([("KDMX", 1, 2, "Intermediate", 19_000), ("KDMX", 1, 3, "Intermediate", 30_000)], track)
    told = sorted((r.site, r.sequence, r.expected_ms) for r in got if r.event == "overdue")
    assert told == [("KDMX", 2, 27_000), ("KTLX", 1, 18_500)]  # the one in the data, the other by its timer
    got = s.run([("KTLX", 1, 2, "Intermediate", 40_000), ("KDMX", 1, 4, "End", 39_000)], track)
    told = sorted((r.site, r.sequence, r.expected_ms) for r in got if r.event == "overdue")
    assert told == [("KDMX", 2, 27_000), ("KTLX", 1, 18_500)]


def volumes(rng, n):
    """Chunks of volumes in random order: some lost, some twice, unlike bytes of one chunk, ends that never come."""
    rows = []
    for v in range(n):
        final = rng.randrange(2, 9)
        lost = {rng.randrange(1, final + 1)} if rng.random() < 0.5 else set()
        for k in range(1, final + 1):
            if k in lost:
                continue
            kind = "Start" if k == 1 else "End" if k == final else "Intermediate"
            row = ("K", v, k, kind, 1000 * (10 * v + k), bytearray(f"{v}.{k};".encode() * rng.randrange(1, 4)))
            rows.append(row)
            if rng.random() < 0.3:
                rows.append((*row[:5], bytearray(f"{v}.{k}:".encode()) if rng.random() < 0.5 else row[5]))
    rng.shuffle(rows)
    return rows


def assembled(rows):
    return sorted((r.volume_id, bytes(r.content), r.n_chunks, tuple(r.missing), r.complete) for r in rows)


def test_stream_assembles_what_the_table_does(spark, tmp_path):
    rows = volumes(random.Random(3), 25)
    want = assembled(chunk_stream.assemble(spark.createDataFrame(rows, DATA)).collect())
    s = Stream(spark, tmp_path, DATA)
    work = lambda df: assembly.assemble_stream(df, "0 seconds", 5000)
    got = s.run(rows + [("K", 999, 1, "Start", 10_000_000, bytearray(b"x"))], work)  # time goes on, so all others are given
    assert assembled(got) == want and any(not w[4] for w in want) and any(w[4] for w in want)


def test_volumes_over_several_runs(spark, tmp_path):
    s = Stream(spark, tmp_path, DATA)
    work = lambda df: assembly.assemble_stream(df, "0 seconds", 100_000)
    b = lambda x: bytearray(x.encode())
    assert s.run([("K", 1, 2, "Intermediate", 2000, b("b")), ("K", 1, 3, "End", 3000, b("c")), ("K", 2, 1, "Start", 4000, b("x"))], work) == []
    got = s.run([("K", 1, 1, "Start", 5000, b("a"))], work)  # the start came last
    assert assembled(got) == [("K-1", b"abc", 3, (), True)]
    got = s.run([("K", 2, 3, "Intermediate", 6000, b("z")), ("K", 3, 2, "End", 6000, b("q")), ("K", 9, 1, "Start", 900_000, b("-"))], work)
    assert assembled(got) == [("K-1", b"abc", 3, (), True), ("K-2", b"xz", 2, (2,), False)]  # of 3 there is no start
