"""Digests of bytes in a defined order, as a stream: no group's bytes are held as a whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.shipping import ship


def _hashed(n_keys: int):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        key = digest = names = None
        n, done = 0, []

        def out():
            columns = [[row[k] for row in done] for k in range(n_keys + 2)]
            kinds = [*names, pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*[f"k{i}" for i in range(n_keys)], "digest", "n_bytes"])

        for batch in batches:
            names = names or [batch.column(k).type for k in range(n_keys)]
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True))
            for one, data in zip(keys, batch.column(n_keys), strict=True):
                if digest is None or one != key:
                    if digest is not None:
                        done.append((*key, digest.hexdigest(), n))
                    key, digest, n = one, hashlib.sha256(), 0
                if data.is_valid:
                    raw = data.as_buffer()
                    digest.update(raw)
                    n += raw.size
            if done:
                yield out()
                done = []
        if digest is not None:
            done.append((*key, digest.hexdigest(), n))
            yield out()

    return run


def in_order(df: DataFrame, by: list[str], order: list[str], data: str) -> DataFrame:
    """Per key the SHA-256 (lower-case hex) of its rows' bytes in order, and how many they are: by..., digest, n_bytes.

    A null adds nothing; rows of equal order follow each other by their bytes.
    """
    ship(df.sparkSession)
    keys = df.schema
    ddl = ", ".join(f"k{i} {keys[c].dataType.simpleString()}" for i, c in enumerate(by))
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.col(data).alias("data"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    groups = [f"k{i}" for i in range(len(by))]
    sorted_ = rows.repartition(*groups).sortWithinPartitions(*groups, *[f"o{i}" for i in range(len(order))], "data")
    made = sorted_.select(*groups, "data").mapInArrow(_hashed(len(by)), f"{ddl}, digest string, n_bytes long")
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], "digest", "n_bytes")
