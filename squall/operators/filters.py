"""Gate filters: thresholds, clutter masks and smoothing.  Each returns a function for DataFrame.transform."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.operators.contracts import CELLS, checked, require
from squall.operators.fields import FIELD, NO_DATA, VALID, InvalidGeometry, InvalidParameter

Processor = Callable[[DataFrame], DataFrame]


def _masked(gates: DataFrame, drop) -> DataFrame:
    return gates.withColumns({"value": F.when(~drop, F.col("value")), "status": F.when(drop, F.lit(NO_DATA)).otherwise(F.col("status"))})


def threshold(low: float | None = None, high: float | None = None) -> Processor:
    """Valid gates outside the bounds become no data; the bounds themselves stay."""

    @checked(gates={"value": "number", "status": "text"})
    def run(gates: DataFrame) -> DataFrame:
        out = F.lit(False)
        if low is not None:
            out = out | (F.col("value") < low)
        if high is not None:
            out = out | (F.col("value") > high)
        return _masked(gates, F.coalesce((F.col("status") == VALID) & out, F.lit(False)))

    return run


def correlation_mask(correlation: DataFrame, least: float) -> Processor:
    """Valid gates whose correlation is not valid or too low become no data.

    Gates meet by index (azimuth and range), not by angle; gates beyond the
    correlation field's range stay.  Fields with different numbers of azimuths
    raise when rows are read.
    """
    if not 0 < least <= 1:
        raise InvalidParameter("the threshold must be over 0 and at most 1")

    require(correlation, CELLS, "correlation_mask: correlation")

    @checked(gates=CELLS)
    def run(gates: DataFrame) -> DataFrame:
        keys = [*FIELD, "az_idx", "gate_idx"]
        c = correlation.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("value").alias("_cc"), F.col("status").alias("_cs"))
        joined = gates.join(c, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        # a partner is there for every gate within the shared range
        bad = F.col("_cs").isNotNull() & ((F.col("_cs") != VALID) | (F.col("_cc") < least))
        return _masked(joined, F.coalesce((F.col("status") == VALID) & bad, F.lit(False))).select(*gates.columns)

    return run


def check_same_azimuths(a: DataFrame, b: DataFrame) -> None:
    """Raises if a field of a and its partner in b differ in their number of azimuths."""
    n = lambda df, name: df.groupBy(*FIELD).agg((F.max("az_idx") + 1).alias(name))
    if not n(a, "n").join(n(b, "m"), FIELD).where("n <> m").isEmpty():
        raise InvalidGeometry("fields differ in their number of azimuths")


@checked(gates=CELLS)
def _stencil(gates: DataFrame, work) -> DataFrame:
    """Applies work(values with NaN where not valid) to each field as a dense array; only valid gates change."""

    def run(table):
        import pyarrow as pa

        az, gate = table["az_idx"].to_numpy(), table["gate_idx"].to_numpy()
        grid = np.full((int(az.max()) + 1, int(gate.max()) + 1), np.nan)
        valid = np.array(table["status"].to_pylist(), dtype=object) == VALID
        values = table["value"].to_numpy(zero_copy_only=False).astype(float)
        grid[az[valid], gate[valid]] = values[valid]
        out = work(grid)[az, gate]
        place = table.schema.get_field_index("value")
        return table.set_column(place, "value", pa.array(np.where(valid, out, values), from_pandas=True))

    return gates.groupBy(*FIELD).applyInArrow(run, gates.schema)


def _shifted(grid: np.ndarray, az: int, gate: int) -> np.ndarray:
    """The neighbour at an offset: azimuths wrap around, ranges end."""
    out = np.roll(grid, -az, axis=0)
    if gate > 0:
        return np.concatenate([out[:, gate:], np.full((len(grid), min(gate, grid.shape[1])), np.nan)], axis=1)[:, : grid.shape[1]]
    if gate < 0:
        return np.concatenate([np.full((len(grid), min(-gate, grid.shape[1])), np.nan), out[:, :gate]], axis=1)[:, : grid.shape[1]]
    return out


def median(azimuths: int = 3, gates: int = 3) -> Processor:
    """Upper median of the valid neighbours of each valid gate; kernels are odd."""
    if azimuths < 1 or gates < 1 or azimuths % 2 == 0 or gates % 2 == 0:
        raise InvalidParameter("kernel sizes must be odd")

    def work(grid: np.ndarray) -> np.ndarray:
        near = [_shifted(grid, a, g) for a in range(-(azimuths // 2), azimuths // 2 + 1) for g in range(-(gates // 2), gates // 2 + 1)]
        out = np.empty_like(grid)
        for first in range(0, len(grid), 64):  # bounded memory for large kernels
            part = np.sort(np.stack([x[first : first + 64] for x in near]), axis=0)
            n = np.sum(~np.isnan(part), axis=0)
            out[first : first + 64] = np.take_along_axis(part, np.minimum(n // 2, len(near) - 1)[None], axis=0)[0]
        return out

    return lambda df: df if azimuths == gates == 1 else _stencil(df, work)


def gaussian(sigma_azimuth: float, sigma_range: float) -> Processor:
    """Mean of the valid neighbours of each valid gate within three sigmas, weighted by distance in cells."""
    if sigma_azimuth <= 0 or sigma_range <= 0:
        raise InvalidParameter("sigmas must be positive")
    ra, rr = math.ceil(sigma_azimuth * 3), math.ceil(sigma_range * 3)

    def work(grid: np.ndarray) -> np.ndarray:
        total, weights = np.zeros_like(grid), np.zeros_like(grid)
        for a in range(-ra, ra + 1):
            for g in range(-rr, rr + 1):
                w = math.exp(-0.5 * ((a / sigma_azimuth) ** 2 + (g / sigma_range) ** 2))
                v = _shifted(grid, a, g)
                there = ~np.isnan(v)
                total += np.where(there, v, 0) * w
                weights += there * w
        return total / np.where(weights > 0, weights, np.nan)

    return lambda df: _stencil(df, work)


class SweepPipeline:
    """Processors one after another; none is the identity."""

    def __init__(self, *steps: Processor):
        self.steps = list(steps)

    def then(self, step: Processor) -> SweepPipeline:
        return SweepPipeline(*self.steps, step)

    def execute(self, gates: DataFrame) -> DataFrame:
        for step in self.steps:
            gates = gates.transform(step)
        return gates


#: A volume's processor: (gates of all its sweeps, one row per scan with what is known of it) -> gates of the same fields.
ScanProcessor = Callable[[DataFrame, DataFrame], DataFrame]


class ScanPipeline:
    """Processors that see whole volumes, one after another; every one returns the fields that it was given."""

    def __init__(self, *steps: ScanProcessor):
        self.steps = list(steps)

    def then(self, step: ScanProcessor) -> ScanPipeline:
        return ScanPipeline(*self.steps, step)

    def execute(self, gates: DataFrame, scan: DataFrame) -> DataFrame:
        for step in self.steps:
            made = step(gates, scan)
            if set(made.columns) != set(gates.columns):
                raise InvalidParameter("a processor keeps the columns of gates")
            gates = made.select(*gates.columns)
        return gates
