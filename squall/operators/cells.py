"""Storm cells: connected gates over a threshold, and their properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squall.functions.geo import RadarSite, polar_to_geo
from squall.operators.contracts import CELLS, PLACED, checked
from squall.operators.fields import FIELD, VALID, range_km


def label_grid(mask: np.ndarray) -> np.ndarray:
    """Least linear index of each four-connected component (azimuths wrap), -1 outside.

    Labels spread by least neighbour with pointer jumping, all cells at once.
    """
    n_az, n_gate = mask.shape
    none = n_az * n_gate
    label = np.where(mask, np.arange(none).reshape(mask.shape), none)
    while True:
        best = label.copy()
        for axis, step in ((0, 1), (0, -1)):
            best = np.minimum(best, np.roll(label, step, axis=axis))
        best[:, 1:] = np.minimum(best[:, 1:], label[:, :-1])
        best[:, :-1] = np.minimum(best[:, :-1], label[:, 1:])
        best = np.where(mask, best, none)
        # hook each cell's old root to the best label seen, then jump
        roots = np.append(np.arange(none), none)
        np.minimum.at(roots, label[mask], best[mask])
        while True:
            jumped = roots[roots]
            if np.array_equal(jumped, roots):
                break
            roots = jumped
        new = np.where(mask, roots[best], none)
        if np.array_equal(new, label):
            return np.where(mask, label, -1)
        label = new


@checked(gates=CELLS)
def label_cells(gates: DataFrame, least_dbz: float) -> DataFrame:
    """Gates at or over the threshold with cell (least linear index of the component in its field)."""

    def run(table):
        import pyarrow as pa

        az, gate = table["az_idx"].to_numpy(), table["gate_idx"].to_numpy()
        over = table["_over"].to_numpy(zero_copy_only=False)
        mask = np.zeros((int(az.max()) + 1, int(gate.max()) + 1), dtype=bool)
        mask[az, gate] = over
        label = label_grid(mask)[az, gate]
        return table.append_column("cell", pa.array(label.astype(np.int64))).filter(pa.array(label >= 0)).drop_columns(["_over"])

    marked = gates.withColumn("_over", F.coalesce((F.col("status") == VALID) & (F.col("value") >= least_dbz), F.lit(False)))
    schema = ", ".join(f"{name} {kind}" for name, kind in gates.dtypes)
    return marked.groupBy(*FIELD).applyInArrow(run, schema + ", cell bigint")


@checked(gates=PLACED)
def storm_cells(gates: DataFrame, site: RadarSite, least_dbz: float = 35.0, least_gates: int = 5) -> DataFrame:
    """One row per cell of each field, strongest first by cell_id.

    The centroid is weighted by reflectivity; the area takes each gate's start range.
    Of equal greatest gates, the one of least index gives azimuth and range.
    """
    labelled = label_cells(gates, least_dbz).withColumn("range_km", range_km())
    labelled = labelled.withColumns(polar_to_geo(F.col("azimuth_deg"), F.col("range_km"), F.col("elevation_deg"), site))
    top = F.struct((-F.col("value")).alias("v"), "az_idx", "gate_idx", "azimuth_deg", "range_km")
    cells = labelled.groupBy(*FIELD, "cell").agg(
        F.max("value").alias("max_dbz"), F.avg("value").alias("mean_dbz"), F.count(F.lit(1)).alias("gate_count"),
        (F.sum(F.col("latitude") * F.col("value")) / F.sum("value")).alias("latitude"), (F.sum(F.col("longitude") * F.col("value")) / F.sum("value")).alias("longitude"),
        F.min("latitude").alias("min_latitude"), F.max("latitude").alias("max_latitude"), F.min("longitude").alias("min_longitude"), F.max("longitude").alias("max_longitude"),
        F.sum(F.radians("az_spacing_deg") * F.col("range_km") * F.col("gate_interval_km")).alias("area_km2"), F.first("elevation_deg").alias("elevation_deg"), F.min(top).alias("_top"),
    ).where(F.col("gate_count") >= least_gates)
    cells = cells.withColumns({"max_azimuth_deg": F.col("_top.azimuth_deg"), "max_range_km": F.col("_top.range_km")}).drop("_top")
    order = Window.partitionBy(*FIELD).orderBy(F.desc("max_dbz"), "cell")
    return cells.withColumn("cell_id", F.row_number().over(order) - 1)
