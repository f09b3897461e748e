"""Each public operator tells, when the plan is made, which column is missing or of another kind."""

import pytest
from pyspark.sql import functions as F

from squall.functions.geo import RadarSite
from squall.operators import cells, contracts, fields, filters, render, sampling

VALUES = {"any": "v", "whole": 1, "number": 1.5, "text": "Valid", "codes": None, "moment": None}
SITE = RadarSite(35.0, -97.0)
MOMENT = "struct<gate_count:int,first_gate_km:double,gate_interval_km:double,word_size:int,scale:double,offset:double,raw:array<int>>"


def made(spark, contract):
    return spark.range(1).select(*[F.lit(VALUES[family]).alias(name) for name, family in contract.items()])


def cases(spark):
    placed, cell, point, direction, axis = (made(spark, c) for c in (contracts.PLACED, contracts.CELLS, contracts.POINTS, contracts.DIRECTIONS, contracts.AXIS))
    radials = made(spark, contracts.RADIALS).withColumn("REF", F.lit(None).cast(MOMENT))
    square = (34.0, -98.0, 36.0, -96.0)
    return {
        "threshold": (cell, {"value": "number", "status": "text"}, filters.threshold(1.0)),
        "correlation_mask": (cell, contracts.CELLS, filters.correlation_mask(cell, 0.5)),
        "correlation": (cell, contracts.CELLS, lambda df: filters.correlation_mask(df, 0.5)(cell)),
        "median": (cell, contracts.CELLS, filters.median(3, 3)),
        "gaussian": (cell, contracts.CELLS, filters.gaussian(1.0, 1.0)),
        "radial_axis": (placed, contracts.PLACED, sampling.radial_axis),
        "nearest_radial": (direction, contracts.DIRECTIONS, lambda df: sampling.nearest_radial(df, axis)),
        "nearest_radial_axis": (axis, contracts.AXIS, lambda df: sampling.nearest_radial(direction, df)),
        "bracketing_radials": (axis, contracts.AXIS, lambda df: sampling.bracketing_radials(direction, df)),
        "sample": (point, contracts.POINTS, lambda df: sampling.sample(df, placed)),
        "sample_gates": (placed, contracts.PLACED, lambda df: sampling.sample(point, df)),
        "composite": (placed, contracts.PLACED, lambda df: sampling.composite(df, SITE, square, 4, 4)),
        "vertical_section": (placed, contracts.PLACED, lambda df: sampling.vertical_section(df, 10.0, 50.0, 9000.0, 4, 4)),
        "label_cells": (cell, contracts.CELLS, lambda df: cells.label_cells(df, 35.0)),
        "storm_cells": (placed, contracts.PLACED, lambda df: cells.storm_cells(df, SITE)),
        "render_sweep": (placed, contracts.PLACED, lambda df: render.render_sweep(df, 4, 20.0)),
        "query_pixel": (placed, contracts.PLACED, lambda df: render.query_pixel(df, 1, 1, 4, 20.0)),
        "value_range": (cell, {"value": "number", "status": "text"}, fields.value_range),
        "extract_field": (radials, contracts.RADIALS, lambda df: fields.extract_field(df, "REF")),
    }


def test_each_violation_names_its_column(spark):
    for what, (table, contract, work) in cases(spark).items():
        assert work(table).columns, what
        for name, family in contract.items():
            with pytest.raises(contracts.SchemaError, match=f"column {name} is missing"):
                work(table.drop(name))
            if family != "any":
                with pytest.raises(contracts.SchemaError, match=f"column {name} is binary, not {family}"):
                    work(table.withColumn(name, F.lit(b"x")))


def test_moments(spark):
    radials = made(spark, contracts.RADIALS)
    with pytest.raises(contracts.SchemaError, match="column VEL is missing"):
        fields.extract_field(radials, "VEL")
    with pytest.raises(contracts.SchemaError, match="column VEL is double, not moment"):
        fields.extract_field(radials.withColumn("VEL", F.lit(1.0)), "VEL")
    short = radials.withColumn("VEL", F.lit(None).cast(MOMENT.replace(",raw:array<int>", "")))
    with pytest.raises(contracts.SchemaError, match="VEL: column raw is missing"):
        fields.extract_field(short, "VEL")


def test_further_columns_and_cases_are_free(spark):
    df = made(spark, contracts.CELLS).withColumnRenamed("value", "VALUE").withColumn("more", F.lit(1))
    assert contracts.require(df, contracts.CELLS) is df
