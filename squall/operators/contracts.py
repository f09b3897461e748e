"""What operators need of their tables, told when a plan is made, by the column's name.

A contract is columns with families of types.  ``checked`` puts contracts on a function's
DataFrame parameters; further columns are free.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Families of types by name; a family that isn't named here is any type.
FAMILIES = {
    "whole": _WHOLE,
    "number": (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType),
    "text": (T.StringType, T.VarcharType, T.CharType),
    "truth": (T.BooleanType,),
    "bytes": (T.BinaryType,),
    "codes": (T.ArrayType,),
    "moment": (T.StructType,),
    "any": (T.DataType,),
}

KEY = {"volume_id": "any", "sweep_idx": "whole"}
#: Gates by index: what filters and detectors need.
CELLS = {**KEY, "az_idx": "whole", "gate_idx": "whole", "value": "number", "status": "text"}
#: Gates with their place.
PLACED = {**CELLS, "azimuth_deg": "number", "az_spacing_deg": "number", "first_gate_km": "number", "gate_interval_km": "number", "elevation_deg": "number"}
#: One row a radial.
AXIS = {**KEY, "az_idx": "whole", "azimuth_deg": "number", "az_spacing_deg": "number"}
#: Points on a field's circle, and on its plane.
DIRECTIONS = {**KEY, "azimuth_deg": "number"}
POINTS = {**DIRECTIONS, "range_km": "number"}
#: Pixels with values.
PIXELS = {"x": "whole", "y": "whole", "value": "number"}
#: What extracting fields needs of radials besides the moment itself.
RADIALS = {**KEY, "ordinal": "number", "azimuth_deg": "number", "azimuth_spacing_deg": "number", "elevation_deg": "number"}
#: A product's column of radials.
MOMENT = {"gate_count": "whole", "first_gate_km": "number", "gate_interval_km": "number", "scale": "number", "offset": "number", "raw": "codes"}


class SchemaError(ValueError):
    """A table that lacks a column, or has one of another kind."""


def require(df: DataFrame, contract: dict[str, str], what: str = "table") -> DataFrame:
    """The table itself, if it keeps the contract."""
    _fields(df.schema, contract, what)
    return df


def require_moment(df: DataFrame, product: str, what: str = "radials") -> DataFrame:
    """The table itself, if the product's column is a moment."""
    require(df, {product: "moment"}, what)
    _fields(df.schema[product].dataType, MOMENT, f"{what}: {product}")
    return df


def _fields(schema: T.StructType, contract: dict[str, str], what: str) -> None:
    have = {f.name.lower(): f for f in schema.fields}
    for name, family in contract.items():
        field = have.get(name.lower())
        if field is None:
            raise SchemaError(f"{what}: column {name} is missing")
        if not isinstance(field.dataType, FAMILIES[family]):
            raise SchemaError(f"{what}: column {name} is {field.dataType.simpleString()}, not {family}")


def checked(**contracts: dict[str, str]) -> Callable:
    """Checks DataFrame parameters by name before the function is called."""

    def wrap(work: Callable) -> Callable:
        signature = inspect.signature(work)

        @functools.wraps(work)
        def run(*args, **kwargs):
            given = signature.bind(*args, **kwargs).arguments
            for name, contract in contracts.items():
                if isinstance(given.get(name), DataFrame):
                    require(given[name], contract, f"{work.__name__}: {name}")
            return work(*args, **kwargs)

        run.contracts = contracts
        return run

    return wrap
