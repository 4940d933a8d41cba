"""Comparisons of typed values with a literal, for node filters and for layers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.errors import Failure

CONDITIONS = ("eq", "ne", "gt", "lt", "ge", "le", "isnull", "notnull")
INT_MIN, INT_MAX, NODE_MAX = -(2**31), 2**31 - 1, 2**32 - 1
SQL_TYPES = {"int": "int", "float": "float", "bool": "boolean", "char": "string"}


def parse_value(text: str, kind: str):
    """A literal of the given attribute type, or None if the text is none."""
    text = str(text)
    try:
        if kind == "int":
            value = int(text.strip())
            return value if INT_MIN <= value <= INT_MAX else None
        if kind == "float":
            return float(text.strip())
        if kind == "bool":
            return {"true": True, "false": False}.get(text.strip().lower())
        return text if len(text) == 1 else None
    except ValueError:
        return None


def compare(column: Column, cond: str, value, floating: bool) -> Column:
    """NaN equals itself and comes before every number (Spark itself puts it after them)."""
    if not floating:
        return {"eq": column == value, "ne": column != value, "gt": column > value, "lt": column < value, "ge": column >= value, "le": column <= value}[cond]
    nan = F.isnan(column)
    if isinstance(value, float) and math.isnan(value):
        return {"eq": nan, "ne": ~nan, "gt": ~nan, "lt": F.lit(False), "ge": F.lit(True), "le": nan}[cond]
    value = F.lit(value).cast("float")
    plain = {"eq": column == value, "ne": column != value, "gt": column > value, "lt": column < value, "ge": column >= value, "le": column <= value}[cond]
    return F.when(nan, F.lit(cond in ("lt", "le", "ne"))).otherwise(plain)


def attribute_condition(name: str, kind: str, cond: str, text: str | None) -> Column:
    """True for the nodes that a filter keeps.

    A missing value satisfies `ne` and `isnull` only.  Text that is no value of the type satisfies nothing, but for missing
    values under `ne`.
    """
    if cond not in CONDITIONS:
        raise Failure("InvalidCondition", f"Unknown condition '{cond}'.")
    column = F.col(f"`{name}`")
    if cond == "isnull":
        return column.isNull()
    if cond == "notnull":
        return column.isNotNull()
    if text is None:
        raise Failure("MissingAttributeValue", f"Condition '{cond}' needs a value to compare with.")
    value = parse_value(text, kind)
    if value is None:
        return column.isNull() if cond == "ne" else F.lit(False)
    kept = compare(column, cond, value, kind == "float")
    return F.coalesce(kept, F.lit(True)) if cond == "ne" else F.coalesce(kept, F.lit(False))
