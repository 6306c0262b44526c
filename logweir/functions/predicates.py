"""Field access and the eight condition operators of alert rules."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Condition operators.
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "regex")

# Java's regex engine accepts nearly everything Python's does; these named-group
# forms are the usual difference, so they are rewritten before use.
_PYTHON_GROUP = re.compile(r"\(\?P<(\w+)>")


def field(df: DataFrame, path: str) -> Column | None:
    """Column for a dotted path, or ``None`` when the schema has no such path."""
    node: T.DataType = df.schema
    column: Column | None = None
    parts = path.split(".")
    if parts == ["@timestamp"]:
        parts = ["ts"]
    for depth, part in enumerate(parts):
        if isinstance(node, T.StructType):
            if part not in node.fieldNames():
                return None
            column = F.col(f"`{part}`") if column is None else column.getField(part)
            node = node[part].dataType
        elif isinstance(node, T.MapType):
            rest = ".".join(parts[depth:])
            return F.try_element_at(column, F.lit(rest))
        else:
            return None
    return column


def field_text(df: DataFrame, path: str) -> Column:
    """The field as text, null when absent. Booleans read True/False; timestamps ISO with ms."""
    column = field(df, path)
    if column is None:
        return F.lit(None).cast("string")
    kind = df.select(column.alias("c")).schema["c"].dataType
    if isinstance(kind, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(kind, T.TimestampType):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def matches(df: DataFrame, path: str, operator: str, expected) -> Column:
    """Boolean, never null: does the field satisfy ``operator expected``?"""
    if operator not in OPERATORS:
        raise ValueError(f"Invalid operator {operator!r}; must be one of {sorted(OPERATORS)}")
    text = field_text(df, path)
    if operator == "eq":
        return F.coalesce(text, F.lit("None")) == F.lit(str(expected))
    if operator == "ne":
        return F.coalesce(text, F.lit("None")) != F.lit(str(expected))
    if operator == "contains":
        return F.coalesce(F.contains(text, F.lit(str(expected))), F.lit(False))
    if operator == "regex":
        try:
            re.compile(str(expected))
        except re.error:
            return F.lit(False)
        return F.coalesce(text.rlike(_PYTHON_GROUP.sub(r"(?<\1>", str(expected))), F.lit(False))
    try:
        bound = float(expected)
    except (TypeError, ValueError):
        return F.lit(False)
    number = text.try_cast("double")
    compared = {"gt": number > bound, "gte": number >= bound,
                "lt": number < bound, "lte": number <= bound}[operator]
    # Spark orders NaN above every number; a NaN reading matches nothing here.
    return F.coalesce(compared & ~F.isnan(number), F.lit(False))


def dataset_in(df: DataFrame, datasets: list[str]) -> Column:
    """An empty list means every dataset."""
    if not datasets:
        return F.lit(True)
    return F.coalesce(field(df, "event.dataset").isin(list(datasets)), F.lit(False))
