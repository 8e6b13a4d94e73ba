"""Scalar functions for untidy report columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_double(text: Column) -> Column:
    """A trimmed text as a number; null if it is empty or none."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def safe_int(text: Column) -> Column:
    """A trimmed text as a whole number, cut towards zero."""
    return safe_double(text).try_cast("int")


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def as_share(v: Column) -> Column:
    """Values above 1 are percent."""
    return F.when(v > 1, v / 100).otherwise(v)


def mean_sd(mean: Column, sd: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, F.coalesce(sd, F.lit(0.0)))


def guarded_ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """``a / b * scale``; null unless ``b`` is positive."""
    return F.when(b > 0, a / b * scale)


def escape_latex(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit("\\_"))


def bold_if(flag: Column, text: Column) -> Column:
    return F.when(flag, F.concat(F.lit("\\textbf{"), text, F.lit("}"))).otherwise(text)


def first_key(json: Column, paths: list[str]) -> Column:
    """The value of the first of ``paths`` that a JSON text has."""
    return F.coalesce(*[F.get_json_object(json, p) for p in paths])


def element_in_turn(items: Column, i: Column) -> Column:
    """Element i of an array that is repeated without end."""
    return F.element_at(items, (i % F.size(items) + 1).cast("int"))


def is_any_of(value: Column, *forms: object) -> Column:
    """Whether a value equals one of ``forms``, compared as text whatever its type."""
    return value.cast("string").isin(*map(str, forms))


def round_half_even(value: Column, digits: int) -> Column:
    """Rounding where a half goes to the even neighbour, on decimals."""
    return F.bround(value, digits)


def standard_pixels(values: Column, mean: float, sd: float, top: float = 255.0) -> Column:
    """Bytes of an image as shares of ``top``, centred and scaled."""
    return F.transform(values, lambda x: (x / top - mean) / sd)


def resize_nearest(values: Column, side: int, new_side: int) -> Column:
    """A square grid at another size; each cell has the value of the old cell that it falls into."""
    old = lambda i: F.floor(i * side / new_side)
    cell = lambda p: F.get(values, (old(F.floor(p / new_side)) * side + old(p % new_side)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(new_side * new_side - 1)), cell)


def _walk(texts: pd.Series, names: pd.Series) -> pd.Series:
    def first(node: object, wanted: list[str]) -> object:
        if isinstance(node, dict):
            for name in wanted:
                if name in node:
                    return node[name]
        inner = node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        return next((x for child in inner if (x := first(child, wanted)) is not None), None)

    def of_row(text: str | None, wanted: str) -> str | None:
        try:
            found = first(json.loads(text), wanted.split("|")) if text else None
        except ValueError:
            return None
        return found if isinstance(found, str) or found is None else json.dumps(found)

    return pd.Series([of_row(t, n) for t, n in zip(texts, names, strict=True)])


def first_key_anywhere(text: Column, names: list[str]) -> Column:
    """The value of the first of ``names`` at any depth of a JSON text; a level's own keys come before what is inside it.

    Null for a text that is no JSON. Depth is not bounded, so this is a Pandas function.
    """
    return F.pandas_udf(_walk, "string")(text, F.lit("|".join(names)))
