"""Column standardization as a dataset job: values, notes, and how often each note occurred."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, spec: dict[str, Callable[[Column], Column]], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """`spec` maps a column to a standardizer returning struct(value, note).

    Returns (key columns, <col>, <col>_note ... in one projection; counts per column and note).
    """
    made = df.select(*key, *[fn(F.col(c)).alias(f"_{c}") for c, fn in spec.items()])
    out = made.select(
        *key,
        *[x for c in spec for x in (F.col(f"_{c}.value").alias(c), F.col(f"_{c}.note").alias(f"{c}_note"))],
    )
    kinds = F.array(
        *[F.struct(F.lit(c).alias("column"), F.regexp_replace(F.col(f"{c}_note"), ": .*$", "").alias("note")) for c in spec]
    )
    notes = out.select(F.explode(kinds).alias("n")).select("n.*").groupBy("column", "note").agg(F.count("*").alias("n"))
    return out, notes


def mask_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace number columns with their masked form; no other output form exists."""
    from folioworks.functions.text import mask_number

    for c in cols:
        df = df.withColumn(c, mask_number(F.col(c)))
    return df
