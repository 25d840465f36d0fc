"""Fit tables of varying schema to a contract before any job starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Required columns are missing."""


def check_contract(df: DataFrame, name: str, required: Iterable[str],
                   any_of: Iterable[tuple[str, ...]] = ()) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractError(f"{name}: missing required columns {missing}")
    for group in any_of:
        if not set(group) & set(df.columns):
            raise ContractError(f"{name}: needs one of the columns {list(group)}")


def text(df: DataFrame, name: str, default: str | None = None) -> Column:
    """Text with '' as NULL. The default stands in only where the column is absent."""
    if name in df.columns:
        return F.nullif(F.col(name).cast("string"), F.lit("")).alias(name)
    return F.lit(default).cast("string").alias(name)


def number(df: DataFrame, name: str, default: float | None = None) -> Column:
    fallback = F.lit(default).cast("double")
    if name in df.columns:
        return F.coalesce(F.col(name).try_cast("double"), fallback).alias(name)
    return fallback.alias(name)


def status_word(df: DataFrame, name: str = "status", default: str = "unknown") -> Column:
    if name not in df.columns:
        return F.lit(default).alias(name)
    return F.coalesce(F.nullif(F.lower(F.trim(F.col(name).cast("string"))), F.lit("")), F.lit(default)).alias(name)


def platform(df: DataFrame) -> Column:
    """`source_platform`, else `source`, else 'unknown'; empty text counts as missing."""
    have = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("source_platform", "source") if c in df.columns]
    return F.coalesce(*have, F.lit("unknown")).alias("source_platform")


def time_parts(df: DataFrame) -> list[Column]:
    """Year, month, day and hour: the partition columns where present and readable, else from `ts`."""
    parts = {"year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts"), "hour": F.hour("ts")}
    return [
        (F.coalesce(F.col(n).try_cast("int"), part) if n in df.columns else part).cast("int").alias(n)
        for n, part in parts.items()
    ]


def conform_schema(df: DataFrame, name: str, required: Iterable[str], texts: dict[str, str | None],
                   numbers: dict[str, float | None], any_of: Iterable[tuple[str, ...]] = (),
                   with_status: bool = True) -> DataFrame:
    """Project a table onto a fixed schema with defaults, in one `select`."""
    check_contract(df, name, required, any_of)
    return df.select(
        *[text(df, c, d) for c, d in texts.items()],
        platform(df), F.col("ts").cast("timestamp").alias("ts"), *time_parts(df),
        *[number(df, c, d) for c, d in numbers.items()],
        *([status_word(df)] if with_status else []),
    )
