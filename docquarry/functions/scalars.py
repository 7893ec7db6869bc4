"""Small expressions shared by the jobs."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from docquarry.fixed_values import SEMVER_PATTERN, TIMESTAMP_PATTERN


def semver(version: Column) -> Column:
    """``MAJOR.MINOR.PATCH`` as an orderable struct; NULL when malformed."""
    part = lambda i: F.regexp_extract(version, SEMVER_PATTERN, i).cast("int")
    return F.when(
        version.rlike(SEMVER_PATTERN),
        F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")),
    )


def same_major(left: Column, right: Column) -> Column:
    return semver(left)["major"] == semver(right)["major"]


def parse_datestamp(text: Column) -> Column:
    """ISO-8601 UTC text to a timestamp; NULL when it has another form or names no calendar instant."""
    return F.when(text.rlike(TIMESTAMP_PATTERN), F.try_to_timestamp(text))


def unwrap_singleton(values: Column) -> Column:
    """``values[0]`` of a one-element array, else NULL (see :func:`singleton_error`)."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def singleton_error(values: Column) -> Column:
    return values.isNotNull() & (F.size(values) != 1)


def bandwidth_octaves(low: Column, high: Column) -> Column:
    """``log2(high / low)`` with the usual floating-point limits at 0 and infinity."""
    inf = F.lit(float("inf"))
    # log2 of a quotient with a zero or infinite side, spelled out: ANSI division by zero would fail.
    return (
        F.when(F.isnan(low) | F.isnan(high), F.lit(float("nan")))
        .when((F.abs(low) == inf) & (F.abs(high) == inf), F.lit(float("nan")))
        .when((low == 0) & (high == 0), F.lit(float("nan")))
        .when((F.abs(high) == inf) | (low == 0), inf)
        .when((F.abs(low) == inf) | (high == 0), -inf)
        .when((high / low) < 0, F.lit(float("nan")))
        .otherwise(F.log2(high / F.when(low != 0, low)))
    )


def split_list(text: Column) -> Column:
    """Comma-separated text to a trimmed array; empty text is an empty array."""
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(text, ","), lambda part: F.trim(part))
    )




def literal_map(table: Mapping[str, object], value_type: str) -> Column:
    """A metadata table as one literal map.

    The JSON text is a single node while the plan is analysed and is folded to a
    constant by the optimizer, so it is parsed once.
    """
    return F.from_json(F.lit(json.dumps(table)), F.lit(f"map<string,{value_type}>"))
