"""Quantities: exact conversion to the canonical unit, as Column expressions.

Factors are powers of ten or whole seconds.  A power of ten is applied to the
decimal text of the value (one rounding), since ``1.5 * 1e-9`` is not ``1.5e-9``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquarry.fixed_values import CANONICAL_FIELD, CONCENTRATION_FIELDS, CONCENTRATION_UNITS, UNITS

UNIT_SCHEMA = "dimension string, unit string, exponent10 int, multiplier long, approximate boolean"


def units_table(spark: SparkSession, units=UNITS) -> DataFrame:
    """The unit factors as a (small, fixed) table."""
    return spark.createDataFrame([tuple(u) for u in units], UNIT_SCHEMA)


def unit_entry(dimension: str, unit: Column, units=UNITS) -> Column:
    """Look a unit up in a literal map: struct(exponent10, multiplier, approximate) or NULL.

    No join is needed, so this also works inside array lambdas.
    """
    known = [u for u in units if u[0] == dimension]
    pairs = []
    for _, name, exponent, multiplier, approximate in known:
        pairs += [
            F.lit(name),
            F.struct(
                F.lit(exponent).alias("exponent10"),
                F.lit(multiplier).cast("long").alias("multiplier"),
                F.lit(approximate).alias("approximate"),
            ),
        ]
    return F.try_element_at(F.create_map(*pairs), unit)


def shift_decimal(value: Column, exponent: Column) -> Column:
    """``value * 10**exponent`` with a single rounding; NaN and infinities pass through."""
    text = F.upper(value.cast("string"))
    power = F.nullif(F.split_part(text, F.lit("E"), F.lit(2)), F.lit(""))
    total = F.coalesce(power.try_cast("int"), F.lit(0)) + exponent
    shifted = F.concat(F.split_part(text, F.lit("E"), F.lit(1)), F.lit("E"), total.cast("string"))
    return F.when((exponent == 0) | F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(
        shifted.try_cast("double")
    )


def canonical(value: Column, exponent: Column, multiplier: Column) -> Column:
    return shift_decimal(value, exponent) * multiplier


def quantity(value: Column, unit: Column, dimension: str, units=UNITS) -> Column:
    """The composite struct of a dimension; the canonical part is NULL for an unknown unit."""
    entry = unit_entry(dimension, unit, units)
    number = value.cast("double")
    return F.struct(
        canonical(number, entry["exponent10"], entry["multiplier"]).alias(CANONICAL_FIELD[dimension]),
        entry["approximate"].alias("approximate"),
        unit.alias("source_unit"),
        number.alias("source_value"),
    )


def duration(value: Column, unit: Column) -> Column:
    return quantity(value, unit, "duration")


def volume(value: Column, unit: Column) -> Column:
    return quantity(value, unit, "volume")


def mass(value: Column, unit: Column) -> Column:
    return quantity(value, unit, "mass")


def length(value: Column, unit: Column) -> Column:
    return quantity(value, unit, "length")


def voltage(value: Column, unit: Column) -> Column:
    return quantity(value, unit, "voltage")


def current(value: Column, unit: Column) -> Column:
    return quantity(value, unit, "current")


def frequency(value: Column, unit: Column) -> Column:
    return quantity(value, unit, "frequency")


def concentration(value: Column, unit: Column) -> Column:
    """Canonical sub-fields are filled only where the unit can be computed into them."""
    number = value.cast("double")
    filled = []
    for name in CONCENTRATION_FIELDS:
        same = [u for u, target in CONCENTRATION_UNITS.items() if target == name]
        col = F.when(unit.isin(same), number) if same else F.lit(None).cast("double")
        filled.append(col.alias(name))
    return F.struct(
        *filled,
        F.lit(False).alias("approximate"),
        unit.alias("source_unit"),
        number.alias("source_value"),
    )


def convert(value: Column, dimension: str, unit: Column, units=UNITS) -> Column:
    """A quantity struct expressed in another unit of its dimension."""
    entry = unit_entry(dimension, unit, units)
    whole = value.getField(CANONICAL_FIELD[dimension])
    return shift_decimal(whole / entry["multiplier"], -entry["exponent10"])


def to_canonical_literal(value: float, unit: str, dimension: str) -> float:
    """Convert one query literal on the driver."""
    for dim, name, exponent, multiplier, _ in UNITS:
        if (dim, name) == (dimension, unit):
            return float(Decimal(repr(float(value))).scaleb(exponent) * multiplier)
    raise ValueError(f"unknown {dimension} unit {unit!r}")
