"""Corpus jobs over quantities and ontology terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from docquarry.fixed_values import CANONICAL_FIELD
from docquarry.functions.quantities import canonical, quantity
from docquarry.functions.terms import curie_prefix, lower_prefix, ontology_term
from docquarry.operators.edges import expand_curies


def normalise_quantities(
    df: DataFrame, columns: Mapping[str, tuple[str, str, str]], units: DataFrame | None = None
) -> DataFrame:
    """Turn (value, unit) column pairs into quantity structs.

    ``columns``: new column -> (value column, unit column, dimension).  With the
    built-in factors this is a projection; a caller's own ``units`` table is joined.
    ``unknown_units`` lists the new columns whose unit is not known.
    """
    out = df
    for target, (value, unit, dimension) in columns.items():
        if units is None:
            out = out.withColumn(target, quantity(F.col(value), F.col(unit), dimension))
            continue
        table = units.where(F.col("dimension") == dimension).select(
            F.col("unit").alias("__unit"),
            F.col("exponent10").alias("__exponent"),
            F.col("multiplier").alias("__multiplier"),
            F.col("approximate").alias("__approximate"),
        )
        number = F.col(value).cast("double")
        out = (
            out.join(table, F.col(unit) == F.col("__unit"), "left")
            .withColumn(
                target,
                F.struct(
                    canonical(number, F.col("__exponent"), F.col("__multiplier")).alias(CANONICAL_FIELD[dimension]),
                    F.col("__approximate").alias("approximate"),
                    F.col(unit).alias("source_unit"),
                    number.alias("source_value"),
                ),
            )
            .drop("__unit", "__exponent", "__multiplier", "__approximate")
        )
    unknown = F.array_compact(
        F.array(*[F.when(F.col(t)["approximate"].isNull(), F.lit(t)) for t in columns])
    )
    return out.withColumn("unknown_units", unknown)


def normalise_terms(df: DataFrame, node: str, name: str, registry: DataFrame, target: str = "term") -> DataFrame:
    """Build a term column (prefix lower-cased), its URI and the state of its prefix."""
    built = df.withColumn(
        target, ontology_term(F.coalesce(lower_prefix(F.col(node)), F.lit("")), F.coalesce(F.col(name), F.lit("")))
    ).withColumn("__node", F.col(target)["node"])
    return expand_curies(built, "__node", registry).drop("__node")


def prefix_report(df: DataFrame, columns: Sequence[str], registry: DataFrame) -> DataFrame:
    """Values per prefix and what the registry says about it; counted before the lookup."""
    counted = None
    for column in columns:
        part = df.where(F.col(column).isNotNull()).select(curie_prefix(F.col(column)).alias("prefix"))
        counted = part if counted is None else counted.unionByName(part)
    totals = counted.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_values"))
    known = registry.select(F.lower("prefix").alias("__prefix"), "approximate")
    status = (
        F.when(F.col("prefix").isNull(), "malformed")
        .when(F.col("__prefix").isNull(), "unknown")
        .when(F.col("approximate"), "approximate")
        .otherwise("known")
    )
    joined = totals.join(known, F.col("prefix") == F.col("__prefix"), "left")
    return joined.select("prefix", "n_values", status.alias("prefix_status"))
