"""Ontology terms and identifiers ``prefix:local`` as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquarry.fixed_values import CLASS_RENAMES, CURIE_PATTERN, FIELD_RENAMES, PREFIXES


def prefix_table(spark: SparkSession, prefixes=PREFIXES) -> DataFrame:
    return spark.createDataFrame(
        [tuple(p) for p in prefixes], "prefix string, uri_base string, uri_style string, approximate boolean"
    )


def ontology_term(node: Column, name: Column) -> Column:
    return F.struct(node.alias("node"), name.alias("name"))


def curie_prefix(curie: Column) -> Column:
    """Lower-cased part before the first colon; NULL when there is none."""
    return F.when(F.contains(curie, F.lit(":")), F.lower(F.substring_index(curie, ":", 1)))


def curie_local(curie: Column) -> Column:
    """Everything after the first colon, kept verbatim."""
    return F.when(F.contains(curie, F.lit(":")), F.regexp_replace(curie, "^[^:]*:", ""))


def curie_from_parts(namespace: Column, local: Column) -> Column:
    return F.concat(F.lower(namespace), F.lit(":"), local.cast("string"))


def normalise_prefix(label: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(label), r"\s+", "_"))


def lower_prefix(curie: Column) -> Column:
    """Lower-case only the prefix of a CURIE; other text is left alone."""
    return F.coalesce(F.concat(curie_prefix(curie), F.lit(":"), curie_local(curie)), curie)


def is_curie(curie: Column) -> Column:
    return curie.rlike(CURIE_PATTERN)


def _rename(name: Column, table: dict[str, str]) -> Column:
    pairs = list(chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def snake_class(name: Column) -> Column:
    return _rename(name, CLASS_RENAMES)


def snake_field(name: Column) -> Column:
    return _rename(name, FIELD_RENAMES)
