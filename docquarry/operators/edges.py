"""Lookups along dependencies.

Edges are skewed by nature (many documents depend on one element), so the hot
side never has to meet in one task: ids are made distinct with a map-side partial
aggregate and written to the shared folder, and the edges stay on the left side of
a join of two plain shuffles.  Only there can AQE divide skewed partitions: an
aggregate or a join right below the join would keep it from doing so.  The written
ids also keep a walk of many steps from repeating the plans of its earlier steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from docquarry.operators.structure import dependencies
from docquarry.session import cut_lineage
from docquarry.sources.catalog import Catalog


def follow(df: DataFrame, dep_name: str, found: DataFrame) -> DataFrame:
    """Documents whose dependency ``dep_name`` points into the result of another query."""
    targets = cut_lineage(found.select(F.col("id").alias("__target")).distinct(), "targets")
    hits = F.transform(F.filter("depends_on", lambda d: d["name"] == dep_name), lambda d: d["document_id"])
    one = df.withColumn("__ref", F.get(hits, F.lit(0)))
    # Repeated roles are legal; only then is one row per reference needed.
    repeated = F.size(hits) > 1
    single = one.where(~repeated).join(targets, F.col("__ref") == F.col("__target"), "left_semi").drop("__ref")
    many = (
        df.withColumn("__row", F.monotonically_increasing_id())
        .where(repeated)
        .withColumn("__ref", F.explode(F.array_distinct(hits)))
        .join(targets, F.col("__ref") == F.col("__target"), "left_semi")
        .dropDuplicates(["__row"])
        .drop("__ref", "__row")
    )
    return single.unionByName(many)


def follow_pairs(df: DataFrame, dep_name: str, found: DataFrame, columns: list[str]) -> DataFrame:
    """Like :func:`follow`, but returns the edges with columns of the referenced document."""
    edges = dependencies(df).where(F.col("dep_name") == dep_name)
    right = found.select(F.col("id").alias("__target"), *columns)
    return edges.join(right, F.col("document_id") == F.col("__target")).drop("__target")


def walk(start: DataFrame, *steps: tuple[DataFrame, str]) -> DataFrame:
    """Chain of :func:`follow` steps: each ``(documents, dep_name)`` points at the previous result."""
    return reduce(lambda found, step: follow(step[0], step[1], found), steps, start)


def known_ids(df: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Ids that may be referenced: stored ones and those queued in the same batch."""
    ids = df.select("id")
    return ids if staged is None else ids.unionByName(staged.select("id"))


def dangling_dependencies(df: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Non-empty references (of stored and staged documents) to ids that do not exist."""
    sources = df.select("id", "depends_on")
    if staged is not None:
        sources = sources.unionByName(staged.select("id", "depends_on"))
    return missing_targets(dependencies(sources), known_ids(df, staged))


def missing_targets(edges: DataFrame, ids: DataFrame) -> DataFrame:
    filled = edges.where(F.col("document_id") != "")
    referenced = filled.select(F.col("document_id").alias("__missing")).distinct()
    missing = cut_lineage(referenced.join(ids, F.col("__missing") == F.col("id"), "left_anti"), "missing")
    return filled.join(missing, F.col("document_id") == F.col("__missing"), "left_semi")


def mistyped_dependencies(df: DataFrame, catalog: Catalog) -> DataFrame:
    """References whose target exists but is not of the class the declaration demands.

    Targets collapse to one row per id first, so repeated ids (an error of their own)
    do not multiply references.
    """
    declared = catalog.dependencies_table(df.sparkSession).where("must_refer_to <> ''")
    edges = dependencies(df.select("id", "class_name", "depends_on"), "class_name").join(
        F.broadcast(declared.select("class_name", "dep_base_name", "must_refer_to")),  # metadata
        ["class_name", "dep_base_name"],
    )
    demanded = sorted({d.must_refer_to for name in catalog.classes for d in catalog.dependencies(name)} - {""})
    if not demanded:
        return edges.where("false").select(
            "id", "class_name", "dep_name", "document_id", "must_refer_to", F.lit("").alias("target_class")
        )
    targets = df.groupBy(F.col("id").alias("__target")).agg(
        F.min("class_name").alias("target_class"),
        *[F.bool_or(F.array_contains("lineage", c)).alias(f"__is_{c}") for c in demanded],
    )
    joined = edges.join(cut_lineage(targets, "target-classes"), F.col("document_id") == F.col("__target"))
    right = None
    for c in demanded:
        same = F.col("must_refer_to") == c
        right = F.when(same, F.col(f"__is_{c}")) if right is None else right.when(same, F.col(f"__is_{c}"))
    return joined.where(~right).select("id", "class_name", "dep_name", "document_id", "must_refer_to", "target_class")


def undeclared_dependencies(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Entries whose role no class of the document's chain declares.

    ``x_3`` is covered by a numbered declaration ``x_#`` only.
    """
    table = catalog.dependencies_table(df.sparkSession)
    edges = dependencies(df.select("id", "class_name", "depends_on"), "class_name")
    numbered = F.broadcast(table.where("multiple").select("class_name", "dep_base_name"))
    single = F.broadcast(
        table.where("not multiple").select("class_name", F.col("dep_base_name").alias("dep_name"))
    )
    plain = edges.join(single, ["class_name", "dep_name"], "left_anti")
    indexed = plain.where("dep_index is not null").join(numbered, ["class_name", "dep_base_name"], "left_anti")
    return plain.where("dep_index is null").unionByName(indexed).select("id", "class_name", "dep_name", "document_id")


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Ids carried by more than one document (partial counts, so a hot id is one row per task)."""
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n_documents")).where("n_documents > 1")


def concept_fields(df: DataFrame, catalog: Catalog, node: str) -> DataFrame:
    """Documents and fields that denote an ontology concept, through the field annotations."""
    wanted = catalog.fields_table(df.sparkSession).where(F.lower("ontology_node") == node.lower())
    return df.select("id", "class_name").join(
        F.broadcast(wanted.select("class_name", "declaring_class", "field")), "class_name"
    )


def integrity_report(df: DataFrame, catalog: Catalog, staged: DataFrame | None = None) -> DataFrame:
    """Phase 2 in one table: dangling and mistyped references, duplicate ids."""
    everything = df if staged is None else df.unionByName(staged.select(*df.columns))
    dangling = dangling_dependencies(df, staged).select(
        "id", F.lit("dangling").alias("rule"), F.col("dep_name").alias("detail")
    )
    mistyped = mistyped_dependencies(everything, catalog).select(
        "id", F.lit("mistyped").alias("rule"), F.col("dep_name").alias("detail")
    )
    repeated = duplicate_ids(everything).select(
        "id", F.lit("duplicate_id").alias("rule"), F.col("n_documents").cast("string").alias("detail")
    )
    return dangling.unionByName(mistyped).unionByName(repeated)


def expand_curies(df: DataFrame, col: str, registry: DataFrame) -> DataFrame:
    """Add ``uri`` and ``prefix_status`` (known, approximate, unknown, malformed) for a CURIE column."""
    from docquarry.functions.terms import curie_local, curie_prefix

    known = registry.select(
        F.lower("prefix").alias("__prefix"), "uri_base", "uri_style", F.col("approximate").alias("__approximate")
    )
    joined = df.withColumn("__curie_prefix", curie_prefix(F.col(col))).join(
        known, F.col("__curie_prefix") == F.col("__prefix"), "left"
    )
    uri = F.when(F.col("uri_style") != "local", F.concat("uri_base", curie_local(F.col(col))))
    status = (
        F.when(F.col("__curie_prefix").isNull(), "malformed")
        .when(F.col("__prefix").isNull(), "unknown")
        .when(F.col("__approximate"), "approximate")
        .otherwise("known")
    )
    return joined.withColumn("uri", uri).withColumn("prefix_status", status).select(*df.columns, "uri", "prefix_status")
