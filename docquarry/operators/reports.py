"""Roll-ups over a corpus.  Every one aggregates before it explodes or joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.fixed_values import BASE_CLASS
from docquarry.functions.scalars import same_major
from docquarry.sources.catalog import Catalog

UNCATEGORIZED = "Uncategorized"


def class_counts(df: DataFrame) -> DataFrame:
    """Documents per class including descendants, sorted by class name.

    Chains are counted first: what gets exploded is one row per distinct chain.
    """
    return counts_of_chains(df.groupBy("lineage").agg(F.count(F.lit(1)).alias("n")))


def counts_of_chains(chains: DataFrame) -> DataFrame:
    """Documents per class from (lineage, n)."""
    return (
        chains.select(F.explode(F.array_distinct("lineage")).alias("class_name"), "n")
        .groupBy("class_name")
        .agg(F.sum("n").alias("n_documents"))
        .orderBy("class_name")
    )


def topic_paths(topics: Mapping) -> list[tuple[str, str]]:
    """(class, topic path) pairs of a topic tree, one per prefix of the path."""
    out: list[tuple[str, str]] = []

    def visit(category: Mapping, prefixes: tuple[str, ...]) -> None:
        path = f"{prefixes[-1]}/{category['name']}" if prefixes else category["name"]
        chain = (*prefixes, path)
        for class_name in category.get("classes", []):
            out.extend((class_name, p) for p in chain)
        for child in category.get("children", []):
            visit(child, chain)

    for category in topics.get("topics", []):
        visit(category, ())
    out.extend((class_name, class_name) for class_name in topics.get("classes", []))
    return sorted(set(out))


def topic_rollup(df: DataFrame, topics: Mapping) -> DataFrame:
    """Documents per topic path; classes no topic names fall under ``Uncategorized``.

    Order: ``meta``, then ``base``, the rest alphabetically, ``Uncategorized`` last.
    """
    return topics_of_counts(df.groupBy("class_name").agg(F.count(F.lit(1)).alias("n")), topics)


def topics_of_counts(counts: DataFrame, topics: Mapping) -> DataFrame:
    """Documents per topic path from (class_name, n), one row per class."""
    spark = counts.sparkSession
    paths = F.broadcast(spark.createDataFrame(topic_paths(topics), "class_name string, topic string"))
    placed = counts.join(paths, "class_name", "left").withColumn("topic", F.coalesce("topic", F.lit(UNCATEGORIZED)))
    rolled = placed.groupBy("topic").agg(F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_classes"))
    return rolled.orderBy(topic_rank(F.col("topic")), "topic")


def topic_rank(topic: Column) -> Column:
    root = F.substring_index(topic, "/", 1)
    return F.when(root == "meta", 0).when(topic == BASE_CLASS, 1).when(root == UNCATEGORIZED, 3).otherwise(2)


def leaf_counts(catalog: Catalog) -> dict[str, int]:
    """Number of concrete classes below each class (metadata only)."""
    concrete = set(catalog.concrete())
    return {name: len(catalog.descendants(name) & concrete) for name in catalog.classes}


def validation_summary(validated: DataFrame) -> DataFrame:
    """Errors per (rule, class, field) and the documents they occur in.

    Works on rows that still carry their errors: a document is counted at its
    first error of a kind, so neither ids nor a distinct are needed.
    """
    keys = F.transform("errors", lambda e: F.struct(e["rule"], e["declaring_class"], e["field"]))
    rows = validated.select(keys.alias("__keys"), F.posexplode("errors").alias("__at", "error"))
    key = F.get(F.col("__keys"), F.col("__at"))
    first = F.array_position("__keys", key) == F.col("__at") + 1
    return (
        rows.withColumn("__first", first.cast("long"))
        .groupBy(
            F.col("error.rule").alias("rule"),
            F.col("error.declaring_class").alias("declaring_class"),
            F.col("error.field").alias("field"),
        )
        .agg(F.count(F.lit(1)).alias("n_errors"), F.sum("__first").alias("n_documents"))
    )


def session_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.min("datestamp_raw").alias("first_datestamp"),
        F.max("datestamp_raw").alias("last_datestamp"),
    )


def dataset_sessions(df: DataFrame, dataset_field: str = "session_in_a_dataset.dataset_id") -> DataFrame:
    """Sessions per dataset, from the documents that bind a session to a dataset."""
    # distinct pairs first (partial), then a plain count: no task sees one dataset's raw rows.
    return session_pairs(df, dataset_field).distinct().groupBy("dataset_id").agg(F.count("session_id").alias("n_sessions"))


def session_pairs(df: DataFrame, dataset_field: str) -> DataFrame:
    """(dataset_id, session_id) of each document that binds a session to a dataset."""
    from docquarry.operators.structure import field

    session = F.filter("depends_on", lambda d: d["name"] == "session_id")
    return df.select(
        field(df, dataset_field).cast("string").alias("dataset_id"),
        F.get(session, F.lit(0))["document_id"].alias("session_id"),
    ).where("dataset_id is not null")


def unit_summary(df: DataFrame, quantity: str) -> DataFrame:
    """Authored units of a quantity column, with the share of approximate ones."""
    q = F.col(quantity)
    return df.groupBy(q["source_unit"].alias("source_unit"), q["approximate"].alias("approximate")).agg(
        F.count(F.lit(1)).alias("n_documents")
    )


def class_version_drift(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Documents per (class, version) and whether the catalog's MAJOR version still accepts them."""
    counts = df.groupBy("class_name", "class_version").agg(F.count(F.lit(1)).alias("n_documents"))
    known = F.broadcast(
        catalog.classes_table(df.sparkSession).select("class_name", F.col("class_version").alias("catalog_version"))
    )
    return counts.join(known, "class_name", "left").withColumn(
        "compatible", same_major(F.col("class_version"), F.col("catalog_version"))
    )


