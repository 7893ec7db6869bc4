"""Roll-ups that follow a growing corpus.

Each batch adds partial aggregates under its number, a few rows a class, session, dataset or
rule; a report merges them.  Only duplicate ids need more than merging: the ids of a batch are
looked up by bucket, and what changes about them is kept, so that the report reads repeated
ids alone.  A batch that is taken in again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquarry.operators import reports
from docquarry.operators.references import id_key
from docquarry.session import cut_lineage
from docquarry.sources.keyed import KeyedTable


@dataclass(frozen=True)
class Rollups:
    """Reports over all documents taken in before a batch.

    ``dataset_field`` is the path of the dataset's name in the documents that bind a session to it.
    """

    path: str
    dataset_field: str = "session_in_a_dataset.dataset_id"
    buckets: int = 64

    def _table(self, name: str, key: str, schema: str, counted: str, *merged: tuple[str, str], buckets: int = 1) -> KeyedTable:
        return KeyedTable(f"{self.path}/{name}", key, schema, buckets, counted, merged)

    @property
    def chains(self) -> KeyedTable:
        return self._table("chains", "class_name", "class_name string, lineage array<string>, n long", "n")

    @property
    def sessions(self) -> KeyedTable:
        return self._table(
            "sessions", "session_id", "session_id string, n_documents long, first_datestamp string, last_datestamp string",
            "n_documents", ("first_datestamp", "min"), ("last_datestamp", "max"), buckets=self.buckets,
        )

    @property
    def bindings(self) -> KeyedTable:
        return self._table("bindings", "dataset_id", "dataset_id string, session_id string, n long", "n", buckets=self.buckets)

    @property
    def errors(self) -> KeyedTable:
        return self._table(
            "errors", "rule", "rule string, declaring_class string, field string, n_errors long, n_documents long",
            "n_errors", ("n_documents", "sum"),
        )

    @property
    def ids(self) -> KeyedTable:
        return self._table("ids", "key", "key string, id string, n long", "n", buckets=self.buckets)

    @property
    def repeated(self) -> KeyedTable:
        return self._table("repeated", "key", "key string, id string, n_documents long, n long", "n", buckets=self.buckets)

    def update(self, docs: DataFrame, batch: int) -> None:
        """Take in a batch (numbered from 0) of documents; where they carry ``errors``, these too."""
        n = F.count(F.lit(1)).alias("n")
        self.chains.append(docs.groupBy("class_name", "lineage").agg(n), batch)
        self.sessions.append(reports.session_summary(docs), batch)
        self.bindings.append(reports.session_pairs(docs, self.dataset_field).groupBy("dataset_id", "session_id").agg(n), batch)
        if "errors" in docs.columns:
            self.errors.append(reports.validation_summary(docs), batch)
        counts = cut_lineage(docs.groupBy("id").agg(n).select(id_key(F.col("id")).alias("key"), "id", "n"), "new-ids")
        held = self.ids.lookup(counts, batch).select("key", F.col("n").alias("before"))
        both = cut_lineage(counts.join(held, "key", "left").withColumn("before", F.coalesce("before", F.lit(0).cast("long"))), "id-counts")
        row = lambda size, by: both.where(size > 1).select(
            "key", "id", size.alias("n_documents"), F.lit(by).cast("long").alias("n")
        )
        self.repeated.append(row(F.col("before"), -1).unionByName(row(F.col("before") + F.col("n"), 1)), batch)
        self.ids.append(counts, batch)

    def class_counts(self, spark: SparkSession, before: int) -> DataFrame:
        return reports.counts_of_chains(self.chains.read(spark, before))

    def topic_rollup(self, spark: SparkSession, topics: Mapping, before: int) -> DataFrame:
        counts = self.chains.read(spark, before).groupBy("class_name").agg(F.sum("n").alias("n"))
        return reports.topics_of_counts(counts, topics)

    def session_summary(self, spark: SparkSession, before: int) -> DataFrame:
        return self.sessions.read(spark, before)

    def dataset_sessions(self, spark: SparkSession, before: int) -> DataFrame:
        return self.bindings.read(spark, before).groupBy("dataset_id").agg(F.count("session_id").alias("n_sessions"))

    def validation_summary(self, spark: SparkSession, before: int) -> DataFrame:
        return self.errors.read(spark, before)

    def duplicate_ids(self, spark: SparkSession, before: int) -> DataFrame:
        return self.repeated.read(spark, before).select("id", "n_documents")
