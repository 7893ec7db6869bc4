"""References kept by their target, and integrity that follows changes.

A corpus answers "what refers to this document" only by a scan.  :class:`ReferenceIndex` holds one
narrow row per reference in a table by hash bucket of the target, so a lookup opens the buckets
of the ids it asks for.  :class:`IntegrityIndex` keeps the integrity report beside it: a batch of
added and withdrawn documents is compared with the references to them and the targets of their
own, and the findings that appear or vanish are appended as counts of 1 and -1.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquarry.operators.structure import dependencies
from docquarry.session import cut_lineage
from docquarry.sources.catalog import Catalog
from docquarry.sources.keyed import KeyedTable

_REFERENCE = ("target", "id", "class_name", "dep_name", "dep_base_name")


def signed(added: DataFrame, withdrawn: DataFrame | None, *columns: str) -> DataFrame:
    """Documents with ``n``: 1 where they come, -1 where they go."""
    out = added.select(*columns, F.lit(1).cast("long").alias("n"))
    if withdrawn is None:
        return out
    return out.unionByName(withdrawn.select(*columns, F.lit(-1).cast("long").alias("n")))


def summed(rows: DataFrame) -> DataFrame:
    """Equal rows as one with the sum of their ``n``; rows that cancel out vanish."""
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n")).where("n <> 0")


@dataclass(frozen=True)
class ReferenceIndex:
    """Non-empty references by target: (target, id, class_name, dep_name, dep_base_name, n).

    ``n`` counts equal references (a document may be stored twice).  Documents that go are given
    to ``update`` as they were stored.
    """

    path: str
    buckets: int = 64

    @cached_property
    def table(self) -> KeyedTable:
        kinds = ", ".join(f"{c} string" for c in _REFERENCE)
        return KeyedTable(self.path, "target", f"{kinds}, n long", self.buckets, counted="n")

    @staticmethod
    def references(changes: DataFrame) -> DataFrame:
        """The references of :func:`signed` documents (id, class_name, depends_on, n)."""
        edges = dependencies(changes, "class_name", "n").where(F.col("document_id") != "")
        return summed(edges.withColumnRenamed("document_id", "target").select(*_REFERENCE, "n"))

    def update(self, added: DataFrame, batch: int, withdrawn: DataFrame | None = None) -> None:
        self.table.append(self.references(signed(added, withdrawn, "id", "class_name", "depends_on")), batch)

    def referring(self, targets: DataFrame, before: int, dep_name: str | None = None) -> DataFrame:
        """References to the ids in ``targets`` (column ``id``), of one role or of all."""
        found = self.table.lookup(targets.select(F.col("id").alias("target")), before)
        return found if dep_name is None else found.where(F.col("dep_name") == dep_name)

    def depends_on(self, spark: SparkSession, dep_name: str, target: str, before: int) -> DataFrame:
        """(id, class_name) of the documents whose ``dep_name`` is ``target``: one bucket is read."""
        one = spark.createDataFrame([(target,)], "id string")
        return self.referring(one, before, dep_name).select("id", "class_name").distinct()

    def follow(self, dep_name: str, found: DataFrame, before: int) -> DataFrame:
        """(id, class_name) of the documents whose ``dep_name`` points into the result of another query."""
        return self.referring(found, before, dep_name).select("id", "class_name").distinct()

    @staticmethod
    def documents(corpus: DataFrame, hits: DataFrame) -> DataFrame:
        """Whole documents for (id, class_name) hits; other classes' partitions aren't read."""
        classes = [r["class_name"] for r in hits.select("class_name").distinct().collect()]  # names of classes
        wanted = hits.select(F.col("id").alias("__id"), F.col("class_name").alias("__class"))
        same = (F.col("id") == F.col("__id")) & (F.col("class_name") == F.col("__class"))
        return corpus.where(F.col("class_name").isin(classes)).join(wanted, same, "left_semi")


def id_key(id_: Column) -> Column:
    """Ids as keys; documents without one share a key that no id has."""
    return F.coalesce(F.concat(F.lit("="), id_), F.lit(""))


@dataclass(frozen=True)
class IntegrityIndex:
    """The report of :func:`docquarry.operators.edges.integrity_report`, kept up to date by batches.

    A batch reads: for the ids that it adds or withdraws their stored rows, for its own
    references the rows of their targets, and, only for ids whose existence or class changed, the
    references to them.  One more reference to a hot target thus costs one row, not all of them.
    """

    path: str
    catalog: Catalog
    buckets: int = 64

    @cached_property
    def references(self) -> ReferenceIndex:
        return ReferenceIndex(f"{self.path}/references", self.buckets)

    @cached_property
    def ids(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/ids", "key", "key string, class_name string, lineage array<string>, n long", self.buckets, counted="n")

    @cached_property
    def findings(self) -> KeyedTable:
        return KeyedTable(f"{self.path}/findings", "key", "key string, id string, rule string, detail string, n long", self.buckets, counted="n")

    @cached_property
    def demanded(self) -> list[str]:
        names = {d.must_refer_to for name in self.catalog.classes for d in self.catalog.dependencies(name)}
        return sorted(names - {"", None})

    def update(self, added: DataFrame, batch: int, withdrawn: DataFrame | None = None) -> None:
        """Take in a batch (numbered from 0); a batch given again replaces what it wrote."""
        changes = cut_lineage(signed(added, withdrawn, "id", "class_name", "lineage", "depends_on"), "changes")
        ids = cut_lineage(summed(changes.select(id_key(F.col("id")).alias("key"), "class_name", "lineage", "n")), "changed-ids")
        references = cut_lineage(ReferenceIndex.references(changes.drop("lineage")), "changed-references")
        asked = ids.select("key").unionByName(references.select(id_key(F.col("target")).alias("key"))).distinct()
        stored = cut_lineage(self.ids.lookup(asked, batch), "stored-ids")
        before = cut_lineage(self._states(stored), "states-before")
        after = cut_lineage(self._states(summed(stored.unionByName(ids))), "states-after")
        touched = ids.select("key").distinct()
        other = self._compared(touched, before, after)
        changed = cut_lineage(other.where(~F.col("same")).select("key"), "changed-states")
        old = self.references.referring(changed.where("key <> ''").select(F.substring("key", 2, 1 << 30).alias("id")), batch)
        old = cut_lineage(old, "references-to-changed")
        copies = other.where("n_before <> n_after")
        count = lambda c, by: copies.where(F.col(c) > 1).select(
            "key", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("id"),
            F.lit("duplicate_id").alias("rule"), F.col(c).cast("string").alias("detail"), F.lit(by).cast("long").alias("n"),
        )
        parts = [
            self._judged(references, after, 1), self._judged(old, after, 1), self._judged(old, before, -1),
            count("n_before", -1), count("n_after", 1),
        ]
        self.findings.append(summed(reduce(DataFrame.unionByName, parts)), batch)
        self.references.table.append(references, batch)
        self.ids.append(ids, batch)

    def report(self, spark: SparkSession, before: int) -> DataFrame:
        """(id, rule, detail) as from scratch, after the batches below ``before``."""
        kept = summed(self.findings.read(spark, before))
        return kept.select("id", "rule", "detail", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("col")

    def _states(self, rows: DataFrame) -> DataFrame:
        """What a key stands for: number of documents, class, and whether it is of each demanded class."""
        return rows.groupBy("key").agg(
            F.sum("n").alias("n_documents"),
            F.min("class_name").alias("target_class"),
            *[F.bool_or(F.array_contains("lineage", c)).alias(f"is_{i}") for i, c in enumerate(self.demanded)],
        )

    def _compared(self, keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
        names = ["target_class", *[f"is_{i}" for i in range(len(self.demanded))]]
        one = before.select("key", F.col("n_documents").alias("n_before"), *[F.col(c).alias(f"{c}_before") for c in names])
        two = after.select("key", F.col("n_documents").alias("n_after"), *[F.col(c).alias(f"{c}_after") for c in names])
        both = keys.join(one, "key", "left").join(two, "key", "left")
        same = F.col("n_before").isNull() == F.col("n_after").isNull()
        for c in names:
            same = same & F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return both.select("key", zero("n_before"), zero("n_after"), same.alias("same"))

    def _judged(self, references: DataFrame, states: DataFrame, by: int) -> DataFrame:
        """Findings of references under the given states, counted ``by`` times."""
        declared = self.catalog.dependencies_table(references.sparkSession).where("must_refer_to <> ''")
        declared = declared.select("class_name", "dep_base_name", "must_refer_to")
        keyed = references.withColumn("key", id_key(F.col("target")))
        dangling = keyed.join(states.select("key"), "key", "left_anti").select(
            "key", "id", F.lit("dangling").alias("rule"), F.col("dep_name").alias("detail"), (F.col("n") * by).alias("n")
        )
        right = F.lit(False)
        for i, c in enumerate(self.demanded):
            right = right | ((F.col("must_refer_to") == c) & F.col(f"is_{i}"))
        bound = keyed.join(F.broadcast(declared), ["class_name", "dep_base_name"])  # metadata
        wrong = bound.join(states, "key").where(~right)
        return dangling.unionByName(
            wrong.select("key", "id", F.lit("mistyped").alias("rule"), F.col("dep_name").alias("detail"), (F.col("n") * by).alias("n"))
        )
