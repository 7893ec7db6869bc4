"""Structured Streaming ingest: validate, deduplicate, check integrity, migrate.

Sinks are tables in folders the caller names; nothing is kept on one machine.
Batches are written under their batch number, so a replayed batch overwrites
itself and every document arrives exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.migration import migrate
from docquarry.operators.validation import split_valid, validate
from docquarry.session import cut_lineage
from docquarry.sources.catalog import Catalog
from docquarry.sources.keyed import KeyedTable, exists


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder that may not have been written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _write(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def read_sink(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Everything written to a sink (before a batch: a replay must not see its first attempt)."""
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    table = _read(spark, path, numbered)
    return (table if before is None else table.where(F.col("batch") < before)).drop("batch")


def run(
    stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_validate(
    stream: DataFrame, catalog: Catalog, valid_path: str, quarantine_path: str, checkpoint: str, classes=None, **kw
) -> StreamingQuery:
    """Phase 1 on arrival: accepted documents and rejected ones (with errors) go to two tables."""
    validated = validate(stream, catalog, classes)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        good, bad = split_valid(batch)
        good.drop("errors").write.mode("overwrite").parquet(_batch_folder(valid_path, batch_id))
        bad.write.mode("overwrite").parquet(_batch_folder(quarantine_path, batch_id))
        batch.unpersist()

    return run(validated, write, checkpoint, **kw)


#: Columns that say how a document arrived; they are no part of its content.
PROVENANCE = ("source_file",)


def content_hash(df: DataFrame) -> Column:
    """Hash of all columns of a row but those of its arrival, whatever their types."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in PROVENANCE]
    return F.sha2(F.to_json(F.struct(*columns)), 256)


#: Ids of the usual form are 16 bytes while they travel; all others have this before their text, and are longer.
_USUAL_ID, _OTHER_ID = r"^[0-9a-f]{16}_[0-9a-f]{16}\z", "\0" * 17


def short_id(of: Column | str) -> Column:
    """An id as bytes: equal where ids are equal, and read back by :func:`full_id`."""
    c = F.col(of) if isinstance(of, str) else of
    return F.when(c.rlike(_USUAL_ID), F.unhex(F.replace(c, F.lit("_"), F.lit("")))).otherwise(F.concat(F.lit(_OTHER_ID), c).cast("binary"))


def full_id(of: Column | str) -> Column:
    c = F.col(of) if isinstance(of, str) else of
    digits = F.lower(F.hex(c))
    usual = F.concat(F.substring(digits, 1, 16), F.lit("_"), F.substring(digits, 17, 16))
    return F.when(F.octet_length(c) == 16, usual).otherwise(F.substring(c.cast("string"), len(_OTHER_ID) + 1, 2**31 - 1))


#: Ledger of the stored ids, beside the sink: one narrow table instead of whole documents.
LEDGER = "id string, content string"


def stream_dedupe_ids(
    stream: DataFrame, sink_path: str, collision_path: str, ledger_path: str, checkpoint: str, buckets: int = 64, **kw
) -> StreamingQuery:
    """Redeliveries are dropped; other documents under an id that is taken are reported.

    Nothing depends on the dates inside documents, which are old by nature, or on the file that
    brought them.  A redelivery has the id and the content of a stored document or of another of
    its batch.  Of different documents that share a new id in one batch that of the smallest hash
    is stored; the others, and those whose id is stored with other content, go to the collision
    table.  Copies of a hot id collapse map-side.  Each batch looks up its own ids in the ledger of
    (id, content), a :class:`KeyedTable`, which opens only files that may hold one of them.
    """
    ledger = KeyedTable(ledger_path, "id", LEDGER, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.select(
            "*",
            short_id(F.coalesce("id", F.lit(""))).alias("__id"),
            F.unhex(content_hash(batch)).alias("__content"),
            F.monotonically_increasing_id().alias("__row"),
        )
        arrived = cut_lineage(named, "arrived")  # row names must not change when a task runs again
        # Ids, hashes and row names are compared; documents travel once, to their verdict.
        pairs = cut_lineage(arrived.groupBy("__id", "__content").agg(F.min("__row").alias("__row")), "pairs")
        stored = ledger.candidates(pairs.select(full_id("__id").alias("id")), batch_id).select(short_id("id").alias("id"), F.unhex("content").alias("__stored"))
        first = pairs.groupBy("__id").agg(F.min("__content").alias("__first")).join(stored, F.col("__id") == F.col("id"), "left")
        held = first.select("__id", F.coalesce("__stored", "__first").alias("__held"), F.col("__stored").isNotNull().alias("__known"))
        same = F.col("__content") == F.col("__held")
        judged = pairs.join(held, "__id").where(~(same & F.col("__known"))).select("__row", "__id", "__content", same.alias("__new"))
        judged = cut_lineage(judged, "judged")
        out = arrived.select("__row", *batch.columns).join(judged.select("__row", "__new"), "__row").persist()
        _write(out.where("__new").select(*batch.columns), _batch_folder(sink_path, batch_id))
        _write(out.where(~F.col("__new")).select(*batch.columns), _batch_folder(collision_path, batch_id))
        new = judged.where("__new").select(full_id("__id").alias("id"), F.lower(F.hex("__content")).alias("content"))
        ledger.append(new, batch_id)
        out.unpersist()

    return run(stream, write, checkpoint, **kw)


# -- acceptance as a whole ---------------------------------------------------------------
def stream_integrity(
    stream: DataFrame,
    stored: Callable[[], DataFrame],
    sink_path: str,
    pending_path: str,
    checkpoint: str,
    buckets: int = 64,
    **kw,
) -> StreamingQuery:
    """A document is accepted when all it refers to is: stored before, accepted earlier, or accepted
    with it.

    ``stored`` reads the ids known before the stream; it is asked once, and its ids are then found
    by bucket.  A document with a reference to an id that
    is unknown, or held only by documents that wait, waits in the pending table, whether the
    reference is its own or reached over others; when the last of them arrives, all go in
    together.  Documents that refer to each other in a ring are accepted together too.  Documents are judged by row: one
    without an id can be accepted but fulfils no reference, and of two with one id one may wait
    while the other, accepted, answers for the id.

    What a batch costs follows from what it touches: waiting references are kept by the id they
    wait for, so the documents that a new id may set free are found from that id, level by level;
    all others stay where they are, unread.  :func:`read_pending` gives the documents that wait.
    """
    state = _IntegrityState(pending_path, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("__row", F.concat(F.lit(f"{batch_id}-"), F.monotonically_increasing_id().cast("string")))
        arrived = cut_lineage(named, "arrived")  # row names must not change when a task runs again
        fresh = arrived.select(F.col("__row").alias("row"), short_id("id").alias("id"), F.transform(_targets(), short_id).alias("targets"))
        state.remember(stored)
        touched = state.set_free(fresh.select("id"), batch_id)
        nodes = fresh.unionByName(touched)
        blocked = blocked_rows(nodes, state.known(nodes, batch_id))
        waits = blocked.select(F.col("row").alias("__row"), F.lit(True).alias("__waits"))
        judged = arrived.join(waits, "__row", "left").persist()
        waiting, fit = judged.where("__waits"), judged.where(F.col("__waits").isNull())
        freed = cut_lineage(touched.select("row", full_id("id").alias("id")).join(blocked, "row", "left_anti"), "freed")
        documents = state.waiting_documents(freed.select("row"), batch.schema, batch_id)
        _write(fit.select(*batch.columns).unionByName(documents), _batch_folder(sink_path, batch_id))
        _write(waiting.select(*batch.columns, "__row"), _batch_folder(pending_path, batch_id))
        waiting = waiting.select(F.col("__row").alias("row"), "id", _targets().alias("targets"))
        state.append(waiting, fit.select("id").unionByName(freed.select("id")), freed.select("row"), batch_id)
        judged.unpersist()

    return run(stream, write, checkpoint, **kw)


def _targets() -> Column:
    """The ids that a document refers to, each once."""
    return F.array_distinct(F.filter(F.transform("depends_on", lambda d: d["document_id"]), lambda t: t != ""))


def blocked_rows(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``nodes`` (row, id, targets) that can't be accepted, where the ids in ``known`` count as met.

    First those with a target that nothing holds; then, round by round, those that refer to an id
    whose last holder was blocked in the round before.  Ids travel once, to find who holds them; an
    id with one holder is from then on a pair of row names, and rounds join these alone.  What
    remains in the end is consistent as a whole, rings included.
    """
    edges = nodes.select("row", F.explode("targets").alias("target"))
    holders = nodes.where(F.col("id").isNotNull()).select(F.col("id").alias("target"), F.col("row").alias("holder"))
    unmet = cut_lineage(edges.join(known.select(F.col("id").alias("target")), "target", "left_anti"), "unmet")
    held = cut_lineage(holders.groupBy("target").agg(F.min("holder").alias("holder"), F.count(F.lit(1)).alias("n")), "held")
    one = F.col("n") == 1
    linked = unmet.join(held, "target", "left").select("row", "n", F.when(one, F.col("holder")).alias("holder"), F.when(~one, F.col("target")).alias("target"))
    linked = cut_lineage(linked, "linked")
    links, many = linked.where(one).select("holder", "row"), linked.where(~one).select("target", "row")
    several = not many.isEmpty()
    if several:
        shared = cut_lineage(holders.join(many.select("target").distinct(), "target", "left_semi"), "shared")
    newly = cut_lineage(linked.where(F.col("n").isNull()).select("row").distinct(), "blocked")
    blocked = newly
    while not newly.isEmpty():
        rows = links.join(newly.select(F.col("row").alias("holder")), "holder", "left_semi").select("row")
        if several:
            at_stake = shared.join(newly, F.col("holder") == F.col("row"), "left_semi").select("target").distinct()
            still = shared.join(at_stake, "target", "left_semi").join(blocked, F.col("holder") == F.col("row"), "left_anti")
            lost = cut_lineage(at_stake.join(still.select("target"), "target", "left_anti"), "lost")
            rows = rows.unionByName(many.join(lost, "target", "left_semi").select("row"))
        newly = cut_lineage(rows.distinct().join(blocked, "row", "left_anti"), "blocked")
        blocked = blocked.unionByName(newly)
    return blocked


class _IntegrityState:
    """What acceptance keeps between batches, each table found by the key that it is asked for."""

    def __init__(self, pending_path: str, buckets: int):
        self.documents = pending_path
        at = lambda name, key, schema: KeyedTable(f"{pending_path}_{name}", key, schema, buckets)
        self.before = at("before", "id", "id string")
        self.ids = at("ids", "id", "id string")
        self.waits = at("waits", "target", "target string, row string, id string, targets array<string>")
        self.freed = at("freed", "row", "row string")

    def set_free(self, ids: DataFrame, batch: int) -> DataFrame:
        """Waiting rows (row, id, targets) that refer to one of the ids, directly or over other waiting rows; ids are short."""
        found = cut_lineage(ids.sparkSession.createDataFrame([], "row string, id binary, targets array<binary>"), "touched")
        delta = ids
        while True:
            asked = delta.select(F.col("id").alias("target")).where(F.col("target").isNotNull())
            waits = self.waits.candidates(asked.select(full_id("target").alias("target")), batch)
            # The target of a row that waits for nothing else needn't travel twice.
            more = F.when(F.size("targets") > 1, F.transform("targets", short_id)).alias("targets")
            waits = waits.select(short_id("target").alias("target"), "row", short_id("id").alias("id"), more)
            hits = waits.join(asked, "target", "left_semi").join(found, "row", "left_anti").dropDuplicates(["row"])
            hits = cut_lineage(hits.select("row", "id", F.coalesce("targets", F.array("target")).alias("targets")), "hits")
            if hits.isEmpty():
                return found
            if self.freed.runs(ids.sparkSession, batch):
                hits = cut_lineage(hits.join(self.freed.candidates(hits, batch), "row", "left_anti"), "touched")
            found, delta = found.unionByName(hits), hits.select("id")

    def remember(self, stored: Callable[[], DataFrame]) -> None:
        """Index the ids known before the stream, unless that was done."""
        ids = stored().select("id")
        if not self.before.runs(ids.sparkSession, 1):
            self.before.append(ids.distinct(), 0)

    def known(self, nodes: DataFrame, batch: int) -> DataFrame:
        """Short ids stored or accepted before, among them all that these rows refer to."""
        asked = nodes.select(F.explode("targets").alias("id")).select(full_id("id").alias("id"))
        return self.ids.candidates(asked, batch).unionByName(self.before.candidates(asked, 1)).select(short_id("id").alias("id"))

    def waiting_documents(self, rows: DataFrame, schema: T.StructType, batch: int) -> DataFrame:
        """Documents of earlier batches under these row names; only the folders of their batches are read."""
        spark = rows.sparkSession
        since = rows.select(F.substring_index("row", "-", 1).cast("long").alias("batch")).where(F.col("batch") < batch).distinct().collect()
        folders = [_batch_folder(self.documents, r["batch"]) for r in since]  # at most a number a batch
        if not folders:
            return spark.createDataFrame([], schema)
        named = T.StructType([*schema.fields, T.StructField("__row", T.StringType())])
        kept = spark.read.schema(named).parquet(*folders)
        return kept.join(rows, F.col("__row") == F.col("row"), "left_semi").drop("__row")

    def append(self, waiting: DataFrame, ids: DataFrame, freed: DataFrame, batch: int) -> None:
        self.waits.append(waiting.select(F.explode("targets").alias("target"), "row", "id", "targets"), batch)
        self.ids.append(ids.where(F.col("id").isNotNull()).distinct(), batch)
        self.freed.append(freed, batch)


def read_pending(spark: SparkSession, pending_path: str, schema: T.StructType) -> DataFrame:
    """Documents that wait for a reference after the last batch."""
    named = T.StructType([*schema.fields, T.StructField("__row", T.StringType())])
    waited = read_sink(spark, pending_path, named)
    freed = _read(spark, f"{pending_path}_freed/data", T.StructType.fromDDL("row string, run string, bucket int"))
    return waited.join(freed.select("row"), F.col("__row") == F.col("row"), "left_anti").drop("__row")


def stream_migrate(
    stream: DataFrame, catalog: Catalog, sink_path: str, checkpoint: str, only=None, **kw
) -> StreamingQuery:
    """Migration is a stateless map, so it runs on a stream as it does on a table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(sink_path, batch_id))

    return run(migrate(stream, catalog, only=only), write, checkpoint, **kw)
