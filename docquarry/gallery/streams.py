"""Streams over the events table, run until the available data is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.gallery.registry import EVENT_ID, query
from docquarry.gallery.conversions import TARGET
from docquarry.session import compute_once, work_folder
from docquarry.sources import tables as t
from docquarry.sources.documents import normalise_wire_shape
from docquarry.streaming import ingest


def event_stream(spark, folder):
    """The events file as a stream of its raw rows."""
    schema = t.table(spark, folder, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def _header(docs, *more):
    return docs.select("id", "session_id", "name", "datestamp_raw", "datestamp", "class_name", "depends_on", *more)


@query(
    "stream_validate",
    """SELECT sink, class_name, count(*) AS n_documents FROM (
         SELECT CASE WHEN event_type IN ('click', 'error') THEN 'quarantine' ELSE 'valid' END AS sink, 'event' AS class_name
         FROM events) GROUP BY sink, class_name""",
)
def stream_validate(spark, folder):
    root = work_folder(spark, "validate")
    docs = t.events(spark, folder, event_stream(spark, folder))
    kind = F.col("event.event_type")
    # Clicks lose their epoch, errors carry an impossible duration.
    docs = docs.withColumn(
        "epochid", F.struct(F.when(kind == "click", "").otherwise(F.col("epochid.epochid")).alias("epochid"))
    ).withColumn(
        "event",
        F.col("event").withField(
            "elapsed.seconds", F.when(kind == "error", F.lit(-1.0)).otherwise(F.col("event.elapsed.seconds"))
        ),
    )
    docs = compute_once(docs, "epochid", "event")
    ingest.stream_validate(
        docs, t.CATALOG, f"{root}/valid", f"{root}/quarantine", f"{root}/state", classes=["event"]
    ).awaitTermination()
    read = lambda name: ingest.read_sink(spark, f"{root}/{name}", _header(docs).schema).select(
        F.lit(name).alias("sink"), "class_name"
    )
    return read("valid").unionByName(read("quarantine")).groupBy("sink", "class_name").agg(
        F.count(F.lit(1)).alias("n_documents")
    )


@query(
    "stream_dedupe_ids",
    f"SELECT {EVENT_ID} AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS datestamp_raw FROM events",
)
def stream_dedupe_ids(spark, folder):
    root = work_folder(spark, "dedupe")
    # Every event is delivered once, and those of one kind three times.
    copies = F.when(F.col("event_type") == "view", F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1)))
    rows = event_stream(spark, folder).withColumn("copy", F.explode(copies)).drop("copy")
    docs = _header(t.events(spark, folder, rows))
    ingest.stream_dedupe_ids(docs, *(f"{root}/{x}" for x in ("sink", "collisions", "ledger", "state")), buckets=8).awaitTermination()
    return ingest.read_sink(spark, f"{root}/sink", docs.schema).select("id", "datestamp_raw")


@query(
    "stream_dedupe_batches",
    f"""SELECT 'sink' AS sink, {EVENT_ID} AS id, 1 AS n FROM events
        UNION ALL SELECT 'collisions', {EVENT_ID}, 1 FROM events WHERE event_type = 'error'""",
)
def stream_dedupe_batches(spark, folder):
    """Three batches: the newer half of the events, then the older half, then all again, of which
    errors have other content under their old ids."""
    root = work_folder(spark, "dedupe-batches")
    rows = t.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    newer = F.col("event_id") % 2 == 0
    changed = F.when(F.col("event_type") == "error", F.col("value") + 1).otherwise(F.col("value"))
    for name, part in (("0", rows.where(newer)), ("1", rows.where(~newer)), ("2", rows.withColumn("value", changed))):
        part.write.option("compression", "zstd").parquet(f"{root}/in/{name}")
        files = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        docs = _header(t.events(spark, folder, files), "event")
        ingest.stream_dedupe_ids(docs, *(f"{root}/{x}" for x in ("sink", "collisions", "ledger", "state")), buckets=8).awaitTermination()
    parts = [
        ingest.read_sink(spark, f"{root}/{name}", docs.schema).select(F.lit(name).alias("sink"), "id")
        for name in ("sink", "collisions")
    ]
    return parts[0].unionByName(parts[1]).groupBy("sink", "id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(
    "stream_integrity",
    """SELECT sink, count(*) AS n_documents FROM (
         SELECT CASE WHEN user_id IN (SELECT s_suppkey FROM supplier) OR event_type = 'view' THEN 'sink' ELSE 'pending' END AS sink
         FROM events) GROUP BY sink""",
)
def stream_integrity(spark, folder):
    root = work_folder(spark, "integrity")
    rows = event_stream(spark, folder)
    docs = t.events(spark, folder, rows)
    # Views refer to an event of the same batch (themselves), others to a stored supplier.
    target = F.when(F.col("event.event_type") == "view", F.col("id")).otherwise(t.uid("supplier:", F.col("event.user_id")))
    docs = _header(docs.withColumn("depends_on", t.entries(source_id=target)))
    ingest.stream_integrity(
        docs, lambda: t.suppliers(spark, folder), f"{root}/sink", f"{root}/pending", f"{root}/state", buckets=8
    ).awaitTermination()
    parts = [
        ingest.read_sink(spark, f"{root}/{name}", docs.schema).select(F.lit(name).alias("sink"))
        for name in ("sink", "pending")
    ]
    return parts[0].unionByName(parts[1]).groupBy("sink").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "stream_integrity_batches",
    f"""WITH r AS (
          SELECT e.event_id, {EVENT_ID.replace("event_id", "e.event_id")} AS id,
                 h.event_id IS NULL OR h.event_type = 'error' AS open_root, l.event_type = 'error' AS open_leaf
          FROM events e LEFT JOIN events h ON h.event_id = e.event_id - e.event_id % 4
                        LEFT JOIN events l ON l.event_id = e.event_id - e.event_id % 4 + 3)
        SELECT id, CASE WHEN open_root OR (open_leaf AND event_id % 4 = 3) THEN 'pending' ELSE 'sink' END AS sink FROM r""",
)
def stream_integrity_batches(spark, folder):
    """Chains of four events that arrive from their far end on, in three batches.

    Each event refers to the one before it; errors refer to something that never comes, so what
    stands behind them in their chain waits for ever, and the rest goes in as a whole with the
    last batch.
    """
    root = work_folder(spark, "integrity-batches")
    rows = t.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    place = F.col("event_id") % 4
    target = (
        F.when((F.col("event_type") == "error") & place.isin(0, 3), F.lit("never"))
        .when(place == 0, F.lit(""))
        .otherwise(t.uid("event:", F.col("event_id") - 1))
    )
    rows = rows.withColumn("props", F.to_json(F.struct(target.alias("target"))))
    for name, places in (("0", (2, 3)), ("1", (1,)), ("2", (0,))):
        rows.where(place.isin(*places)).write.option("compression", "zstd").parquet(f"{root}/in/{name}")
        files = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        docs = t.events(spark, folder, files)
        target = F.try_variant_get("event.props", "$.target", "string")
        docs = _header(docs.withColumn("depends_on", t.entries(source_id=target)))
        ingest.stream_integrity(
            docs, lambda: t.suppliers(spark, folder), f"{root}/sink", f"{root}/pending", f"{root}/state", buckets=8
        ).awaitTermination()
    sink = ingest.read_sink(spark, f"{root}/sink", docs.schema).select("id", F.lit("sink").alias("sink"))
    return sink.unionByName(ingest.read_pending(spark, f"{root}/pending", docs.schema).select("id", F.lit("pending").alias("sink")))


@query(
    "stream_migrate",
    f"""SELECT {EVENT_ID} AS id, 'ontology_label' AS class_name, 'atlas_one:'||user_id AS node, event_type AS name,
               CASE WHEN user_id = 0 THEN 'flagged' ELSE 'migrated' END AS migration_status FROM events""",
)
def stream_migrate(spark, folder):
    root = work_folder(spark, "migrate")
    doc = F.struct(
        F.struct(F.lit("ontologyLabel").alias("class_name"), F.lit("1.0.0").alias("class_version")).alias("document_class"),
        F.struct(t.uid("event:", F.col("event_id")).alias("id")).alias("base"),
        F.struct(
            F.lit("Atlas One").alias("ontology_name"), F.col("event_type").alias("label"), F.col("user_id").alias("label_id")
        ).alias("ontologyLabel"),
    )
    docs = normalise_wire_shape(event_stream(spark, folder).select(F.to_variant_object(doc).alias("doc")))
    ingest.stream_migrate(docs, TARGET, f"{root}/sink", f"{root}/state", only=["ontology_label"]).awaitTermination()
    out = spark.read.parquet(f"{root}/sink")
    term = lambda name: F.try_variant_get("body", f"$.ontology_label.term.{name}", "string").alias(name)
    return out.select("id", "class_name", term("node"), term("name"), "migration_status")
