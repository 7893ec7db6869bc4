"""Roll-ups over classes, topics, sessions, units and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.gallery.registry import query, uid_sql
from docquarry.operators import reports as r
from docquarry.operators.rollups import Rollups
from docquarry.session import work_folder
from docquarry.sources import tables as t

_CLASS_ROWS = """
    SELECT 'customer' AS class_name, count(*) AS n FROM customer
    UNION ALL SELECT 'supplier', count(*) FROM supplier
    UNION ALL SELECT 'order_doc', count(*) FROM orders
    UNION ALL SELECT 'event', count(*) FROM events
    UNION ALL SELECT 'element', count(*) FROM embeddings
    UNION ALL SELECT 'text_doc', count(*) FROM documents
    UNION ALL SELECT 'text_label', count(*) FROM labels
    UNION ALL SELECT 'page', count(*) FROM pages
    UNION ALL SELECT 'part_calc', count(*) FROM part
    UNION ALL SELECT 'directory', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer)
"""


@query(
    "class_counts",
    f"""WITH own AS ({_CLASS_ROWS}),
        chain AS (
          SELECT class_name, n FROM own
          UNION ALL SELECT 'base', n FROM own
          UNION ALL SELECT 'party', n FROM own WHERE class_name IN ('customer', 'supplier')
          UNION ALL SELECT 'epochid', n FROM own WHERE class_name = 'event'
          UNION ALL SELECT 'calculation', n FROM own WHERE class_name = 'part_calc')
        SELECT class_name, CAST(sum(n) AS BIGINT) AS n_documents FROM chain GROUP BY class_name""",
)
def class_counts(spark, folder):
    return r.class_counts(t.open_corpus(spark, folder))


TOPICS = {
    "topics": [
        {"name": "texts", "classes": ["text_doc", "page"], "children": [{"name": "labels", "classes": ["text_label"]}]},
        {"name": "meta", "classes": ["directory"]},
        {"name": "trade", "children": [{"name": "parties", "classes": ["customer", "supplier"]}, {"name": "goods", "classes": ["part_calc"]}]},
    ],
    "classes": ["element"],
}
_TOPIC_ROWS = """
    (VALUES ('text_doc', 'texts'), ('page', 'texts'), ('text_label', 'texts'), ('text_label', 'texts/labels'),
            ('directory', 'meta'), ('customer', 'trade'), ('supplier', 'trade'), ('customer', 'trade/parties'),
            ('supplier', 'trade/parties'), ('part_calc', 'trade'), ('part_calc', 'trade/goods'), ('element', 'element'),
            ('order_doc', 'Uncategorized'), ('event', 'Uncategorized')) p(class_name, topic)
"""


@query(
    "topic_rollup",
    f"""SELECT topic, CAST(sum(n) AS BIGINT) AS n_documents, count(*) AS n_classes
        FROM ({_CLASS_ROWS}) own JOIN {_TOPIC_ROWS} USING (class_name) GROUP BY topic""",
)
def topic_rollup(spark, folder):
    return r.topic_rollup(t.open_corpus(spark, folder), TOPICS)


@query(
    "topic_order",
    f"""SELECT topic, row_number() OVER (ORDER BY CASE WHEN topic = 'meta' THEN 0 WHEN topic = 'base' THEN 1
               WHEN topic = 'Uncategorized' THEN 3 ELSE 2 END, topic) AS place
        FROM (SELECT DISTINCT topic FROM ({_CLASS_ROWS}) own JOIN {_TOPIC_ROWS} USING (class_name))""",
)
def topic_order(spark, folder):
    from pyspark.sql import Window

    topics = r.topic_rollup(t.open_corpus(spark, folder), TOPICS)  # one row per topic
    rank = F.row_number().over(Window.orderBy(r.topic_rank(F.col("topic")), "topic"))
    return topics.select("topic", rank.cast("bigint").alias("place"))


@query(
    "session_summary",
    f"""SELECT session_id, count(*) AS n_documents, min(stamp) AS first_datestamp, max(stamp) AS last_datestamp FROM (
          SELECT {uid_sql("'session:user:'||user_id")} AS session_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM events
          UNION ALL SELECT {uid_sql("'session:priority:'||o_orderpriority")}, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') FROM orders
        ) GROUP BY session_id""",
)
def session_summary(spark, folder):
    columns = ["session_id", "datestamp_raw"]
    both = t.events(spark, folder).select(*columns).unionByName(t.orders(spark, folder).select(*columns))
    return r.session_summary(both)


@query(
    "dataset_sessions",
    "SELECT event_type AS dataset_id, count(DISTINCT user_id) AS n_sessions FROM events GROUP BY event_type",
)
def dataset_sessions(spark, folder):
    bound = t.table(spark, folder, "events").select(
        F.struct(F.col("event_type").alias("dataset_id")).alias("session_in_a_dataset"),
        t.entries(session_id=t.uid("session:user:", F.col("user_id"))).alias("depends_on"),
    )
    return r.dataset_sessions(bound)


@query(
    "unit_summary",
    """SELECT CASE event_type WHEN 'view' THEN 'second' WHEN 'click' THEN 'minute' ELSE 'hour' END AS source_unit,
              false AS approximate, count(*) AS n_documents FROM events GROUP BY 1""",
)
def unit_summary(spark, folder):
    return r.unit_summary(t.events(spark, folder), "event.elapsed")


@query(
    "class_version_drift",
    """SELECT 'part_calc' AS class_name, v AS class_version, count(*) AS n_documents, '1.0.0' AS catalog_version,
              split_part(v, '.', 1) = '1' AS compatible
       FROM (SELECT (p_size // 10)||'.'||(p_size % 3)||'.0' AS v FROM part) GROUP BY v""",
)
def class_version_drift(spark, folder):
    size = F.col("part_calc.input.size")
    version = F.concat(F.floor(size / 10).cast("string"), F.lit("."), (size % 3).cast("string"), F.lit(".0"))
    docs = t.parts(spark, folder).withColumn("class_version", version)
    return r.class_version_drift(docs, t.CATALOG)


@query(
    "maintained_rollups",
    f"""WITH d AS (SELECT 'text_doc' AS class_name, {uid_sql("text")} AS id, {uid_sql("'session:lang:'||coalesce(lang, '')")} AS session_id FROM documents)
        SELECT 'class' AS report, c AS name, count(*) AS n FROM d, (VALUES ('base'), ('text_doc')) v(c) GROUP BY c
        UNION ALL SELECT 'topic', 'texts', count(*) FROM d
        UNION ALL SELECT 'session', session_id, count(*) FROM d GROUP BY session_id
        UNION ALL SELECT 'duplicate', id, count(*) FROM d GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'dataset', session_id, 1 FROM d GROUP BY session_id
        UNION ALL SELECT 'error', 'V12', count(*) FROM documents WHERE n_chars > 500 HAVING count(*) > 0""",
)
def maintained_rollups(spark, folder):
    """Texts in three batches, the second of which is tried twice; ids are made from the texts."""
    rollups = Rollups(f"{work_folder(spark, 'rollups')}/texts", dataset_field="text_doc.lang_session", buckets=4)
    rows = t.table(spark, folder, "documents")
    session = t.uid("session:lang:", F.coalesce("lang", F.lit("")))
    error = F.struct(F.lit("V12").alias("rule"), F.lit("text_doc").alias("declaring_class"), F.lit("n_chars").alias("field"))
    docs = rows.select(
        "doc_id", t.uid(F.col("text")).alias("id"), F.lit("text_doc").alias("class_name"), F.array(F.lit("base"), F.lit("text_doc")).alias("lineage"),
        session.alias("session_id"), F.lit(t.FIXED_STAMP).alias("datestamp_raw"), F.struct(session.alias("lang_session")).alias("text_doc"),
        t.entries(session_id=session).alias("depends_on"), F.when(F.col("n_chars") > 500, F.array(error)).otherwise(F.array().cast("array<struct<rule:string,declaring_class:string,field:string>>")).alias("errors"),
    )
    rollups.update(docs.where("doc_id % 3 = 0"), 0)
    rollups.update(docs.where("doc_id % 3 = 1").limit(20), 1)
    rollups.update(docs.where("doc_id % 3 = 1"), 1)
    rollups.update(docs.where("doc_id % 3 = 2"), 2)
    part = lambda report, df, name, n: df.select(F.lit(report).alias("report"), F.col(name).alias("name"), F.col(n).cast("long").alias("n"))
    out = part("class", rollups.class_counts(spark, 3), "class_name", "n_documents")
    for more in (
        part("topic", rollups.topic_rollup(spark, TOPICS, 3), "topic", "n_documents"),
        part("session", rollups.session_summary(spark, 3), "session_id", "n_documents"),
        part("duplicate", rollups.duplicate_ids(spark, 3), "id", "n_documents"),
        part("dataset", rollups.dataset_sessions(spark, 3), "dataset_id", "n_sessions"),
        part("error", rollups.validation_summary(spark, 3), "rule", "n_errors"),
    ):
        out = out.unionByName(more)
    return out
