"""Reading, writing and promoting corpora made from the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docquarry.gallery.registry import CUSTOMER_ID, EVENT_ID, query, uid_sql
from docquarry.plans.query import Q, find
from docquarry.session import work_folder
from docquarry.sources import tables as t
from docquarry.operators.structure import flatten_fields
from docquarry.operators.validation import split_valid, validate
from docquarry.sources.catalog import read_catalog
from docquarry.sources.documents import (
    documents_from_text,
    queryable_columns,
    read_corpus,
    read_documents,
    write_corpus,
)


def _wire(df):
    """A canonical corpus as JSON text in the wire shape."""
    header = F.struct("class_name", "class_version", "superclasses", "schema_version")
    blocks = F.map_concat(
        F.create_map(
            F.lit("document_class"), F.to_variant_object(header), F.lit("depends_on"), F.to_variant_object("depends_on")
        ),
        F.col("body").cast("map<string,variant>"),
    )
    return df.select(F.to_json(F.to_variant_object(blocks)).alias("value"))


@query(
    "read_documents",
    f"""SELECT {CUSTOMER_ID} AS id, c_name AS name, 'customer' AS class_name, 'base,party,customer' AS lineage,
               {uid_sql("'nation:'||c_nationkey")} AS document_id, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer""",
)
def read_documents_query(spark, folder):
    path = work_folder(spark, "documents")
    _wire(t.opened(t.customers(spark, folder))).write.text(path)
    docs = read_documents(spark, path)
    return docs.select(
        "id",
        "name",
        "class_name",
        F.array_join("lineage", ",").alias("lineage"),
        F.get("depends_on", F.lit(0))["document_id"].alias("document_id"),
        F.try_variant_get("body", "$.party.acctbal", "double").alias("acctbal"),
        F.try_variant_get("body", "$.customer.mktsegment", "string").alias("segment"),
    )


@query(
    "documents_from_text",
    f"""SELECT {EVENT_ID} AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def documents_from_text_query(spark, folder):
    docs = documents_from_text(_wire(t.opened(t.events(spark, folder, heavy=True))))
    return docs.select(
        "id",
        F.col("datestamp_raw").alias("stamp"),
        F.unix_seconds("datestamp").alias("seconds"),
        F.try_variant_get("body", "$.event.props.k", "bigint").alias("k"),
    )


@query(
    "promoted_corpus",
    """SELECT class_name, count(*) AS n_documents FROM (
         SELECT 'customer' AS class_name FROM customer WHERE c_acctbal > 5000 AND c_custkey % 7 <> 0
         UNION ALL SELECT 'supplier' FROM supplier WHERE s_acctbal > 5000) GROUP BY class_name""",
)
def promoted_corpus(spark, folder):
    path = work_folder(spark, "corpus")
    customers = t.customers(spark, folder)
    # The balance of every seventh customer is text, which no number test may match.
    odd = F.col("customer.key") % 7 == 0
    named = customers.where(odd).withColumn("party", F.col("party").withField("acctbal", F.col("party.acctbal").cast("string")))
    docs = t.opened(customers.where(~odd))
    for more in (named, t.suppliers(spark, folder), t.orders(spark, folder)):
        docs = docs.unionByName(t.opened(more))
    write_corpus(docs, path, promote=queryable_columns(t.CATALOG, ["customer", "supplier"]))
    stored = read_corpus(spark, path)
    # Asked by its path in the document, the balance is read from its own column.
    parties = find(stored, Q("", "isa", "party") & Q("party.acctbal", "greaterthan", 5000), t.CATALOG, snapshot_checked=True)
    return parties.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "shredded_corpus",
    """SELECT class_name, count(*) AS n_documents FROM (
         SELECT 'customer' AS class_name FROM customer WHERE c_acctbal > 5000 AND c_custkey % 7 <> 0
         UNION ALL SELECT 'supplier' FROM supplier WHERE s_acctbal > 5000) GROUP BY class_name""",
)
def shredded_corpus(spark, folder):
    """As promoted_corpus, without columns of its own: the scan reads the path from the stored body."""
    path = work_folder(spark, "shredded")
    customers = t.customers(spark, folder)
    odd = F.col("customer.key") % 7 == 0
    named = customers.where(odd).withColumn("party", F.col("party").withField("acctbal", F.col("party.acctbal").cast("string")))
    docs = t.opened(customers.where(~odd))
    for more in (named, t.suppliers(spark, folder), t.orders(spark, folder)):
        docs = docs.unionByName(t.opened(more))
    write_corpus(docs, path)
    parties = find(read_corpus(spark, path), Q("", "isa", "party") & Q("party.acctbal", "greaterthan", 5000), t.CATALOG, snapshot_checked=True)
    return parties.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "unreadable_documents",
    """SELECT sink, rule, count(*) AS n_documents FROM (
         SELECT CASE WHEN c_custkey % 6 < 4 OR c_acctbal < 0 THEN 'quarantine' ELSE 'valid' END AS sink,
                CASE c_custkey % 6 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'document_class'
                     WHEN 3 THEN 'depends_on' ELSE '' END AS rule FROM customer) GROUP BY sink, rule""",
)
def unreadable_documents(spark, folder):
    """Broken lines, bare arrays, documents without a header and without dependencies."""
    path = work_folder(spark, "broken")
    lines = _wire(t.opened(t.customers(spark, folder)))
    kind = F.get_json_object("value", "$.customer.key").cast("long") % 6
    broken = (
        F.when(kind == 0, F.substring("value", 1, 20))
        .when(kind == 1, F.concat(F.lit("["), "value", F.lit("]")))
        .when(kind == 2, F.replace("value", F.lit('"document_class"'), F.lit('"other"')))
        .when(kind == 3, F.replace("value", F.lit('"depends_on"'), F.lit('"others"')))
        .otherwise(F.col("value"))
    )
    lines.select(broken.alias("value")).write.text(path)
    good, bad = split_valid(validate(read_documents(spark, path), t.CATALOG, classes=["customer"]))
    rule = (
        F.when(F.col("unreadable").isNotNull() & F.col("source_file").isNotNull(), "unreadable")
        .when(F.array_contains("envelope_gaps", "document_class"), "document_class")
        .when(F.array_contains("envelope_gaps", "depends_on"), "depends_on")
        .otherwise("")
    )
    parts = [df.select(F.lit(name).alias("sink"), rule.alias("rule")) for name, df in (("valid", good), ("quarantine", bad))]
    return parts[0].unionByName(parts[1]).groupBy("sink", "rule").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "catalog_from_files",
    """SELECT block, field, count(*) AS n_documents, count(value) AS n_values FROM (
         SELECT c.block, c.field, CASE c.field WHEN 'mktsegment' THEN c_mktsegment WHEN 'key' THEN c_custkey::VARCHAR ELSE c_acctbal::VARCHAR END AS value
         FROM customer, (VALUES ('customer', 'key'), ('customer', 'mktsegment'), ('party', 'acctbal')) c(block, field))
       GROUP BY block, field""",
)
def catalog_from_files(spark, folder):
    """Class files written in tier folders and read back say which fields a document has."""
    root = work_folder(spark, "classes")
    tiers = [("stable", t.DEFINITIONS[::2]), ("draft", t.DEFINITIONS[1::2])]
    for tier, definitions in tiers:
        for d in definitions:
            one = spark.createDataFrame([(json.dumps(d),)], "value string").coalesce(1)
            one.write.text(f"{root}/{tier}/{d['document_class']['class_name']}", compression="none")
    catalog = read_catalog(spark, root, pattern="*.txt")
    rows = flatten_fields(t.opened(t.customers(spark, folder)), catalog)
    wanted = rows.where(F.col("field").isin("key", "mktsegment", "acctbal"))
    return wanted.groupBy("block", "field").agg(F.count(F.lit(1)).alias("n_documents"), F.count("value").alias("n_values"))
