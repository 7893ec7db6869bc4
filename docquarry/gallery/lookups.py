"""Lookups along dependencies, directory trees, identifiers and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions.terms import prefix_table
from docquarry.gallery.registry import CUSTOMER_ID, ORDER_ID, TEXT_ID, query, uid_sql
from docquarry.operators import directories as d
from docquarry.operators import edges as e
from docquarry.operators.references import IntegrityIndex, ReferenceIndex
from docquarry.plans.query import Q, find
from docquarry.session import work_folder
from docquarry.sources import tables as t
from docquarry.sources.documents import read_manifests

DIRECTORY_ID = uid_sql("'directory:'||c_custkey")
NATION_ID = uid_sql("'nation:'||n_nationkey")
REGION_ID = uid_sql("'region:'||r_regionkey")
LABEL_ID = uid_sql("'text_label:'||l.doc_id")


@query(
    "follow",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0)""",
)
def follow(spark, folder):
    poor = find(
        t.customers(spark, folder),
        Q("customer.mktsegment", "exact_string", "BUILDING") & Q("party.acctbal", "lessthan", 0),
    )
    return e.follow(t.orders(spark, folder), "customer_id", poor).select("id")


@query(
    "follow_pairs",
    f"""SELECT {LABEL_ID} AS id, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE d.lang <> 'en'""",
)
def follow_pairs(spark, folder):
    docs = find(t.text_docs(spark, folder), ~Q("text_doc.lang", "exact_string", "en"))
    flat = docs.select("id", F.col("text_doc.lang").alias("lang"), F.col("text_doc.n_chars").alias("n_chars"))
    return e.follow_pairs(t.text_labels(spark, folder), "text_doc_id", flat, ["lang", "n_chars"]).select(
        "id", "lang", "n_chars"
    )


@query(
    "walk",
    f"""SELECT {ORDER_ID} AS id FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""",
)
def walk(spark, folder):
    directories = t.directories(spark, folder)
    asia = find(directories, Q("directory.dirname", "exact_string", "ASIA"))
    return e.walk(
        asia,
        (directories, "parent_directory_id"),
        (t.customers(spark, folder), "directory_id"),
        (t.orders(spark, folder), "customer_id"),
    ).select("id")


def _known_customers(spark, folder):
    """Customers in debt were never stored, so references to them dangle."""
    return find(t.customers(spark, folder), Q("party.acctbal", "greaterthaneq", 0))


@query(
    "dangling_dependencies",
    f"""SELECT {ORDER_ID} AS id, {uid_sql("'customer:'||o_custkey")} AS document_id FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def dangling_dependencies(spark, folder):
    ids = _known_customers(spark, folder).select("id")
    return e.missing_targets(e.dependencies(t.orders(spark, folder)), ids).select("id", "document_id")


@query(
    "dangling_with_staged",
    f"""SELECT {ORDER_ID} AS id, 'customer_id' AS dep_name FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'MACHINERY')
        UNION ALL
        SELECT {CUSTOMER_ID}, 'directory_id' FROM customer
        WHERE c_acctbal >= 0 OR c_mktsegment = 'MACHINERY'""",
)
def dangling_with_staged(spark, folder):
    keep = ["id", "depends_on"]
    staged = find(
        t.customers(spark, folder),
        Q("party.acctbal", "lessthan", 0) & Q("customer.mktsegment", "exact_string", "MACHINERY"),
    ).select(*keep)
    stored = _known_customers(spark, folder).select(*keep).unionByName(t.orders(spark, folder).select(*keep))
    return e.dangling_dependencies(stored, staged).select("id", "dep_name")


@query(
    "staged_and_stored_ids",
    f"SELECT {CUSTOMER_ID} AS id FROM customer UNION ALL SELECT {ORDER_ID} FROM orders",
)
def staged_and_stored_ids(spark, folder):
    return e.known_ids(t.customers(spark, folder), t.orders(spark, folder))


def _misdirected(spark, folder):
    """Orders of priority 5 refer to a supplier's id where a customer is demanded."""
    orders, suppliers = t.orders(spark, folder), t.suppliers(spark, folder)
    wrong = t.uid("supplier:", F.col("order_doc.key") % 100)
    reference = F.when(F.col("order_doc.priority") == "5-LOW", wrong).otherwise(
        F.get("depends_on", F.lit(0))["document_id"]
    )
    orders = orders.withColumn("depends_on", t.entries(customer_id=reference))
    columns = ["id", "class_name", "lineage", "depends_on"]
    return (
        orders.select(*columns)
        .unionByName(suppliers.select(*columns))
        .unionByName(t.customers(spark, folder).select(*columns))
    )


@query(
    "mistyped_dependencies",
    f"""SELECT {ORDER_ID} AS id, 'customer_id' AS dep_name, 'customer' AS must_refer_to, 'supplier' AS target_class
        FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderkey % 100 IN (SELECT s_suppkey FROM supplier)""",
)
def mistyped_dependencies(spark, folder):
    found = e.mistyped_dependencies(_misdirected(spark, folder), t.CATALOG)
    return found.select("id", "dep_name", "must_refer_to", "target_class")


@query(
    "undeclared_dependencies",
    f"""SELECT {ORDER_ID} AS id, 'customer_id_1' AS dep_name FROM orders
        UNION ALL SELECT {ORDER_ID}, 'payer' FROM orders
        UNION ALL SELECT {uid_sql("'part:'||p_partkey")}, 'supplier' FROM part""",
)
def undeclared_dependencies(spark, folder):
    own = F.get("depends_on", F.lit(0))["document_id"]
    orders = t.orders(spark, folder).withColumn(
        "depends_on", t.entries(customer_id=own, customer_id_1=own, payer=own)
    )
    parts = t.parts(spark, folder).withColumn(
        "depends_on", F.concat("depends_on", t.entries(supplier=F.lit("")))
    )
    columns = ["id", "class_name", "depends_on"]
    both = orders.select(*columns).unionByName(parts.select(*columns))
    return e.undeclared_dependencies(both, t.CATALOG).select("id", "dep_name")


@query(
    "duplicate_ids",
    f"SELECT {uid_sql('text')} AS id, count(*) AS n_documents FROM documents GROUP BY text HAVING count(*) > 1",
)
def duplicate_ids(spark, folder):
    texts = t.text_docs(spark, folder)
    return e.duplicate_ids(texts.select(t.uid(F.col("text_doc.text")).alias("id")))


@query(
    "integrity_report",
    """SELECT rule, count(*) AS n FROM (
         SELECT 'dangling' AS rule FROM orders
           WHERE o_orderpriority = '5-LOW' AND o_orderkey % 100 NOT IN (SELECT s_suppkey FROM supplier)
         UNION ALL SELECT 'dangling' FROM customer
         UNION ALL SELECT 'mistyped' FROM orders
           WHERE o_orderpriority = '5-LOW' AND o_orderkey % 100 IN (SELECT s_suppkey FROM supplier)
         UNION ALL SELECT 'duplicate_id' FROM supplier) GROUP BY rule""",
)
def integrity_report(spark, folder):
    docs = _misdirected(spark, folder)
    again = docs.where("class_name = 'supplier'")
    return e.integrity_report(docs.unionByName(again), t.CATALOG).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# -- references by target ---------------------------------------------------------------------
def _order_index(spark, folder):
    """Orders' references, indexed in three batches."""
    index = ReferenceIndex(f"{work_folder(spark, 'references')}/orders", buckets=16)
    orders = t.orders(spark, folder)
    for batch in range(3):
        index.update(orders.where(F.col("order_doc.key") % 3 == batch), batch)
    return index, orders


@query(
    "indexed_follow",
    f"""SELECT {ORDER_ID} AS id FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0)""",
)
def indexed_follow(spark, folder):
    index, _ = _order_index(spark, folder)
    poor = find(
        t.customers(spark, folder),
        Q("customer.mktsegment", "exact_string", "BUILDING") & Q("party.acctbal", "lessthan", 0),
    )
    return index.follow("customer_id", poor, before=3).select("id")


@query(
    "indexed_depends_on",
    f"SELECT {ORDER_ID} AS id, o_totalprice AS totalprice FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)",
)
def indexed_depends_on(spark, folder):
    """Whole orders of one customer: one bucket of the index, then the partitions of the classes found."""
    index, orders = _order_index(spark, folder)
    first = t.table(spark, folder, "orders").agg(t.uid("customer:", F.min("o_custkey")).alias("id")).first()["id"]
    hits = index.depends_on(spark, "customer_id", first, before=3)
    return index.documents(orders, hits).select("id", F.col("order_doc.totalprice").alias("totalprice"))


@query(
    "incremental_integrity",
    f"""SELECT {ORDER_ID} AS id, 'dangling' AS rule, 'customer_id' AS detail FROM orders
          WHERE CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey % 100 NOT IN (SELECT s_suppkey FROM supplier)
                     ELSE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) END
        UNION ALL SELECT {CUSTOMER_ID}, 'dangling', 'directory_id' FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT {ORDER_ID}, 'mistyped', 'customer_id' FROM orders
          WHERE o_orderpriority = '5-LOW' AND o_orderkey % 100 IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT {uid_sql("'supplier:'||s_suppkey")}, 'duplicate_id', '2' FROM supplier""",
)
def incremental_integrity(spark, folder):
    """Orders come before what they refer to, suppliers come twice, customers in debt go again."""
    index = IntegrityIndex(f"{work_folder(spark, 'integrity')}/index", t.CATALOG, buckets=8)
    docs = _misdirected(spark, folder)
    of = lambda name: docs.where(F.col("class_name") == name)
    customers, suppliers = of("customer"), of("supplier")
    index.update(of("order_doc").unionByName(suppliers), 0)
    index.update(customers.unionByName(suppliers), 1)
    in_debt = find(t.customers(spark, folder), Q("party.acctbal", "lessthan", 0))
    index.update(customers.limit(0), 2, withdrawn=in_debt.select(*docs.columns))
    return index.report(spark, before=3)


# -- directories ----------------------------------------------------------------------------
@query(
    "directories_of",
    f"""SELECT {REGION_ID} AS id FROM region UNION ALL SELECT {NATION_ID} FROM nation
        UNION ALL SELECT {DIRECTORY_ID} FROM customer""",
)
def directories_of(spark, folder):
    owner = spark.range(1).select(t.uid(t.ROOT_KEY)).first()[0]
    return d.directories_of(t.directories(spark, folder), owner).select("id")


@query("children_of", f"SELECT {DIRECTORY_ID} AS id FROM customer WHERE c_nationkey = 3")
def children_of(spark, folder):
    nation = spark.range(1).select(t.uid("nation:3")).first()[0]
    return d.children_of(t.directories(spark, folder), nation).select("id")


@query("top_level_directories", f"SELECT {REGION_ID} AS id FROM region")
def top_level_directories(spark, folder):
    owner = spark.range(1).select(t.uid(t.ROOT_KEY)).first()[0]
    return d.top_level_directories(t.directories(spark, folder), owner).select("id")


@query(
    "directory_tree",
    f"""WITH RECURSIVE dirs AS (
          SELECT {REGION_ID} AS id, r_name AS dirname, '' AS parent FROM region
          UNION ALL SELECT {NATION_ID}, n_name, {uid_sql("'region:'||n_regionkey")} FROM nation
          UNION ALL SELECT {DIRECTORY_ID}, c_name, {uid_sql("'nation:'||c_nationkey")} FROM customer),
        tree AS (
          SELECT id, dirname AS path, 0 AS depth FROM dirs WHERE parent = ''
          UNION ALL SELECT d.id, t.path||'/'||d.dirname, t.depth + 1 FROM dirs d JOIN tree t ON d.parent = t.id)
        SELECT id, path, depth FROM tree""",
)
def directory_tree(spark, folder):
    edges = d.directory_edges(t.directories(spark, folder))
    return d.directory_tree(edges).select("id", "path", "depth")


@query("slot", f"SELECT lower(r_name) AS directory_role, {REGION_ID} AS id FROM region WHERE r_name <> 'ASIA'")
def slot(spark, folder):
    found = d.slot(t.directories(spark, folder)).where("directory_role <> 'asia'")
    return found.select("directory_role", "id")


def _manifests(spark, folder):
    """The orders of a customer are the files of its directory."""
    return t.table(spark, folder, "orders").select(
        t.uid("directory:", F.col("o_custkey")).alias("directory_id"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".json")).alias("filename"),
        F.col("o_orderkey").alias("size"),
        F.md5(F.col("o_orderkey").cast("string")).alias("checksum_sha256"),
    )


@query(
    "manifest_entries",
    f"""SELECT {uid_sql("'directory:'||o_custkey")} AS directory_id, 'order_'||o_orderkey||'.json' AS filename, o_orderkey AS size
        FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def manifest_entries(spark, folder):
    dirs = t.directories(spark, folder)
    return d.manifest_entries(dirs, _manifests(spark, folder)).select("directory_id", "filename", "size")


@query(
    "manifest_count_errors",
    f"""SELECT {DIRECTORY_ID} AS id, CAST(0 AS BIGINT) AS num_entries, count(*) AS n_rows
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
        UNION ALL SELECT {NATION_ID}, CAST(60 AS BIGINT), CAST(0 AS BIGINT) FROM nation""",
)
def manifest_count_errors(spark, folder):
    return d.manifest_count_errors(t.directories(spark, folder), _manifests(spark, folder))


@query(
    "read_manifests",
    f"""SELECT {uid_sql("'nation:'||c_nationkey")} AS directory_id, c_name AS filename, c_custkey AS size,
               md5(c_name) AS checksum_sha256 FROM customer""",
)
def read_manifests_query(spark, folder):
    path = work_folder(spark, "manifests")
    t.table(spark, folder, "customer").select(
        t.uid("nation:", F.col("c_nationkey")).alias("directory_id"),
        F.col("c_name").alias("filename"),
        F.col("c_custkey").alias("size"),
        F.md5("c_name").alias("checksum_sha256"),
    ).write.partitionBy("directory_id").json(path)
    return read_manifests(spark, path).select("directory_id", "filename", "size", "checksum_sha256")


# -- identifiers -------------------------------------------------------------------------------
@query(
    "expand_curies",
    f"""SELECT {TEXT_ID} AS id,
          CASE WHEN lang IN ('en', 'de') THEN 'http://purl.obolibrary.org/obo/UBERON_'||source END AS uri,
          CASE WHEN lang IN ('en', 'de') THEN 'known' WHEN lang = 'fr' THEN 'approximate' ELSE 'unknown' END AS prefix_status
        FROM documents""",
)
def expand_curies(spark, folder):
    nodes = t.text_docs(spark, folder).select("id", F.col("text_doc.subject.node").alias("node"))
    return e.expand_curies(nodes, "node", prefix_table(spark)).select("id", "uri", "prefix_status")


@query(
    "concept_fields",
    """SELECT class_name, declaring_class, field, count(*) AS n_documents FROM (
         SELECT 'customer' AS class_name, 'party' AS declaring_class, 'acctbal' AS field FROM customer
         UNION ALL SELECT 'supplier', 'party', 'acctbal' FROM supplier) GROUP BY ALL""",
)
def concept_fields(spark, folder):
    found = e.concept_fields(t.open_corpus(spark, folder), t.CATALOG, "IAO:0000027")
    return found.groupBy("class_name", "declaring_class", "field").agg(F.count(F.lit(1)).alias("n_documents"))
