"""Projection, flat views, arrays, dependencies and tables in fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions.scalars import split_list
from docquarry.gallery.registry import CUSTOMER_ID, EVENT_ID, TEXT_ID, query, uid_sql
from docquarry.operators import structure as s
from docquarry.plans.query import Q, find
from docquarry.sources import tables as t
from docquarry.sources.catalog import Catalog

PART_ID = uid_sql("'part:'||p_partkey")


@query(
    "header",
    """
    SELECT class_name, n_dependencies, blocks, count(*) AS n_documents FROM (
      SELECT 'customer' AS class_name, 1 AS n_dependencies, 'base,customer,party' AS blocks FROM customer
      UNION ALL SELECT 'supplier', 0, 'base,party,supplier' FROM supplier
      UNION ALL SELECT 'order_doc', 1, 'base,order_doc' FROM orders
      UNION ALL SELECT 'event', 0, 'base,epochid,event' FROM events
      UNION ALL SELECT 'element', 0, 'base,element' FROM embeddings
      UNION ALL SELECT 'text_doc', 0, 'base,text_doc' FROM documents
      UNION ALL SELECT 'text_label', 1, 'base,text_label' FROM labels
      UNION ALL SELECT 'page', 0, 'base,page' FROM pages
      UNION ALL SELECT 'part_calc', 1 + p_size % 12, 'base,part_calc' FROM part
      UNION ALL SELECT 'directory', 2, 'base,directory' FROM region
      UNION ALL SELECT 'directory', 2, 'base,directory' FROM nation
      UNION ALL SELECT 'directory', 2, 'base,directory' FROM customer
    ) GROUP BY ALL
    """,
)
def header(spark, folder):
    rows = s.header(t.open_corpus(spark, folder, heavy=True)).withColumn("blocks", F.array_join("blocks", ","))
    return rows.groupBy("class_name", "n_dependencies", "blocks").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "field_paths",
    f"""SELECT {EVENT_ID} AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value,
               strftime(ts, '%Y-%m-%d') AS epochid FROM events""",
)
def field_paths(spark, folder):
    df = t.opened(t.events(spark, folder))
    return df.select(
        "id",
        s.field(df, "event.props.k").cast("bigint").alias("k"),
        s.field(df, "event.value").cast("double").alias("value"),
        s.field(df, "epochid.epochid").cast("string").alias("epochid"),
    )


@query(
    "flatten_fields",
    """
    WITH counts AS (SELECT (SELECT count(*) FROM customer) AS n_c, (SELECT count(*) FROM part) AS n_p)
    SELECT class_name, position, declaring_class, block, field, n_documents FROM (
      SELECT 'customer' AS class_name, v.*, n_c AS n_documents FROM counts,
        (VALUES (0,'base','base','id'),(1,'base','base','session_id'),(2,'base','base','name'),(3,'base','base','datestamp'),
                (4,'party','party','nation'),(5,'party','party','acctbal'),
                (6,'customer','customer','key'),(7,'customer','customer','mktsegment')) v(position, declaring_class, block, field)
      UNION ALL
      SELECT 'part_calc', v.*, n_p FROM counts,
        (VALUES (0,'base','base','id'),(1,'base','base','session_id'),(2,'base','base','name'),(3,'base','base','datestamp'),
                (4,'calculation','part_calc','input'),(5,'part_calc','part_calc','brand'),
                (6,'part_calc','part_calc','retailprice')) v(position, declaring_class, block, field)
    )
    """,
)
def flatten_fields(spark, folder):
    docs = t.opened(t.customers(spark, folder)).unionByName(t.opened(t.parts(spark, folder)))
    flat = s.flatten_fields(docs, t.CATALOG)
    return flat.groupBy("class_name", "position", "declaring_class", "block", "field").agg(
        F.count("value").alias("n_documents")
    )


@query(
    "field_rows",
    f"""SELECT id, block, field, value FROM (
          SELECT {CUSTOMER_ID} AS id, 'party' AS block, 'nation' AS field, CAST(c_nationkey AS VARCHAR) AS value FROM customer
          UNION ALL SELECT {CUSTOMER_ID}, 'customer', 'key', CAST(c_custkey AS VARCHAR) FROM customer
          UNION ALL SELECT {CUSTOMER_ID}, 'customer', 'mktsegment', c_mktsegment FROM customer)""",
)
def field_rows(spark, folder):
    rows = s.field_rows(t.opened(t.customers(spark, folder)))
    wanted = rows.where((F.col("block") != "base") & (F.col("field") != "acctbal"))
    return wanted.select("id", "block", "field", F.col("value").cast("string").alias("value"))


@query(
    "placed_field",
    f"SELECT {PART_ID} AS id, 'part_calc' AS block, p_size AS size FROM part WHERE p_size > 40",
)
def placed_field(spark, folder):
    block = s.block_of(t.CATALOG, "part_calc", "input")
    found = find(t.parts(spark, folder), Q(f"{block}.input.size", "greaterthan", 40))
    return found.select("id", F.lit(block).alias("block"), F.col(f"{block}.input.size").alias("size"))


@query(
    "explode_structures",
    f"""SELECT {TEXT_ID} AS id, CAST(i - 1 AS INTEGER) AS position, len(lines[i]) AS n_chars
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) d,
             LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)""",
)
def explode_structures(spark, folder):
    rows = s.explode_structures(t.text_docs(spark, folder, heavy=True), "text_doc.lines", position=True)
    return rows.select("id", "position", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "dependencies",
    f"""SELECT {PART_ID} AS id, 'supplier_'||i AS dep_name, 'supplier' AS dep_base_name, CAST(i AS INTEGER) AS dep_index,
               {uid_sql("'supplier:'||((p_partkey + i) % 100)")} AS document_id
        FROM part, LATERAL (SELECT unnest(range(1, 2 + p_size % 12)) AS i)""",
)
def dependencies(spark, folder):
    return s.dependencies(t.parts(spark, folder))


@query(
    "numbered_dependencies",
    f"""SELECT {PART_ID} AS id,
          array_to_string([{uid_sql("'supplier:'||((p_partkey + i) % 100)")} for i in range(1, 2 + p_size % 12)], ',') AS suppliers
        FROM part""",
)
def numbered_dependencies(spark, folder):
    return t.parts(spark, folder).select(
        "id", F.array_join(s.numbered_dependencies("supplier_#"), ",").alias("suppliers")
    )


@query(
    "split_list",
    f"""SELECT {TEXT_ID} AS id, CAST(len(string_split(text, ',')) AS INTEGER) AS n_parts,
               trim(string_split(text, ',')[-1]) AS last_part
        FROM documents""",
)
def split_list_query(spark, folder):
    parts = split_list(F.col("text_doc.text"))
    # A blank text gives an empty list, which has no last element; to the SQL it is one empty part.
    n_parts = F.size(parts)
    last_part = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.when(n_parts == 0, F.lit("")))
    return t.text_docs(spark, folder).select(
        "id", (n_parts + (n_parts == 0).cast("int")).alias("n_parts"), last_part.alias("last_part")
    )


def _table_rows(spark, folder):
    """A part as a table row: parallel lists plus keyed data."""
    part = t.table(spark, folder, "part")
    return part.select(
        t.uid("part:", F.col("p_partkey")).alias("id"),
        F.struct(
            F.lit("Brand, Type ,Size").alias("names"),
            F.lit("brand,type,size").alias("variable_names"),
            F.lit("empty:1,empty:2,empty:3").alias("ontology_nodes"),
            F.create_map(
                F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"),
                F.lit("size"), F.col("p_size").cast("string"),
            ).alias("data"),
        ).alias("ontology_table_row"),
    )


@query(
    "ontology_table_long",
    f"""SELECT {PART_ID} AS id, position, variable, label, node,
               CASE variable WHEN 'brand' THEN p_brand WHEN 'type' THEN p_type ELSE CAST(p_size AS VARCHAR) END AS value
        FROM part, (VALUES (0,'brand','Brand','empty:1'),(1,'type','Type','empty:2'),(2,'size','Size','empty:3'))
             v(position, variable, label, node)""",
)
def ontology_table_long(spark, folder):
    return s.ontology_table_long(_table_rows(spark, folder))


@query("ontology_table_wide", f"SELECT {PART_ID} AS id, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part")
def ontology_table_wide(spark, folder):
    long = s.ontology_table_long(_table_rows(spark, folder))
    return s.ontology_table_wide(long, ["brand", "size"])


@query(
    "with_defaults",
    """SELECT coalesce(nullif(p_brand, 'Brand#17'), 'unbranded') AS brand,
              coalesce(CASE WHEN p_size > 10 THEN p_size END, 10) AS size, count(*) AS n_documents
       FROM part GROUP BY ALL""",
)
def with_defaults(spark, folder):
    part = t.table(spark, folder, "part").select(
        F.struct(
            F.nullif(F.col("p_brand"), F.lit("Brand#17")).alias("brand"),
            F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"),
        ).alias("item")
    )
    filled = s.with_defaults(part, {"item.brand": "unbranded", "item.size": 10})
    return filled.groupBy(F.col("item.brand").alias("brand"), F.col("item.size").alias("size")).agg(
        F.count(F.lit(1)).alias("n_documents")
    )


@query(
    "list_and_object_defaults",
    """SELECT layout, tags, x, count(*) AS n_documents FROM (
         SELECT 'typed' AS layout, CASE WHEN p_size > 10 THEN p_brand ELSE 'none,any' END AS tags, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 7 END AS x FROM part
         UNION ALL
         SELECT 'open', CASE WHEN p_size > 10 THEN p_brand ELSE 'none,any' END, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 7 END FROM part)
       GROUP BY ALL""",
)
def list_and_object_defaults(spark, folder):
    """Defaults that are a list and an object, in typed blocks and in open bodies."""
    catalog = Catalog.from_definitions([
        t.define("item", [t.define_field("tags", "char", mustBeScalar=False, default_value=["none", "any"]),
                          t.define_field("place", "structure", default_value={"x": 7})], parents=())
    ])
    size = F.col("p_size")
    typed = t.table(spark, folder, "part").select(
        F.lit("item").alias("class_name"),
        F.struct(
            F.when(size > 10, F.array("p_brand")).alias("tags"), F.when(size % 2 == 0, F.struct(size.alias("x"))).alias("place")
        ).alias("item"),
    )
    lacking = F.to_variant_object(F.map_filter(F.from_json(F.to_json("item"), F.lit("map<string,variant>")), lambda k, v: v.isNotNull()))
    open_ = typed.select("class_name", F.to_variant_object(F.create_map(F.lit("item"), lacking)).alias("body"))
    wanted = s.catalog_defaults(catalog, "item")
    one = s.with_defaults(typed, wanted).select(
        F.lit("typed").alias("layout"), F.array_join("item.tags", ",").alias("tags"), F.col("item.place.x").alias("x")
    )
    two = s.with_defaults(open_, wanted).select(
        F.lit("open").alias("layout"),
        F.array_join(F.try_variant_get("body", "$.item.tags", "array<string>"), ",").alias("tags"),
        F.try_variant_get("body", "$.item.place.x", "int").alias("x"),
    )
    return one.unionByName(two).groupBy("layout", "tags", "x").agg(F.count(F.lit(1)).alias("n_documents"))


@query(
    "matrix_rows",
    """SELECT CAST((i - 1) // 8 AS INTEGER) AS "row", CAST((i - 1) % 8 AS INTEGER) AS col, count(*) AS n,
              min(CAST(embedding[i] AS DOUBLE)) AS lowest, max(CAST(embedding[i] AS DOUBLE)) AS highest
       FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2""",
)
def matrix_rows(spark, folder):
    df = t.elements(spark, folder)
    eight = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice(F.col("element.embedding"), r * 8 + 1, F.lit(8)))
    cells = s.matrix_rows(df.select("id", F.struct(eight.alias("grid")).alias("element")), "element.grid")
    return cells.groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )


@query(
    "parameter_table_long",
    f"""SELECT {PART_ID} AS id, stimulus, parameter_index, parameter,
               CASE WHEN parameter = 'size' THEN p_size + stimulus ELSE p_retailprice * (stimulus + 1) END AS value
        FROM part, (VALUES (0, 0, 'size'), (0, 1, 'price'), (1, 0, 'size'), (1, 1, 'price')) v(stimulus, parameter_index, parameter)""",
)
def parameter_table_long(spark, folder):
    row = lambda n: F.array(
        (F.col("p_size") + n).cast("double"), F.col("p_retailprice") * (n + 1)
    )
    part = t.table(spark, folder, "part").select(
        t.uid("part:", F.col("p_partkey")).alias("id"),
        F.struct(F.lit("size, price").alias("parameter_names"), F.array(row(0), row(1)).alias("table_data")).alias("grid"),
    )
    return s.parameter_table_long(part, "grid.parameter_names", "grid.table_data")


@query(
    "merge_name_values",
    f"SELECT {PART_ID} AS id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part",
)
def merge_name_values(spark, folder):
    part = t.table(spark, folder, "part").select(
        t.uid("part:", F.col("p_partkey")).alias("id"),
        F.struct(
            F.array(F.lit("size"), F.lit("price"), F.lit("absent")).alias("names"),
            F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("values"),
        ).alias("listing"),
    )
    merged = s.merge_name_values(part, "listing.names", "listing.values")
    return merged.select("id", F.col("properties")["size"].alias("size"), F.col("properties")["price"].alias("price"))


@query(
    "inline_csv",
    f"""SELECT {EVENT_ID} AS id, name, value FROM (
          SELECT event_id, event_type AS name, value FROM events
          UNION ALL SELECT event_id, 'user', CAST(user_id AS DOUBLE) FROM events)""",
)
def inline_csv(spark, folder):
    text = F.concat_ws(
        "\n",
        F.lit("name,value"),
        F.concat_ws(",", "event_type", F.col("value").cast("string")),
        F.concat_ws(",", F.lit("user"), F.col("user_id").cast("string")),
        F.lit(""),
    )
    rows = t.table(spark, folder, "events").select(t.uid("event:", F.col("event_id")).alias("id"), text.alias("csv"))
    return s.explode_inline_csv(rows, "csv", "name string, value double")


@query(
    "probe_map",
    """SELECT s_name AS id, name, CAST(reference AS VARCHAR) AS reference, type, devicestring, subjectstring FROM (
         SELECT s_name, 'a' AS name, s_suppkey AS reference, 'n-trode' AS type, 'dev:'||s_nationkey AS devicestring, s_name AS subjectstring FROM supplier
         UNION ALL SELECT s_name, 'b', s_suppkey + 1, 'stimulator', 'dev:0', '' FROM supplier)""",
)
def probe_map(spark, folder):
    lines = F.concat_ws(
        "\n",
        F.lit("name\treference\ttype\tdevicestring\tsubjectstring"),
        F.concat_ws("\t", F.lit("a"), F.col("s_suppkey").cast("string"), F.lit("n-trode"),
                    F.concat(F.lit("dev:"), F.col("s_nationkey").cast("string")), F.col("s_name")),
        F.concat_ws("\t", F.lit("b"), (F.col("s_suppkey") + 1).cast("string"), F.lit("stimulator"), F.lit("dev:0"), F.lit("")),
        F.lit(""),
    )
    rows = t.table(spark, folder, "supplier").select(F.col("s_name").alias("id"), lines.alias("map"))
    return s.explode_probe_map(rows, "map")


@query(
    "typed_class",
    f"""SELECT {EVENT_ID} AS id, event_type, user_id, value, value AS source_value,
               CASE event_type WHEN 'view' THEN 'second' WHEN 'click' THEN 'minute' ELSE 'hour' END AS source_unit,
               CAST(extract(day FROM ts) AS DOUBLE) AS day FROM events""",
)
def typed_class(spark, folder):
    """Events, mixed with customers in an open corpus, as typed columns again."""
    docs = t.opened(t.events(spark, folder, heavy=True)).unionByName(t.opened(t.customers(spark, folder)))
    return s.typed(docs, t.CATALOG, "event").select(
        "id",
        "event.event_type",
        "event.user_id",
        "event.value",
        "event.elapsed.source_value",
        "event.elapsed.source_unit",
        F.get(F.get("event.slot", F.lit(0)), F.lit(0)).alias("day"),
    )


@query(
    "typed_mixed_types",
    """SELECT source_unit, count(*) AS n_documents, count(seconds) AS n_seconds, CAST(sum(first) AS BIGINT) AS first, count(second) AS n_second FROM (
         SELECT CASE WHEN event_type = 'click' THEN NULL ELSE 'hour' END AS source_unit,
                CASE WHEN event_type = 'error' THEN NULL ELSE value END AS seconds,
                user_id AS first, CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS second FROM events)
       GROUP BY source_unit""",
)
def typed_mixed_types(spark, folder):
    """Bodies that hold text for a number, a number for a unit, and text in a list of numbers."""
    catalog = Catalog.from_definitions([
        t.define("sample", [t.define_field("elapsed", "duration"), t.define_field("pair", "integer", mustBeScalar=False)], parents=())
    ])
    kind, value = F.col("event_type"), F.col("value")

    def mixed(condition, other, plain):
        return F.when(condition, F.to_variant_object(F.array(other))).otherwise(F.to_variant_object(F.array(plain)))

    one = lambda v: F.try_variant_get(v, "$[0]", "variant")
    elapsed = F.create_map(
        F.lit("seconds"), one(mixed(kind == "error", value.cast("string"), value)),
        F.lit("source_unit"), one(mixed(kind == "click", F.lit(5), F.lit("hour"))),
    )
    pair = F.array(
        one(F.to_variant_object(F.array("user_id"))), one(mixed(kind == "view", F.col("user_id").cast("string"), F.col("user_id")))
    )
    block = F.create_map(F.lit("elapsed"), F.to_variant_object(elapsed), F.lit("pair"), F.to_variant_object(pair))
    docs = t.table(spark, folder, "events").select(
        F.lit("sample").alias("class_name"), F.to_variant_object(F.create_map(F.lit("sample"), F.to_variant_object(block))).alias("body")
    )
    typed = s.typed(docs, catalog, "sample")
    return typed.groupBy(F.col("sample.elapsed.source_unit").alias("source_unit")).agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count("sample.elapsed.seconds").alias("n_seconds"),
        F.sum(F.get("sample.pair", F.lit(0))).alias("first"),
        F.count(F.get("sample.pair", F.lit(1))).alias("n_second"),
    )
