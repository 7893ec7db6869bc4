"""A document view of relational tables (customers, orders, events, texts, ...).

Blocks are typed structs, so Catalyst prunes columns and pushes filters through
them; :func:`open_corpus` gives the same documents with a VARIANT body.  Arrays
that grow with a table (the lines of an order, the turns of a conversation) stay
one element per row and are never collected into a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquarry.fixed_values import CURRENT_SCHEMA_VERSION
from docquarry.functions.quantities import duration, voltage
from docquarry.functions.scalars import parse_datestamp
from docquarry.functions.terms import ontology_term
from docquarry.plans.query import ChildTable, Corpus
from docquarry.session import compute_once, spread
from docquarry.sources.catalog import Catalog

FIXED_STAMP = "2024-01-01T00:00:00.000Z"


# -- class definitions ------------------------------------------------------------------
def define(
    name: str,
    fields: Sequence[dict] = (),
    parents: Sequence[str] = ("base",),
    depends_on: Sequence[dict] = (),
    abstract: bool = False,
    version: str = "1.0.0",
) -> dict:
    return {
        "document_class": {
            "class_name": name,
            "class_version": version,
            "superclasses": [{"class_name": p} for p in parents],
            "abstract": abstract,
        },
        "depends_on": list(depends_on),
        "fields": list(fields),
    }


def define_field(name: str, type: str, **extra) -> dict:  # noqa: A002 - the key is called type
    return {
        "name": name,
        "type": type,
        "mustBeNonEmpty": False,
        "mustBeScalar": type != "matrix",
        "mustNotHaveNaN": False,
        "queryable": True,
        "ontology": None,
        "constraints": {},
        **extra,
    }


def define_dependency(name: str, required: bool = True, target: str = "", multiple: bool = False) -> dict:
    return {
        "name": name,
        "mustBeNonEmpty": required,
        "multiple": multiple,
        "must_refer_to_document_class": target,
    }


BASE = define(
    "base",
    [
        define_field("id", "did_uid", mustBeNonEmpty=True),
        define_field("session_id", "did_uid", mustBeNonEmpty=True),
        define_field(
            "name", "char", constraints={"maxLength": 256}, ontology={"node": "schema:name", "name": "name"}
        ),
        define_field("datestamp", "timestamp", mustBeNonEmpty=True),
    ],
    parents=(),
)

LINE_FIELDS = [
    define_field("quantity", "double", constraints={"minimum": 1, "maximum": 45}),
    define_field("discount", "double", mustNotHaveNaN=True, constraints={"max": 0.08}),
    define_field("returnflag", "char", constraints={"enum": ["A", "N"]}),
    define_field("linestatus", "char", mustBeNonEmpty=True),
]

DEFINITIONS = [
    BASE,
    define(
        "party",
        [
            define_field("nation", "integer", constraints={"minimum": 0}),
            define_field("acctbal", "double", ontology={"node": "iao:0000027", "name": "data item"}, constraints={"min": 0}),
        ],
        abstract=True,
    ),
    define(
        "customer",
        [define_field("key", "integer", queryable=False), define_field("mktsegment", "char")],
        parents=("party",),
        depends_on=[define_dependency("directory_id", target="directory")],
    ),
    define("supplier", [define_field("key", "integer", queryable=False)], parents=("party",)),
    define(
        "order_doc",
        [
            define_field("key", "integer", queryable=False),
            define_field("status", "char"),
            define_field("totalprice", "double", constraints={"minimum": 0}),
            define_field("priority", "char"),
            define_field("lines", "structure", mustBeScalar=False, fields=LINE_FIELDS),
        ],
        depends_on=[define_dependency("customer_id", target="customer")],
    ),
    define("epochid", [define_field("epochid", "char", mustBeNonEmpty=True)]),
    define(
        "event",
        [
            define_field("event_type", "char"),
            define_field("user_id", "integer"),
            define_field("value", "double", mustNotHaveNaN=True),
            define_field("slot", "matrix"),
            define_field("elapsed", "duration", constraints={"minimum": 0, "allowed_units": ["second", "minute", "hour"]}),
            define_field("gain", "voltage"),
            define_field("props", "structure", fields=[]),
        ],
        parents=("epochid",),
    ),
    define("element", [define_field("label", "integer"), define_field("embedding", "matrix")]),
    define(
        "text_doc",
        [
            define_field("text", "char", mustBeNonEmpty=True, constraints={"maxLength": 10000, "minLength": 20}),
            define_field("lang", "char", constraints={"enum": ["en", "fr"]}),
            define_field("source", "char", constraints={"pattern": "^src[0-9]$"}),
            define_field("n_chars", "integer", constraints={"minimum": 50, "maximum": 15000}),
            define_field("subject", "ontology_term", constraints={"allowed_namespaces": ["uberon", "schema"]}),
        ],
    ),
    define(
        "text_label",
        [define_field("quality", "integer"), define_field("toxic", "integer")],
        depends_on=[define_dependency("text_doc_id", target="text_doc")],
    ),
    define("page", [define_field("url", "char"), define_field("html", "char", queryable=False)]),
    define(
        "calculation",
        [define_field("input", "structure", fields=[], placement="concrete_class")],
        abstract=True,
    ),
    define(
        "part_calc",
        [define_field("brand", "char"), define_field("retailprice", "double")],
        parents=("calculation",),
        depends_on=[define_dependency("supplier_#", target="supplier", multiple=True)],
    ),
    define(
        "directory",
        [
            define_field("dirname", "char", mustBeNonEmpty=True),
            define_field("directory_role", "char"),
            define_field("num_entries", "integer", constraints={"minimum": 0}),
            define_field("manifest_format", "char"),
        ],
        depends_on=[define_dependency("parent_doc_id"), define_dependency("parent_directory_id", required=False)],
    ),
    define("conversation", [define_field("key", "integer"), define_field("turns", "structure", mustBeScalar=False, fields=[])]),
]
CATALOG = Catalog.from_definitions(DEFINITIONS)


# -- document columns -----------------------------------------------------------------------
def uid(*parts: str | Column) -> Column:
    """A 33-character identifier of a key."""
    digest = F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.concat(F.substring(digest, 1, 16), F.lit("_"), F.substring(digest, 17, 16))


def stamp(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def entries(**ids: Column) -> Column:
    """The ``depends_on`` column for named references."""
    return F.array(*[F.struct(F.lit(n).alias("name"), i.alias("document_id")) for n, i in ids.items()])


NO_DEPENDENCIES = "array<struct<name:string,document_id:string>>"


def document(
    table: DataFrame,
    class_name: str,
    id: Column,  # noqa: A002 - the column is called id
    blocks: dict[str, Column],
    session: Column | None = None,
    name: Column | None = None,
    datestamp: Column | None = None,
    depends_on: Column | None = None,
    version: str = "1.0.0",
    catalog: Catalog = CATALOG,
) -> DataFrame:
    """Canonical header columns plus one typed column per block."""
    raw = F.lit(FIXED_STAMP) if datestamp is None else datestamp
    parents = catalog.ancestors(class_name)
    snapshot = F.array(*[F.struct(F.lit(p).alias("class_name"), F.lit("1.0.0").alias("class_version")) for p in parents])
    return table.select(
        id.alias("id"),
        (uid("session:", F.lit(class_name)) if session is None else session).alias("session_id"),
        (F.lit("") if name is None else name).alias("name"),
        raw.alias("datestamp_raw"),
        parse_datestamp(raw).alias("datestamp"),
        F.lit(class_name).alias("class_name"),
        F.lit(version).alias("class_version"),
        F.lit(CURRENT_SCHEMA_VERSION).alias("schema_version"),
        snapshot.cast("array<struct<class_name:string,class_version:string>>").alias("superclasses"),
        F.array(*[F.lit(c) for c in (*parents, class_name)]).alias("lineage"),
        (F.array().cast(NO_DEPENDENCIES) if depends_on is None else depends_on).alias("depends_on"),
        *[block.alias(n) for n, block in blocks.items()],
    )


def opened(df: DataFrame, read_often: bool = False) -> DataFrame:
    """The same documents with their blocks (and base) in a VARIANT body."""
    base = F.struct("id", "session_id", "name", F.col("datestamp_raw").alias("datestamp"))
    names = [c for c in df.columns if c in CATALOG.classes]
    body = F.to_variant_object(F.struct(base.alias("base"), *[F.col(n) for n in names]))
    out = df.select(*[c for c in df.columns if c not in CATALOG.classes], body.alias("body"))
    return compute_once(out, "body") if read_often else out


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    """A table; ``heavy`` announces CPU-bound narrow work on it."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if heavy else rows


def customers(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    return document(
        table(spark, folder, "customer", heavy),
        "customer",
        uid("customer:", F.col("c_custkey")),
        {
            "party": F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal")),
            "customer": F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("mktsegment")),
        },
        session=uid("session:nation:", F.col("c_nationkey")),
        name=F.col("c_name"),
        depends_on=entries(directory_id=uid("nation:", F.col("c_nationkey"))),
    )


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return document(
        table(spark, folder, "supplier"),
        "supplier",
        uid("supplier:", F.col("s_suppkey")),
        {
            "party": F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("acctbal")),
            "supplier": F.struct(F.col("s_suppkey").alias("key")),
        },
        session=uid("session:nation:", F.col("s_nationkey")),
        name=F.col("s_name"),
    )


def orders(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    return document(
        table(spark, folder, "orders", heavy),
        "order_doc",
        uid("order:", F.col("o_orderkey")),
        {
            "order_doc": F.struct(
                F.col("o_orderkey").alias("key"),
                F.col("o_orderstatus").alias("status"),
                F.col("o_totalprice").alias("totalprice"),
                F.col("o_orderpriority").alias("priority"),
            )
        },
        session=uid("session:priority:", F.col("o_orderpriority")),
        datestamp=stamp("o_orderdate"),
        depends_on=entries(customer_id=uid("customer:", F.col("o_custkey"))),
    )


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The ``order_doc.lines`` array, one element per row."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    )


def order_corpus(spark: SparkSession, folder: str) -> Corpus:
    lines = ChildTable(order_lines(spark, folder), "order_key", "order_doc.key")
    return Corpus(orders(spark, folder), {"order_doc.lines": lines})


def events(spark: SparkSession, folder: str, rows: DataFrame | None = None, heavy: bool = False) -> DataFrame:
    source = table(spark, folder, "events", heavy) if rows is None else rows
    unit = F.when(F.col("event_type") == "view", "second").when(F.col("event_type") == "click", "minute").otherwise("hour")
    tension = F.when(F.col("event_type") == "error", "millivolt").otherwise("microvolt")
    return document(
        source,
        "event",
        uid("event:", F.col("event_id")),
        {
            "epochid": F.struct(F.date_format("ts", "yyyy-MM-dd").alias("epochid")),
            "event": F.struct(
                F.col("event_type"),
                F.col("user_id"),
                F.col("value"),
                F.array(F.dayofmonth("ts").cast("double"), F.hour("ts").cast("double")).alias("slot"),
                duration(F.col("value"), unit).alias("elapsed"),
                voltage(F.col("value"), tension).alias("gain"),
                F.parse_json("props").alias("props"),
            ),
        },
        session=uid("session:user:", F.col("user_id")),
        datestamp=stamp("ts"),
    )


def elements(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    return document(
        table(spark, folder, "embeddings", heavy),
        "element",
        uid("element:", F.col("vec_id")),
        {"element": F.struct(F.col("label"), F.col("embedding"))},
    )


def text_docs(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    words = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            line.alias("text"), F.transform(F.split(line, " "), lambda w: F.struct(w.alias("text"))).alias("words")
        ),
    )
    prefix = F.when(F.col("lang") == "en", "uberon:").when(F.col("lang") == "fr", "placeholder:").when(
        F.col("lang") == "de", "UBERON:"
    ).otherwise("unheard:")
    return document(
        table(spark, folder, "documents", heavy),
        "text_doc",
        uid("text_doc:", F.col("doc_id")),
        {
            "text_doc": F.struct(
                F.col("text"),
                F.col("lang"),
                F.col("source"),
                F.col("n_chars"),
                ontology_term(F.concat(prefix, F.col("source")), F.col("source")).alias("subject"),
                F.split("text", " ").alias("words"),
                words.alias("lines"),
            )
        },
        session=uid("session:source:", F.col("source")),
    )


def text_labels(spark: SparkSession, folder: str) -> DataFrame:
    return document(
        table(spark, folder, "labels"),
        "text_label",
        uid("text_label:", F.col("doc_id")),
        {"text_label": F.struct("quality", "toxic")},
        depends_on=entries(text_doc_id=uid("text_doc:", F.col("doc_id"))),
    )


def pages(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    return document(
        table(spark, folder, "pages", heavy),
        "page",
        uid("page:", F.col("page_id")),
        {"page": F.struct("url", "html")},
    )


def parts(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Parts, each with ``supplier_1`` ... ``supplier_n`` (n = 1 + size mod 12), listed last first."""
    count = F.lit(1) + F.col("p_size") % 12
    numbered = F.transform(
        F.reverse(F.sequence(F.lit(1), count)),
        lambda i: F.struct(
            F.concat(F.lit("supplier_"), i.cast("string")).alias("name"),
            uid("supplier:", (F.col("p_partkey") + i) % 100).alias("document_id"),
        ),
    )
    return document(
        table(spark, folder, "part", heavy),
        "part_calc",
        uid("part:", F.col("p_partkey")),
        {
            "part_calc": F.struct(
                F.struct(F.col("p_size").alias("size")).alias("input"),
                F.col("p_brand").alias("brand"),
                F.col("p_retailprice").alias("retailprice"),
            )
        },
        name=F.col("p_name"),
        depends_on=numbered,
    )


ROOT_KEY = "owner:all"


def directories(spark: SparkSession, folder: str) -> DataFrame:
    """regions > nations > customers as directory documents of one owner."""

    def level(rows, key, dirname, role, parent, num_entries):
        return document(
            rows,
            "directory",
            key,
            {
                "directory": F.struct(
                    dirname.alias("dirname"),
                    role.alias("directory_role"),
                    num_entries.cast("long").alias("num_entries"),
                    F.lit("jsonlines").alias("manifest_format"),
                )
            },
            depends_on=entries(parent_doc_id=uid(ROOT_KEY), parent_directory_id=parent),
        )

    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer")
    none = F.lit("")
    return (
        level(region, uid("region:", F.col("r_regionkey")), F.col("r_name"), F.lower("r_name"), none, F.lit(0))
        .unionByName(
            level(
                nation,
                uid("nation:", F.col("n_nationkey")),
                F.col("n_name"),
                none,
                uid("region:", F.col("n_regionkey")),
                F.lit(60),
            )
        )
        .unionByName(
            level(
                customer,
                uid("directory:", F.col("c_custkey")),
                F.col("c_name"),
                none,
                uid("nation:", F.col("c_nationkey")),
                F.lit(0),
            )
        )
    )


def conversation_corpus(spark: SparkSession, folder: str) -> Corpus:
    """Conversations; their turns stay rows."""
    turns = table(spark, folder, "conversations")
    keys = turns.select("conv_id").distinct()
    docs = document(
        keys,
        "conversation",
        uid("conversation:", F.col("conv_id")),
        {"conversation": F.struct(F.col("conv_id").alias("key"))},
    )
    return Corpus(docs, {"conversation.turns": ChildTable(turns, "conv_id", "conversation.key")})


def open_corpus(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """All classes in one table with a VARIANT body (``heavy`` where the bodies are read)."""
    texts = text_docs(spark, folder, heavy)
    typed = [
        customers(spark, folder),
        suppliers(spark, folder),
        orders(spark, folder, heavy),
        events(spark, folder, heavy=heavy),
        elements(spark, folder),
        texts.withColumn("text_doc", F.col("text_doc").dropFields("words", "lines")),
        text_labels(spark, folder),
        pages(spark, folder),
        parts(spark, folder),
        directories(spark, folder),
    ]
    out = opened(typed[0], heavy)
    for part in typed[1:]:
        out = out.unionByName(opened(part, heavy))
    return out
