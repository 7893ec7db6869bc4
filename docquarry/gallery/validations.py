"""Validation of whole tables; the rules that fire follow from the data itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.gallery.registry import CUSTOMER_ID, query
from docquarry.operators import validation as v
from docquarry.operators.reports import validation_summary
from docquarry.session import compute_once
from docquarry.sources import tables as t
from docquarry.sources.catalog import Catalog, FieldDef


def _summary_sql(*rows: tuple[str, str, str, str, str]) -> str:
    """One row per (rule, class, field): counts where ``condition`` holds in ``source``."""
    parts = [
        f"SELECT '{rule}' AS rule, '{cls}' AS declaring_class, '{field}' AS field, count(*) AS n_errors, count(*) AS n_documents "
        f"FROM {source} WHERE {condition}"
        for rule, cls, field, source, condition in rows
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_errors > 0"


def _faulty_texts(spark, folder):
    """Texts whose source decides which header fault they carry."""
    docs = t.text_docs(spark, folder, heavy=True)
    source = F.col("text_doc.source")
    return (
        docs.withColumn(
            "id", F.when(F.col("text_doc.lang") == "es", "").when(source == "src1", "not-hex!").otherwise(F.col("id"))
        )
        .withColumn("name", F.col("text_doc.text"))
        .withColumn(
            "datestamp_raw",
            F.when(source == "src2", "not-a-timestamp")
            .when(source == "src3", "2024-02-30T00:00:00Z")
            .otherwise(F.col("datestamp_raw")),
        )
        .withColumn("class_version", F.when(source == "src4", "2.0.0").otherwise(F.col("class_version")))
        .withColumn("schema_version", F.when(source == "src5", "another_set").otherwise(F.col("schema_version")))
        .withColumn("superclasses", F.when(source == "src6", F.slice("superclasses", 1, 0)).otherwise(F.col("superclasses")))
        .withColumn(
            "text_doc",
            F.col("text_doc").withField(
                "subject.node", F.when(source == "src7", "no curie").otherwise(F.col("text_doc.subject.node"))
            ),
        )
    )


_NODE_OK = "source <> 'src7'"


@query(
    "validation_summary",
    _summary_sql(
        ("V6", "base", "id", "documents", "lang = 'es'"),
        ("V10", "base", "id", "documents", "lang <> 'es' AND source = 'src1'"),
        ("V11", "base", "name", "documents", "length(text) > 256"),
        ("V23", "text_doc", "class_version", "documents", "source = 'src4'"),
        ("V24", "text_doc", "schema_version", "documents", "source = 'src5'"),
        ("V3", "text_doc", "superclasses", "documents", "source = 'src6'"),
        ("V11", "text_doc", "text", "documents", "length(text) > 10000"),
        ("V6", "text_doc", "text", "documents", "text = ''"),
        ("V13", "text_doc", "text", "documents", "length(text) < 20"),
        ("V13", "text_doc", "lang", "documents", "lang NOT IN ('en', 'fr')"),
        ("V13", "text_doc", "source", "documents", "NOT regexp_matches(source, '^src[0-9]$')"),
        ("V12", "text_doc", "n_chars", "documents", "n_chars < 50 OR n_chars > 15000"),
        ("V20", "text_doc", "subject", "documents", f"NOT ({_NODE_OK}) OR lang = 'de'"),
        ("V21", "text_doc", "subject", "documents", f"{_NODE_OK} AND lang NOT IN ('en', 'de')"),
        ("V33", "text_doc", "subject", "documents", f"{_NODE_OK} AND lang NOT IN ('en', 'de')"),
    ).replace(
        "FROM (SELECT 'V6'",
        """FROM (SELECT 'V9' AS rule, 'base' AS declaring_class, 'datestamp' AS field,
             count(*) AS n_errors, count(*) AS n_documents FROM documents WHERE source IN ('src2', 'src3')
             UNION ALL SELECT 'V6'""",
        1,
    ),
)
def validation_summary_query(spark, folder):
    checked = v.validate(_faulty_texts(spark, folder), t.CATALOG, ["text_doc"])
    return validation_summary(checked)


@query(
    "accepted_and_rejected",
    f"""SELECT count(*) FILTER (WHERE ok) AS n_accepted, count(*) FILTER (WHERE NOT ok) AS n_rejected FROM (
          SELECT length(text) <= 256 AND length(text) >= 20 AND lang = 'en' AND regexp_matches(source, '^src[0-9]$')
             AND n_chars >= 50 AND n_chars <= 15000
             AND source NOT IN ('src1', 'src2', 'src4', 'src5', 'src6', 'src7') AS ok
          FROM documents)""",
)
def accepted_and_rejected(spark, folder):
    checked = v.validate(_faulty_texts(spark, folder), t.CATALOG, ["text_doc"])
    good, bad = v.split_valid(checked)
    counted = good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok")))
    return counted.agg(F.count_if("ok").alias("n_accepted"), F.count_if(~F.col("ok")).alias("n_rejected"))


@query(
    "error_rows",
    f"""SELECT {CUSTOMER_ID} AS id, 'V12' AS rule, 'acctbal' AS field FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT {CUSTOMER_ID}, 'V22', 'directory_id' FROM customer WHERE c_nationkey = 5""",
)
def error_rows(spark, folder):
    docs = t.customers(spark, folder)
    blank = F.when(F.col("party.nation") == 5, F.lit("")).otherwise(F.get("depends_on", F.lit(0))["document_id"])
    docs = docs.withColumn("depends_on", t.entries(directory_id=blank))
    return v.error_rows(v.validate(docs, t.CATALOG, ["customer"])).select("id", "rule", "field")


@query(
    "open_block_rules",
    """SELECT rule, field, count(*) AS n FROM (
         SELECT 'V1' AS rule, '' AS field FROM customer WHERE c_nationkey IN (3, 4)
         UNION ALL SELECT 'V4', '' FROM customer WHERE c_nationkey = 5
         UNION ALL SELECT 'V5', 'nation' FROM customer WHERE c_nationkey = 3
         UNION ALL SELECT 'V5', 'acctbal' FROM customer WHERE c_nationkey = 3
         UNION ALL SELECT 'V7', 'mktsegment' FROM customer WHERE c_nationkey = 6
         UNION ALL SELECT 'V2', 'class_name' FROM customer WHERE c_nationkey = 7
         UNION ALL SELECT 'unknown_class', 'class_name' FROM customer WHERE c_nationkey = 8
         UNION ALL SELECT 'V12', 'acctbal' FROM customer WHERE c_acctbal < 0 AND c_nationkey NOT IN (3, 8)
         UNION ALL SELECT 'V1', '' FROM customer WHERE c_nationkey = 7
         UNION ALL SELECT 'V3', 'superclasses' FROM customer WHERE c_nationkey = 7
       ) GROUP BY rule, field""",
)
def open_block_rules(spark, folder):
    docs = t.customers(spark, folder, heavy=True)
    base = F.struct("id", "session_id", "name", F.col("datestamp_raw").alias("datestamp")).alias("base")
    party, own, nation = F.col("party"), F.col("customer"), F.col("party.nation")
    extra = own.withField("stray", F.lit(1)).alias("customer")
    listed = own.withField("mktsegment", F.array("customer.mktsegment")).alias("customer")
    body = (
        F.when(nation == 3, F.to_variant_object(F.struct(base, own)))
        .when(nation == 4, F.to_variant_object(F.struct(base, party, own, own.alias("stranger"))))
        .when(nation == 5, F.to_variant_object(F.struct(base, party, extra)))
        .when(nation == 6, F.to_variant_object(F.struct(base, party, listed)))
        .otherwise(F.to_variant_object(F.struct(base, party, own)))
    )
    name = F.when(nation == 7, "party").when(nation == 8, "nobody").otherwise(F.col("class_name"))
    kept = [c for c in docs.columns if c not in ("party", "customer", "class_name")]
    docs = compute_once(docs.select(*kept, name.alias("class_name"), body.alias("body")), "body")
    errors = v.error_rows(v.validate(docs, t.CATALOG, ["customer", "party"]))
    return errors.groupBy("rule", "field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "array_element_rules",
    """SELECT rule, field, count(*) AS n FROM (
         SELECT 'V29/V12' AS rule, 'lines[*].quantity' AS field FROM lineitem WHERE l_quantity > 45
         UNION ALL SELECT 'V29/V12', 'lines[*].discount' FROM lineitem WHERE l_discount > CAST(0.08 AS DOUBLE)
         UNION ALL SELECT 'V29/V13', 'lines[*].returnflag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
       ) GROUP BY rule, field""",
)
def array_element_rules(spark, folder):
    lines = next(f for _, f in t.CATALOG.placed_fields("order_doc") if f.name == "lines")
    checked = v.validate_rows(t.order_lines(spark, folder), lines, ["order_key"])
    return checked.select(F.explode("errors").alias("e")).groupBy(
        F.col("e.rule").alias("rule"), F.col("e.field").alias("field")
    ).agg(F.count(F.lit(1)).alias("n"))


_LINES = Catalog.from_definitions(
    [
        t.BASE,
        t.define(
            "text_doc",
            [
                t.define_field(
                    "lines",
                    "structure",
                    mustBeScalar=False,
                    fields=[
                        t.define_field("text", "char", mustBeNonEmpty=True, constraints={"maxLength": 400}),
                        t.define_field("words", "structure", mustBeScalar=False, fields=[
                            t.define_field("text", "char", constraints={"maxLength": 25}),
                        ]),
                    ],
                )
            ],
        ),
    ]
)


@query(
    "nested_element_rules",
    """SELECT rule, field, count(*) AS n FROM (
         SELECT 'V29/V6' AS rule, 'lines[*].text' AS field FROM documents
           WHERE len([x for x in string_split(text, chr(10)) if x = '']) > 0
         UNION ALL SELECT 'V29/V11', 'lines[*].text' FROM documents
           WHERE len([x for x in string_split(text, chr(10)) if length(x) > 400]) > 0
         UNION ALL SELECT 'V29/V29/V11', 'lines[*].words[*].text' FROM documents
           WHERE len([x for x in string_split(text, chr(10)) if len([w for w in string_split(x, ' ') if length(w) > 25]) > 0]) > 0
       ) GROUP BY rule, field""",
)
def nested_element_rules(spark, folder):
    errors = v.error_rows(v.validate(t.text_docs(spark, folder, heavy=True), _LINES, ["text_doc"]))
    return errors.groupBy("rule", "field").agg(F.count(F.lit(1)).alias("n"))


_ELEMENTS = Catalog.from_definitions(
    [
        t.BASE,
        t.define(
            "element",
            [
                t.define_field("label", "integer", constraints={"minimum": 1, "maximum": 8}),
                t.define_field(
                    "embedding",
                    "matrix",
                    mustNotHaveNaN=True,
                    constraints={"rows": 1, "cols": 64, "minimum": -0.3, "maximum": 0.3, "element_type": "integer"},
                ),
            ],
        ),
    ]
)


@query(
    "matrix_rules",
    """SELECT rule, message, count(*) AS n FROM (
         SELECT 'V14' AS rule, 'element below -0.3' AS message FROM embeddings
           WHERE len([x for x in embedding if CAST(x AS DOUBLE) < CAST(-0.3 AS DOUBLE)]) > 0
         UNION ALL SELECT 'V14', 'element above 0.3' FROM embeddings
           WHERE len([x for x in embedding if CAST(x AS DOUBLE) > CAST(0.3 AS DOUBLE)]) > 0
         UNION ALL SELECT 'V14', 'element is not an integer' FROM embeddings
           WHERE len([x for x in embedding if x <> floor(x)]) > 0
         UNION ALL SELECT 'V14', 'needs 64 columns' FROM embeddings WHERE label IN (2, 3)
         UNION ALL SELECT 'V8', 'NaN is not allowed' FROM embeddings WHERE label = 3
         UNION ALL SELECT 'V12', 'below minimum 1' FROM embeddings WHERE label < 1
         UNION ALL SELECT 'V12', 'above maximum 8' FROM embeddings WHERE label > 8
       ) GROUP BY rule, message""",
)
def matrix_rules(spark, folder):
    label, vector = F.col("element.label"), F.col("element.embedding")
    nan = F.lit(float("nan")).cast("float")
    zero = F.lit(0.0).cast("float")
    # A number is added, never replaced, so the other rules see the whole vector.
    faulty = (
        F.when(label == 2, F.concat(vector, F.array(zero)))
        .when(label == 3, F.concat(vector, F.array(nan)))
        .otherwise(vector)
    )
    docs = t.elements(spark, folder).withColumn("element", F.col("element").withField("embedding", faulty))
    errors = v.error_rows(v.validate(docs, _ELEMENTS, ["element"]))
    return errors.groupBy("rule", "message").agg(F.count(F.lit(1)).alias("n"))


_EVENTS = Catalog.from_definitions(
    [
        t.BASE,
        t.define("epochid", [t.define_field("epochid", "char")]),
        t.define(
            "event",
            [
                t.define_field(
                    "elapsed",
                    "duration",
                    mustBeNonEmpty=True,
                    constraints={"minimum": 60, "maximum": 900000, "allowed_units": ["second", "hour"]},
                ),
                t.define_field("gain", "voltage", mustNotHaveNaN=True),
            ],
            parents=("epochid",),
        ),
    ]
)


@query(
    "quantity_rules",
    """WITH q AS (SELECT event_type, user_id,
              value * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 60 ELSE 3600 END
                + CASE event_type WHEN 'signup' THEN 1 ELSE 0 END AS seconds FROM events)
       SELECT rule, message, field, count(*) AS n FROM (
         SELECT 'V16' AS rule, 'canonical value or approximate flag disagrees with the source unit' AS message, 'elapsed' AS field
           FROM q WHERE event_type IN ('signup', 'purchase')
         UNION ALL SELECT 'V17', 'unit not in [''second'', ''hour'']', 'elapsed' FROM q WHERE event_type = 'click'
         UNION ALL SELECT 'V18', 'below minimum 60', 'elapsed' FROM q WHERE seconds < 60
         UNION ALL SELECT 'V18', 'above maximum 900000', 'elapsed' FROM q WHERE seconds > 900000
         UNION ALL SELECT 'V8', 'NaN is not allowed', 'gain.volts' FROM q WHERE user_id = 3
         UNION ALL SELECT 'V16', 'canonical value or approximate flag disagrees with the source unit', 'gain' FROM q WHERE user_id = 3
       ) GROUP BY rule, message, field""",
)
def quantity_rules(spark, folder):
    kind = F.col("event.event_type")
    seconds = F.col("event.elapsed.seconds")
    nan = F.lit(float("nan"))
    event = (
        F.col("event")
        .withField("elapsed.seconds", F.when(kind == "signup", seconds + 1).otherwise(seconds))
        .withField("elapsed.approximate", kind == "purchase")
        .withField("gain.volts", F.when(F.col("event.user_id") == 3, nan).otherwise(F.col("event.gain.volts")))
    )
    docs = compute_once(t.events(spark, folder, heavy=True).withColumn("event", event), "event")
    errors = v.error_rows(v.validate(docs, _EVENTS, ["event"]))
    return errors.groupBy("rule", "message", "field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cross_field_rules",
    """SELECT rule, field, count(*) AS n FROM (
         SELECT 'V25' AS rule, 'names' AS field FROM part WHERE p_size < 10
         UNION ALL SELECT 'V25', 'data' FROM part WHERE p_size > 45
         UNION ALL SELECT 'V26', 'dim_sizes' FROM part WHERE p_size % 4 <> 2
         UNION ALL SELECT 'V26', 'dim_labels' FROM part WHERE p_size % 4 <> 3
         UNION ALL SELECT 'V28', 'site_to_channel' FROM part WHERE p_retailprice <> floor(p_retailprice)
         UNION ALL SELECT 'V26', 'site_to_channel' FROM part WHERE p_size % 3 <> 2
       ) GROUP BY rule, field""",
)
def cross_field_rules(spark, folder):
    size = F.col("p_size")
    part = t.table(spark, folder, "part").select(
        F.lit("bench").alias("class_name"),
        F.struct(
            F.when(size < 10, "a,b").otherwise("a,b,c").alias("names"),
            F.lit("x,y,z").alias("variable_names"),
            F.lit("n:1,n:2,n:3").alias("ontology_nodes"),
            F.when(size > 45, F.create_map(F.lit("x"), F.lit(1)))
            .otherwise(F.create_map(F.lit("x"), F.lit(1), F.lit("y"), F.lit(2), F.lit("z"), F.lit(3)))
            .alias("data"),
        ).alias("ontology_table_row"),
        F.struct(
            (size % 4).alias("ndims"), F.array(F.lit(3.0), F.lit(4.0)).alias("dim_sizes"), F.lit("t, c, r").alias("dim_labels")
        ).alias("ngrid"),
        F.struct(
            (size % 3).alias("num_sites"),
            F.create_map(F.lit("1"), F.lit(7.0), F.lit("2"), F.col("p_retailprice")).alias("site_to_channel"),
        ).alias("site2channelmap"),
    )
    catalog = Catalog.from_definitions(
        [
            t.define("ontology_table_row", parents=()),
            t.define("ngrid", parents=()),
            t.define(
                "site2channelmap",
                [t.define_field("site_to_channel", "structure", fields=[], constraints={"value_type": "integer"})],
                parents=(),
            ),
            t.define("bench", parents=("ontology_table_row", "ngrid", "site2channelmap")),
        ]
    )
    checked = v.validate(part, catalog, ["bench"])
    return checked.select(F.explode("errors").alias("e")).groupBy(
        F.col("e.rule").alias("rule"), F.col("e.field").alias("field")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "matrix_shapes",
    """SELECT rule, field, count(*) AS n FROM (
         SELECT 'V26' AS rule, 'mean_waveform' AS field FROM part WHERE p_size % 4 <> 2 OR p_size % 3 <> 2
         UNION ALL SELECT 'V26', 'table_data' FROM part WHERE p_size % 5 <> 2
       ) GROUP BY rule, field""",
)
def matrix_shapes(spark, folder):
    """Waveforms and stimulus tables of 2 x 2 whose documents state other sizes."""
    size = F.col("p_size")
    square = F.array(F.array(F.col("p_retailprice"), F.lit(1.0)), F.array(F.lit(2.0), F.lit(3.0)))
    part = t.table(spark, folder, "part").select(
        F.lit("bench").alias("class_name"),
        F.struct(
            (size % 4).alias("number_of_samples_per_channel"), (size % 3).alias("number_of_channels"), square.alias("mean_waveform")
        ).alias("neuron_extracellular"),
        F.struct(F.lit("a,b").alias("parameter_names"), square.alias("table_data"), (size % 5).alias("num_stimuli")).alias("stimulus_parameter_table"),
    )
    names = ("neuron_extracellular", "stimulus_parameter_table")
    catalog = Catalog.from_definitions([*[t.define(n, parents=()) for n in names], t.define("bench", parents=names)])
    checked = v.validate(part, catalog, ["bench"])
    return checked.select(F.explode("errors").alias("e")).groupBy(
        F.col("e.rule").alias("rule"), F.col("e.field").alias("field")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tagged_bodies",
    """SELECT rule, field, count(*) AS n FROM (
         SELECT 'V30' AS rule, 'value' AS field FROM events WHERE event_type = 'purchase' AND value < 50
         UNION ALL SELECT 'V32', 'event_type' FROM events WHERE event_type IN ('error', 'signup')
         UNION ALL SELECT 'V32/V12', 'body.k' FROM events WHERE event_type = 'view' AND CAST(json_extract(props, '$.k') AS BIGINT) > 50
         UNION ALL SELECT 'V32/V12', 'body.k' FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS BIGINT) < 20
         UNION ALL SELECT 'V32/V5', 'body.q' FROM events WHERE event_type = 'click'
       ) GROUP BY rule, field""",
)
def tagged_bodies(spark, folder):
    top = FieldDef("k", "k", "integer", constraints={"maximum": 50})
    low = FieldDef("k", "k", "integer", constraints={"minimum": 20})
    other = FieldDef("q", "q", "integer")
    rules = v.keyed_body(
        "event", "body", "event_type",
        central={"view": [top], "click": [low, other], "purchase": [], "signup": []},
        local={"signup": []},
    ) + v.variant_requirements("event", "event_type", {"purchase": ["value"]})
    rows = t.table(spark, folder, "events").select(
        F.lit("event").alias("class_name"),
        F.struct(
            "event_type", F.when(F.col("value") >= 50, F.col("value")).alias("value"), F.parse_json("props").alias("body")
        ).alias("event"),
    )
    catalog = Catalog.from_definitions([t.define("event", parents=())])
    checked = v.validate(rows, catalog, ["event"], rules={"event": rules})
    return checked.select(F.explode("errors").alias("e")).groupBy(
        F.col("e.rule").alias("rule"), F.col("e.field").alias("field")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tuning_curve_sizes",
    """SELECT event_type, count(*) AS n FROM events WHERE day(ts) % 3 <> 2 GROUP BY event_type""",
)
def tuning_curve_sizes(spark, folder):
    repeat = F.array_repeat(F.col("value"), F.dayofmonth("ts") % 3)
    rows = t.table(spark, folder, "events").select(
        "event_type",
        F.lit("stimulus_tuningcurve").alias("class_name"),
        F.struct(
            F.array(F.lit(1.0), F.lit(2.0)).alias("independent_values"),
            repeat.alias("response_mean"),
            F.array(F.col("value"), F.lit(0.0)).alias("response_stderr"),
        ).alias("stimulus_tuningcurve"),
    )
    catalog = Catalog.from_definitions([t.define("stimulus_tuningcurve", parents=())])
    checked = v.validate(rows, catalog)
    return checked.where(F.exists("errors", lambda e: e["rule"] == "V27")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "version_impact",
    """SELECT 'event' AS class_name, count(*) AS n_documents, count(*) FILTER (WHERE event_type IN ('click') OR
              value * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 60 ELSE 3600 END < 60 OR
              value * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 60 ELSE 3600 END > 900000) AS n_failing
       FROM events""",
)
def version_impact(spark, folder):
    return v.version_impact(t.events(spark, folder, heavy=True), _EVENTS, ["event"])


_SAMPLE = Catalog.from_definitions(
    [
        t.BASE,
        t.define(
            "sample",
            [t.define_field("wait", "duration"), t.define_field("term", "ontology_term")],
            depends_on=[t.define_dependency("part_#", multiple=True)],
        ),
    ]
)


@query(
    "shape_rules",
    """SELECT rule, field, count(*) AS n FROM (
         SELECT CASE c_custkey % 4 WHEN 1 THEN 'V15' WHEN 2 THEN 'V19' ELSE 'V22' END AS rule,
                CASE c_custkey % 4 WHEN 1 THEN 'wait' WHEN 2 THEN 'term' ELSE 'part_#' END AS field
         FROM customer WHERE c_custkey % 4 <> 0) GROUP BY rule, field""",
)
def shape_rules(spark, folder):
    """Quantities and terms that lack a part, and a numbered dependency that is blank."""
    rows, kind = t.table(spark, folder, "customer", heavy=True), F.col("c_custkey") % 4
    wait = t.duration(F.col("c_custkey").cast("double"), F.lit("minute"))
    term = F.struct(F.lit("uberon:1").alias("node"), F.lit("part").alias("name"))
    docs = t.document(
        rows,
        "sample",
        t.uid("sample:", F.col("c_custkey")),
        {"wait": wait, "term": term, "kind": kind},
        depends_on=F.array(
            *[F.struct(F.lit(f"part_{i}").alias("name"), F.when((kind == 3) & (i == 2), "").otherwise("x").alias("document_id")) for i in (1, 2)]
        ),
        catalog=_SAMPLE,
    )
    base = F.struct("id", "session_id", "name", F.col("datestamp_raw").alias("datestamp")).alias("base")
    kind = F.col("kind")
    body = (
        F.when(kind == 1, F.to_variant_object(F.struct(base, F.struct(F.col("wait").dropFields("source_unit").alias("wait"), "term").alias("sample"))))
        .when(kind == 2, F.to_variant_object(F.struct(base, F.struct("wait", F.col("term").dropFields("name").alias("term")).alias("sample"))))
        .otherwise(F.to_variant_object(F.struct(base, F.struct("wait", "term").alias("sample"))))
    )
    docs = compute_once(docs.withColumn("body", body).drop("wait", "term", "kind"), "body")
    errors = v.error_rows(v.validate(docs, _SAMPLE)).where("severity = 'error'")
    return errors.groupBy("rule", "field").agg(F.count(F.lit(1)).alias("n"))
