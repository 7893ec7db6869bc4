"""Migration of legacy-shaped documents made from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions.values import DocumentLayout
from docquarry.gallery.registry import CUSTOMER_ID, EVENT_ID, ORDER_ID, query, uid_sql
from docquarry.operators import steps as s
from docquarry.operators.migration import migrate, migration_report, withdrawn_documents
from docquarry.session import spread
from docquarry.sources import tables as t
from docquarry.sources.catalog import Catalog
from docquarry.sources.documents import block_keys, normalise_wire_shape

PART_ID = uid_sql("'part:'||p_partkey")
SUPPLIER_ID = uid_sql("'supplier:'||s_suppkey")

_TERM = "ontology_term"
TARGET = Catalog.from_definitions(
    [
        t.BASE,
        t.define("app", [t.define_field("app_name", "char"), t.define_field("app_version", "char")]),
        t.define("epochid", [t.define_field("epochid", "char")]),
        t.define("calculator", parents=("base", "app"), abstract=True),
        t.define("tuning_fit", parents=("calculator",), abstract=True),
        t.define("probe_location", [t.define_field("location", _TERM)]),
        t.define(
            "treatment",
            [
                t.define_field("treatment_name", _TERM),
                t.define_field("numeric_value", "matrix"),
                t.define_field("string_value", "char"),
            ],
        ),
        t.define("treatment_drug", [t.define_field("dose", "double")], parents=("treatment",)),
        t.define("ontology_image", [t.define_field("region", _TERM, mustBeNonEmpty=True)]),
        t.define("ontology_label", [t.define_field("term", _TERM, mustBeNonEmpty=True)]),
        t.define("contrast_tuning"),
        t.define("contrast_tuning_calc", parents=("contrast_tuning", "tuning_fit")),
        t.define("contrast_sensitivity_calc"),
        t.define("spatial_frequency_tuning"),
        t.define("spatial_frequency_tuning_calc", parents=("spatial_frequency_tuning", "tuning_fit")),
        t.define("temporal_frequency_tuning"),
        t.define("temporal_frequency_tuning_calc", parents=("temporal_frequency_tuning", "tuning_fit")),
        t.define("speed_tuning"),
        t.define("speed_tuning_calc", parents=("speed_tuning", "tuning_fit")),
        t.define("orientation_direction_tuning"),
        t.define("oridirtuning_calc", parents=("orientation_direction_tuning", "tuning_fit")),
        t.define("ngrid"),
        t.define("reverse_correlation", parents=("base", "ngrid")),
        t.define("hartley_reverse_correlation", parents=("base", "reverse_correlation")),
        t.define("hartley_calc", parents=("base", "hartley_reverse_correlation")),
        t.define("element_epoch", parents=("base", "epochid")),
        t.define("position_metadata"),
        t.define("stimulus_bath", parents=("base", "epochid")),
        t.define("stimulus_presentation", parents=("base", "app", "epochid")),
    ]
)


#: Stored bytes of a table that one task converts: narrow rows, each with a fraction of a millisecond of work.
_SPLIT_BYTES = 1 << 20


def legacy(
    rows: DataFrame, class_name: str | Column, id: Column, blocks: dict[str, Column], **top: Column  # noqa: A002
) -> DataFrame:
    """Documents in the legacy shape: base block, legacy dependency keys, no schema version."""
    name = F.lit(class_name) if isinstance(class_name, str) else class_name
    doc = F.struct(
        F.struct(
            name.alias("class_name"),
            F.lit("1.0.0").alias("class_version"),
            F.array(F.struct(F.lit("base").alias("class_name"), F.lit("1.0.0").alias("class_version"))).alias("superclasses"),
        ).alias("document_class"),
        F.array(
            F.struct(F.lit("element_id").alias("name"), t.uid("element:", id).alias("id"), F.lit("3").alias("version"))
        ).alias("depends_on"),
        F.struct(
            id.alias("id"),
            t.uid("session").alias("session_id"),
            F.lit("").alias("name"),
            F.lit(t.FIXED_STAMP).alias("datestamp"),
        ).alias("base"),
        *[block.alias(n) for n, block in blocks.items()],
        *[value.alias(n) for n, value in top.items()],
    )
    return normalise_wire_shape(spread(rows, _SPLIT_BYTES).select(F.to_variant_object(doc).alias("doc")))


def get(df: DataFrame, path: str, as_type: str) -> Column:
    return DocumentLayout(df.schema).locate(path.split(".")).value().cast(as_type)


def pick(df: DataFrame, **paths: tuple[str, str]) -> DataFrame:
    return df.select("id", *[get(df, p, k).alias(n) for n, (p, k) in paths.items()])


def field_names(df: DataFrame, path: str) -> Column:
    return F.array_join(F.array_sort(DocumentLayout(df.schema).locate(path.split(".")).keys()), ",")


# -- terms --------------------------------------------------------------------------------
@query(
    "migrate_probe_location",
    f"""SELECT {CUSTOMER_ID} AS id, 'uberon:'||c_nationkey AS node, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS name,
               'V_delta' AS schema_version, 'migrated' AS migration_status, {uid_sql(f"'element:'||{CUSTOMER_ID}")} AS element_id
        FROM customer""",
)
def migrate_probe_location(spark, folder):
    block = F.struct(
        F.concat(F.lit("UBERON:"), F.col("c_nationkey").cast("string")).alias("ontology_name"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("name"),
    )
    docs = legacy(
        t.table(spark, folder, "customer"), "probe_location", t.uid("customer:", F.col("c_custkey")), {"probe_location": block}
    )
    out = migrate(docs, TARGET, only=["probe_location"])
    return out.select(
        "id",
        get(out, "probe_location.location.node", "string").alias("node"),
        get(out, "probe_location.location.name", "string").alias("name"),
        "schema_version",
        "migration_status",
        F.get("depends_on", F.lit(0))["document_id"].alias("element_id"),
    )


@query(
    "migrate_treatment",
    f"""SELECT {PART_ID} AS id, 'chebi:'||p_partkey AS node, p_name AS name, CAST(p_size AS DOUBLE) AS amount, p_type AS note,
               'base,treatment' || CASE WHEN p_size > 25 THEN ',treatment_drug' ELSE '' END AS blocks FROM part""",
)
def migrate_treatment(spark, folder):
    node = F.concat(F.lit("chebi:"), F.col("p_partkey").cast("string"))
    rest = [
        F.col("p_name").alias("name"),
        F.array(F.col("p_size").cast("double")).alias("numeric_value"),
        F.col("p_type").alias("string_value"),
    ]
    part = t.table(spark, folder, "part")
    id_ = t.uid("part:", F.col("p_partkey"))
    camel = legacy(part.where("p_size <= 25"), "treatment", id_, {"treatment": F.struct(node.alias("ontologyName"), *rest)})
    snake = legacy(part.where("p_size > 25"), "treatment_drug", id_, {"treatment": F.struct(node.alias("ontology_name"), *rest)})
    out = migrate(camel.unionByName(snake), TARGET, only=["treatment"])
    return out.select(
        "id",
        get(out, "treatment.treatment_name.node", "string").alias("node"),
        get(out, "treatment.treatment_name.name", "string").alias("name"),
        F.get(get(out, "treatment.numeric_value", "array<double>"), F.lit(0)).alias("amount"),
        get(out, "treatment.string_value", "string").alias("note"),
        F.array_join(block_keys(out), ",").alias("blocks"),
    )


@query(
    "keep_flat_terms",
    f"SELECT {CUSTOMER_ID} AS id, 'UBERON:'||c_nationkey AS ontology_name, c_mktsegment AS name FROM customer",
)
def keep_flat_terms(spark, folder):
    block = F.struct(
        F.concat(F.lit("UBERON:"), F.col("c_nationkey").cast("string")).alias("ontologyName"), F.col("c_mktsegment").alias("name")
    )
    docs = legacy(
        t.table(spark, folder, "customer"), "treatment", t.uid("customer:", F.col("c_custkey")), {"treatment": block}
    )
    out = migrate(docs, TARGET, collapse_ontology=False, only=["treatment"])
    return pick(out, ontology_name=("treatment.ontology_name", "string"), name=("treatment.name", "string"))


@query(
    "migrate_ontology_image",
    f"""SELECT {SUPPLIER_ID} AS id, 'ontology_image' AS class_name, 'allen_ccf_v3:'||s_suppkey AS node, s_name AS name FROM supplier""",
)
def migrate_ontology_image(spark, folder):
    block = F.struct(
        F.concat(F.lit("allen_ccf_v3:"), F.col("s_suppkey").cast("string")).alias("ontology_name"),
        F.col("s_name").alias("ontology_region"),
    )
    docs = legacy(
        t.table(spark, folder, "supplier"), "ontologyImage", t.uid("supplier:", F.col("s_suppkey")), {"ontologyImage": block}
    )
    out = migrate(docs, TARGET, only=["ontology_image"])
    return out.select(
        "id",
        "class_name",
        get(out, "ontology_image.region.node", "string").alias("node"),
        get(out, "ontology_image.region.name", "string").alias("name"),
    )


@query(
    "migrate_ontology_label",
    f"""SELECT {CUSTOMER_ID} AS id, 'allen_ccf_v3:'||c_nationkey AS node, c_mktsegment AS name,
               CASE WHEN c_nationkey = 0 THEN 'flagged' ELSE 'migrated' END AS migration_status FROM customer""",
)
def migrate_ontology_label(spark, folder):
    block = F.struct(
        F.lit("Allen CCF v3").alias("ontology_name"),
        F.col("c_mktsegment").alias("label"),
        F.col("c_nationkey").alias("label_id"),
    )
    docs = legacy(
        t.table(spark, folder, "customer"), "ontologyLabel", t.uid("customer:", F.col("c_custkey")), {"ontologyLabel": block}
    )
    out = migrate(docs, TARGET, only=["ontology_label"])
    return out.select(
        "id",
        get(out, "ontology_label.term.node", "string").alias("node"),
        get(out, "ontology_label.term.name", "string").alias("name"),
        "migration_status",
    )


# -- tuning results --------------------------------------------------------------------------
def _event_id() -> Column:
    return t.uid("event:", F.col("event_id"))


def _events(spark, folder):
    return t.table(spark, folder, "events")


@query(
    "migrate_contrast_tuning",
    f"""SELECT {EVENT_ID} AS id, 'contrast_tuning_calc' AS class_name, value AS rb_pref, user_id AS rbns_r2, value + 1 AS second_sensitivity,
               'naka_rushton_rb,naka_rushton_rbn,naka_rushton_rbns' AS fits, value AS first_contrast,
               CASE WHEN event_type = 'error' THEN 'flagged' ELSE 'migrated' END AS migration_status FROM events""",
)
def migrate_contrast_tuning(spark, folder):
    one = lambda c: F.array(c)
    pair = F.when(F.col("event_type") == "error", F.array("value", "value")).otherwise(F.array("value"))
    block = F.struct(
        F.struct(
            one(F.col("value")).alias("naka_rushton_RB_pref"),
            F.array(F.col("value"), F.col("value") + 1).alias("naka_rushton_RB_sensitivity"),
            pair.alias("naka_rushton_RBN_r2"),
            one(F.col("user_id")).alias("naka_rushton_RBNS_r2"),
        ).alias("fit"),
        F.struct(F.col("value").alias("contrast"), F.array("value").alias("mean")).alias("tuning_curve"),
    )
    own = F.struct(F.struct(F.lit("x").alias("stimulus_tuningcurve_id")).alias("depends_on"))
    docs = legacy(_events(spark, folder), "contrasttuning_calc", _event_id(), {"contrast_tuning": block, "contrasttuning_calc": own})
    out = migrate(docs, TARGET, only=["contrast_tuning", "contrast_tuning_calc"])
    return out.select(
        "id",
        "class_name",
        get(out, "contrast_tuning.fit.naka_rushton_rb.pref", "double").alias("rb_pref"),
        get(out, "contrast_tuning.fit.naka_rushton_rbns.r2", "bigint").alias("rbns_r2"),
        F.get(get(out, "contrast_tuning.fit.naka_rushton_rb.sensitivity", "array<double>"), F.lit(1)).alias("second_sensitivity"),
        field_names(out, "contrast_tuning.fit").alias("fits"),
        F.get(get(out, "contrast_tuning.tuning_curve.contrast", "array<double>"), F.lit(0)).alias("first_contrast"),
        "migration_status",
    )


@query(
    "migrate_contrast_sensitivity",
    f"""SELECT {EVENT_ID} AS id, 'contrast_sensitivity_calc' AS class_name, value AS sensitivity, event_type = 'view' AS modulated,
               'is_modulated_response,parameters_rbns,sensitivity_rb' AS names FROM events""",
)
def migrate_contrast_sensitivity(spark, folder):
    block = F.struct(
        F.col("value").alias("sensitivity_RB"),
        F.array("value").alias("parameters_RBNS"),
        F.when(F.col("event_type") == "view", 1.0).otherwise(0.0).alias("is_modulated_response"),
        F.struct(F.lit("x").alias("element_id")).alias("depends_on"),
    )
    docs = legacy(_events(spark, folder), "contrastsensitivity_calc", _event_id(), {"contrastsensitivity_calc": block})
    out = migrate(docs, TARGET, only=["contrast_sensitivity_calc"])
    return out.select(
        "id",
        "class_name",
        get(out, "contrast_sensitivity_calc.sensitivity_rb", "double").alias("sensitivity"),
        get(out, "contrast_sensitivity_calc.is_modulated_response", "boolean").alias("modulated"),
        field_names(out, "contrast_sensitivity_calc").alias("names"),
    )


for _axis in ("spatial_frequency", "temporal_frequency"):

    def _frequency(spark, folder, axis=_axis):
        fit = F.struct(F.col("value").alias("R2"), F.col("value").alias("values"), F.array("value").alias("fit"), F.lit(2.5).alias("L50"))
        inner = [
            F.struct(F.col("value").alias(axis), F.array("value", "value").alias("mean")).alias("tuning_curve"),
            F.struct(F.col("value").alias("L50"), F.col("value").alias("Pref"), F.lit(0.5).alias("low_pass_index")).alias("fitless"),
            fit.alias("fit_dog"),
        ]
        block = F.struct(*inner, F.struct(*inner).alias("abs"))
        own = F.struct(F.struct(F.lit("x").alias("a")).alias("depends_on"), F.struct(F.lit(1).alias("n")).alias("input_parameters"))
        name = f"{axis}_tuning"
        docs = legacy(_events(spark, folder), f"{name}_calc", _event_id(), {name: block, f"{name}_calc": own})
        out = migrate(docs, TARGET, only=[name, f"{name}_calc"])
        return out.select(
            "id",
            get(out, f"{name}.fitless.pref", "double").alias("pref"),
            field_names(out, f"{name}.fit_dog").alias("dog_names"),
            field_names(out, f"{name}.abs.fitless").alias("abs_names"),
            F.get(get(out, f"{name}.fit_dog.values", "array<double>"), F.lit(0)).alias("first_value"),
            F.size(get(out, f"{name}.tuning_curve.{axis}", "array<double>")).alias("n_points"),
            field_names(out, f"{name}_calc").alias("calc_names"),
            F.array_join("lineage", ",").alias("lineage"),
        )

    query(
        f"migrate_{_axis}_tuning",
        f"""SELECT {EVENT_ID} AS id, value AS pref, 'fit,l50,r2,values' AS dog_names, 'l50,low_pass_index,pref' AS abs_names,
                   value AS first_value, CAST(1 AS INTEGER) AS n_points, 'input_parameters' AS calc_names,
                   'base,{_axis}_tuning,app,calculator,tuning_fit,{_axis}_tuning_calc' AS lineage FROM events""",
    )(_frequency)


@query(
    "migrate_speed_tuning",
    f"""SELECT {EVENT_ID} AS id, 'speed_tuning_calc' AS class_name, value AS speed_index, 'partial_r2,priebe_fit_r2' AS names FROM events""",
)
def migrate_speed_tuning(spark, folder):
    block = F.struct(
        F.struct(F.array("value").alias("Priebe_fit_speed_tuning_index")).alias("fit"),
        F.struct(F.lit(0.5).alias("Priebe_fit_r2"), F.lit(0.1).alias("partial_r2")).alias("fit_fullspeed"),
    )
    docs = legacy(_events(spark, folder), "speedtuning_calc", _event_id(), {"speed_tuning": block})
    out = migrate(docs, TARGET, only=["speed_tuning", "speed_tuning_calc"])
    return out.select(
        "id",
        "class_name",
        get(out, "speed_tuning.fit.priebe_fit_speed_tuning_index", "double").alias("speed_index"),
        field_names(out, "speed_tuning.fit_fullspeed").alias("names"),
    )


@query(
    "migrate_orientation_tuning",
    f"""SELECT {EVENT_ID} AS id, event_type AS coordinates, value AS ratio, 'calc.'||event_type AS app_name, 'input_parameters' AS calc_names,
               'base,orientation_direction_tuning,app,calculator,tuning_fit,oridirtuning_calc' AS lineage FROM events""",
)
def migrate_orientation_tuning(spark, folder):
    block = F.struct(
        F.struct(F.initcap("event_type").alias("coordinates")).alias("properties"),
        F.struct(F.array("value").alias("direction_preferred_null_ratio"), F.col("value").alias("hwhh")).alias("fit"),
    )
    blocks = {
        "orientation_direction_tuning": block,
        "oridirtuning_calc": F.struct(F.struct(F.lit("x").alias("a")).alias("depends_on")),
        "app": F.struct(F.concat(F.lit("calc."), "event_type").alias("name"), F.lit("1").alias("version")),
    }
    out = migrate(
        legacy(_events(spark, folder), "oridirtuning_calc", _event_id(), blocks),
        TARGET,
        only=["orientation_direction_tuning", "oridirtuning_calc", "app"],
    )
    return out.select(
        "id",
        get(out, "orientation_direction_tuning.properties.coordinates", "string").alias("coordinates"),
        get(out, "orientation_direction_tuning.fit.direction_preferred_null_ratio", "double").alias("ratio"),
        get(out, "app.app_name", "string").alias("app_name"),
        field_names(out, "oridirtuning_calc").alias("calc_names"),
        F.array_join("lineage", ",").alias("lineage"),
    )


@query(
    "migrate_hartley",
    f"""SELECT {EVENT_ID} AS id, value AS first_frame, 'color_high,fps,l_max,m' AS stimulus_names, 't_coords,x_coords' AS grid_names,
               't,x_sampling' AS input_names, 'kernel_'||event_type||'.ngrid' AS file_name FROM events""",
)
def migrate_hartley(spark, folder):
    snake = F.col("event_type") == "view"
    stimulus = F.struct(F.lit(1).alias("M"), F.lit(20).alias("L_max"), F.lit(10).alias("fps"), F.lit(1).alias("color_high"))
    grid = F.struct(F.array("value").alias("T_coords"), F.array("value").alias("X_coords"))

    def docs(rows, spelling):
        block = F.struct(
            F.array("value").alias(spelling), stimulus.alias("stimulus_properties"), grid.alias("reconstruction_properties")
        )
        own = F.struct(F.struct(F.array("value").alias("T"), F.lit(1).alias("X_sampling")).alias("input_parameters"))
        files = F.struct(F.array(F.concat(F.lit("kernel_"), "event_type", F.lit(".ngrid"))).alias("file_list"))
        return legacy(
            rows, "hartley_calc", _event_id(), {"hartley_reverse_correlation": block, "hartley_calc": own}, files=files
        )

    rows = _events(spark, folder)
    both = docs(rows.where(snake), "frame_times").unionByName(docs(rows.where(~snake), "frameTimes"))
    out = migrate(both, TARGET, only=["hartley_reverse_correlation", "hartley_calc"])
    h = "hartley_reverse_correlation"
    return out.select(
        "id",
        F.get(get(out, f"{h}.frame_times", "array<double>"), F.lit(0)).alias("first_frame"),
        field_names(out, f"{h}.stimulus_properties").alias("stimulus_names"),
        field_names(out, f"{h}.reconstruction_properties").alias("grid_names"),
        field_names(out, "hartley_calc.input_parameters").alias("input_names"),
        F.try_variant_get("body", "$.file[0].name", "string").alias("file_name"),
    )


# -- records ------------------------------------------------------------------------------------
@query(
    "migrate_element_epoch",
    f"""SELECT {ORDER_ID} AS id, 2 AS n_clocks, 'utc' AS second_clock, CAST(o_orderkey AS DOUBLE) AS t0, o_totalprice AS t1 FROM orders""",
)
def migrate_element_epoch(spark, folder):
    block = F.struct(
        F.lit("dev_local_time, utc").alias("epoch_clock"),
        F.array(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.col("o_orderkey").cast("double"), F.col("o_totalprice"))).alias("t0_t1"),
    )
    docs = legacy(t.table(spark, folder, "orders"), "element_epoch", t.uid("order:", F.col("o_orderkey")), {"element_epoch": block})
    out = migrate(docs, TARGET, only=["element_epoch"])
    clocks = get(out, "element_epoch.clocks", "array<struct<name:string,t0:double,t1:double>>")
    second = F.get(clocks, F.lit(1))
    return out.select(
        "id",
        F.size(clocks).alias("n_clocks"),
        second["name"].alias("second_clock"),
        second["t0"].alias("t0"),
        second["t1"].alias("t1"),
    )


@query(
    "migrate_position_metadata",
    f"""SELECT {CUSTOMER_ID} AS id, 'pos:'||c_nationkey AS measurement, 'axis_1=ax:'||c_custkey||';axis_2=ay:'||c_nationkey AS axes FROM customer""",
)
def migrate_position_metadata(spark, folder):
    key = lambda c: F.col(c).cast("string")
    block = F.struct(
        F.concat(F.lit("pos:"), key("c_nationkey")).alias("ontologyNode"),
        F.lit("unit:1").alias("units"),
        F.concat(F.lit("ax:"), key("c_custkey"), F.lit(", ay:"), key("c_nationkey")).alias("dimensions"),
    )
    docs = legacy(
        t.table(spark, folder, "customer"), "position_metadata", t.uid("customer:", F.col("c_custkey")), {"position_metadata": block}
    )
    out = migrate(docs, TARGET, only=["position_metadata"])
    axes = get(out, "position_metadata.dimensions", "array<struct<axis:string,node:string,name:string>>")
    return out.select(
        "id",
        get(out, "position_metadata.measurement.node", "string").alias("measurement"),
        F.array_join(F.transform(axes, lambda a: F.concat(a["axis"], F.lit("="), a["node"])), ";").alias("axes"),
    )


@query(
    "migrate_stimulus_bath",
    f"""SELECT {PART_ID} AS id, 'bath:'||p_size AS location, 2 AS n_chemicals, 'chebi:'||p_partkey AS node, p_name AS name,
               p_retailprice AS molar, 'Molar' AS source_unit FROM part""",
)
def migrate_stimulus_bath(spark, folder):
    csv = F.concat(
        F.lit("ontologyName,name,value,ontologyUnit,unitName\n"),
        F.concat_ws(",", F.concat(F.lit("chebi:"), F.col("p_partkey").cast("string")), "p_name",
                    F.col("p_retailprice").cast("string"), F.lit("om:1"), F.lit("Molar")),
        F.lit("\nchebi:1,water,2.5,om:2,drops\n"),
    )
    block = F.struct(
        F.struct(F.concat(F.lit("bath:"), F.col("p_size").cast("string")).alias("ontologyNode"), F.lit("b").alias("name")).alias("location"),
        csv.alias("mixture_table"),
    )
    docs = legacy(t.table(spark, folder, "part"), "stimulus_bath", t.uid("part:", F.col("p_partkey")), {"stimulus_bath": block})
    out = migrate(docs, TARGET, only=["stimulus_bath"])
    mixture = get(
        out,
        "stimulus_bath.mixture",
        "array<struct<chemical:struct<node:string,name:string>,amount:struct<molar:double,source_unit:string>>>",
    )
    first = F.get(mixture, F.lit(0))
    return out.select(
        "id",
        get(out, "stimulus_bath.location.node", "string").alias("location"),
        F.size(mixture).alias("n_chemicals"),
        first["chemical"]["node"].alias("node"),
        first["chemical"]["name"].alias("name"),
        first["amount"]["molar"].alias("molar"),
        first["amount"]["source_unit"].alias("source_unit"),
    )


@query(
    "migrate_stimulus_presentation",
    f"""SELECT {EVENT_ID} AS id, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS n_stimuli,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def migrate_stimulus_presentation(spark, folder):
    one = F.struct(F.parse_json("props").alias("parameters"))
    rows = _events(spark, folder)
    many = F.col("event_type") == "view"
    single = legacy(rows.where(~many), "stimulus_presentation", _event_id(), {"stimulus_presentation": F.struct(one.alias("stimuli"))})
    array = legacy(
        rows.where(many), "stimulus_presentation", _event_id(), {"stimulus_presentation": F.struct(F.array(one, one).alias("stimuli"))}
    )
    out = migrate(single.unionByName(array), TARGET, only=["stimulus_presentation"])
    return out.select(
        "id",
        F.size(get(out, "stimulus_presentation.stimuli", "array<variant>")).alias("n_stimuli"),
        F.try_variant_get("body", "$.stimulus_presentation.stimuli[0].parameters.k", "bigint").alias("k"),
    )


@query(
    "migrate_text_fields",
    f"""SELECT {EVENT_ID} AS id, user_id AS first_size, event_type||',trial' AS labels, 'double' AS data_type,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def migrate_text_fields(spark, folder):
    grid = F.struct(
        F.lit(2).alias("ndims"),
        F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(",4]")).alias("dim_sizes"),
        F.array("event_type", F.lit("trial")).alias("dim_labels"),
        F.lit("double").alias("dataType"),
    )
    fit = F.struct(F.col("props").alias("fit_parameters"))
    docs = legacy(_events(spark, folder), "ngrid", _event_id(), {"ngrid": grid, "fitcurve": fit})
    out = migrate(docs, TARGET, only=["ngrid", "fitcurve"])
    return out.select(
        "id",
        F.try_variant_get("body", "$.ngrid.dim_sizes[0]", "bigint").alias("first_size"),
        get(out, "ngrid.dim_labels", "string").alias("labels"),
        get(out, "ngrid.data_type", "string").alias("data_type"),
        get(out, "fitcurve.fit_parameters.k", "bigint").alias("k"),
    )


# -- the universal rules and the dispatcher ------------------------------------------------------
@query(
    "underscore_shape",
    f"""SELECT {CUSTOMER_ID} AS id, c_name AS name, 'customer' AS class_name, '2.1.0' AS class_version, 'base,customer' AS lineage,
               'nation_id' AS dep_name, {uid_sql("'nation:'||c_nationkey")} AS document_id, c_mktsegment AS segment,
               'datestamp,id,name,session_id' AS base_names FROM customer""",
)
def underscore_shape(spark, folder):
    doc = F.struct(
        F.lit("customer").alias("_classname"),
        F.lit("2.1.0").alias("_class_version"),
        F.array(F.struct(F.lit("base").alias("_classname"), F.lit("path/base.json").alias("_schema"))).alias("_superclasses"),
        F.array(
            F.struct(F.lit("nation_id").alias("_name"), t.uid("nation:", F.col("c_nationkey")).alias("_value"))
        ).alias("_depends_on"),
        t.uid("customer:", F.col("c_custkey")).alias("id"),
        t.uid("session").alias("session_id"),
        F.col("c_name").alias("name"),
        F.lit(t.FIXED_STAMP).alias("datestamp"),
        F.struct(F.col("c_mktsegment").alias("mktsegment")).alias("customer_properties"),
    )
    docs = normalise_wire_shape(spread(t.table(spark, folder, "customer")).select(F.to_variant_object(doc).alias("doc")))
    catalog = Catalog.from_definitions([t.BASE, t.define("customer", [t.define_field("mktsegment", "char")])])
    out = migrate(docs, catalog, block_renames={"customer_properties": "customer"}, blocks={})
    entry = F.get("depends_on", F.lit(0))
    return out.select(
        "id",
        "name",
        "class_name",
        "class_version",
        F.array_join("lineage", ",").alias("lineage"),
        entry["name"].alias("dep_name"),
        entry["document_id"].alias("document_id"),
        get(out, "customer.mktsegment", "string").alias("segment"),
        field_names(out, "base").alias("base_names"),
    )


@query(
    "migration_steps",
    f"""SELECT {CUSTOMER_ID} AS id, c_name AS label, c_mktsegment AS segment, c_nationkey AS nation, lower(c_mktsegment) AS lowered,
               c_acctbal > 0 AS flag, c_acctbal AS only_value, 'grp_a,inner,label,lowered,only_value,wrapped,zflag' AS names FROM customer""",
)
def migration_steps(spark, folder):
    block = F.struct(
        F.col("c_name").alias("Label"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_mktsegment").alias("lowered"),
        F.col("c_nationkey").alias("grp_A_nation"),
        F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("zflag"),
        F.array("c_acctbal").alias("only_value"),
        F.lit(1).alias("wrapped"),
        F.lit("gone").alias("scratch"),
    )
    docs = legacy(t.table(spark, folder, "customer"), "thing", t.uid("customer:", F.col("c_custkey")), {"thing": block})
    todo = [
        s.rename_fields({"Label": "label"}),
        s.move_path("segment", "inner", "segment"),
        s.drop_path("scratch"),
        s.lower_values("lowered"),
        s.cast_flag("zflag"),
        s.unwrap_singleton("only_value"),
        s.wrap_scalar("wrapped"),
        s.regroup_prefixed("grp", ["A"]),
    ]
    out = migrate(docs, Catalog.from_definitions([t.BASE, t.define("thing")]), blocks={"thing": todo})
    return out.select(
        "id",
        get(out, "thing.label", "string").alias("label"),
        get(out, "thing.inner.segment", "string").alias("segment"),
        get(out, "thing.grp_a.nation", "int").alias("nation"),
        get(out, "thing.lowered", "string").alias("lowered"),
        get(out, "thing.zflag", "boolean").alias("flag"),
        get(out, "thing.only_value", "double").alias("only_value"),
        field_names(out, "thing").alias("names"),
    )


def _mixed(spark, folder):
    """One document per order: current, legacy and withdrawn ones side by side."""
    orders = t.table(spark, folder, "orders")
    name = (
        F.when(F.col("o_orderstatus") == "F", "ontologyLabel")
        .when(F.col("o_orderstatus") == "O", "ontology_label")
        .otherwise("animalsubject")
    )
    block = F.struct(
        F.lit("Atlas One").alias("ontology_name"),
        F.col("o_orderpriority").alias("label"),
        (F.col("o_custkey") % 10).alias("label_id"),
    )
    docs = legacy(orders, name, t.uid("order:", F.col("o_orderkey")), {"ontologyLabel": block})
    version = F.when(F.col("class_name") == "ontology_label", "V_delta")
    return docs.withColumn("schema_version", version)


@query(
    "migration_report",
    """SELECT CASE o_orderstatus WHEN 'P' THEN 'animalsubject' ELSE 'ontology_label' END AS class_name,
              CASE WHEN o_orderstatus = 'O' THEN 'current' WHEN o_orderstatus = 'P' THEN 'withdrawn'
                   WHEN o_custkey % 10 = 0 THEN 'flagged' ELSE 'migrated' END AS migration_status,
              count(*) AS n_documents,
              count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_invalid
       FROM orders GROUP BY 1, 2""",
)
def migration_report_query(spark, folder):
    out = migrate(_mixed(spark, folder), TARGET, only=["ontology_label"])
    # Current documents here kept a block under its legacy name, which validation rejects.
    return migration_report(out, TARGET, classes=["ontology_label"])


@query("withdrawn_documents", f"SELECT {ORDER_ID} AS id FROM orders WHERE o_orderstatus = 'P'")
def withdrawn(spark, folder):
    return withdrawn_documents(_mixed(spark, folder)).select("id")


@query(
    "migrate_twice",
    f"""SELECT {ORDER_ID} AS id, o_orderstatus = 'F' AS converted, CASE WHEN o_orderstatus = 'P' THEN 'withdrawn' ELSE 'current' END AS migration_status,
               CASE WHEN o_orderstatus = 'F' THEN 'atlas_one:'||(o_custkey % 10) END AS node FROM orders""",
)
def migrate_twice(spark, folder):
    once = migrate(_mixed(spark, folder), TARGET, only=["ontology_label"])
    again = migrate(once, TARGET, only=["ontology_label"])
    node = get(again, "ontology_label.term.node", "string")
    return again.select("id", node.isNotNull().alias("converted"), "migration_status", node.alias("node"))
