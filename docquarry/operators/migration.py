"""Migration of legacy documents to the current shape: one narrow pass, no shuffle.

Input and output are canonical corpora (header columns + VARIANT ``body``).
Conversions are keyed by *block*: a subclass that carries the block of a converted
class is converted with it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.fixed_values import (
    BASE_CLASS,
    BASE_FIELDS,
    CLASS_RENAMES,
    CURRENT_SCHEMA_VERSION,
    FIELD_RENAMES,
    FILE_KEYS,
    WITHDRAWN_CLASSES,
)
from docquarry.functions.quantities import concentration
from docquarry.functions.scalars import literal_map, split_list
from docquarry.functions.terms import lower_prefix, normalise_prefix, ontology_term, snake_class
from docquarry.operators import steps as s
from docquarry.operators.structure import csv_records
from docquarry.session import compute_once
from docquarry.sources.catalog import Catalog

# -- declarations: what each block needs -------------------------------------------------
_NAKA_RUSHTON = ("RB", "RBN", "RBNS")
_NAKA_RUSHTON_SCALARS = ("pref", "empirical_c50", "r2", "relative_max_gain", "saturation_index")
_FIT_BLOCKS = ("fit_dog", "fit_movshon", "fit_movshon_c", "fit_spline", "fit_sgauss")
_FIT_SCALAR_NAMES = r"^(L50|Pref|H50|R2|Bandwidth)$"
_RATIOS = (
    "orientation_preferred_orthogonal_ratio",
    "direction_preferred_null_ratio",
    "orientation_preferred_orthogonal_ratio_rectified",
    "direction_preferred_null_ratio_rectified",
)
_PRIEBE_BLOCKS = ("fit", "fit_no_speed", "fit_fullspeed")
_INDIVIDUAL = ("individual", "raw_individual", "control_individual")
_UNITS = {"properties": [s.zero_to_text("response_units")]}
_CURVE_FIELDS = ("mean", "stddev", "stderr", "control_stddev", "control_stderr")
_MIXTURE_SCHEMA = "ontologyName string, name string, value double, ontologyUnit string, unitName string"


def _label_node(fields: Column) -> Column:
    """``prefix:id`` from a free-form ontology label and a number."""
    return F.concat(
        F.coalesce(normalise_prefix(s.text(fields, "ontology_name")), F.lit("")),
        F.lit(":"),
        F.coalesce(s.text(fields, "label_id"), F.lit("0")),
    )


def _text_node(*names: str) -> Callable[[Column], Column]:
    return lambda fields: F.coalesce(lower_prefix(F.coalesce(*[s.text(fields, n) for n in names])), F.lit(""))


def _frequency_tuning(axis: str) -> list[s.Step]:
    metrics = s.lower_names(_FIT_SCALAR_NAMES)
    parts: dict[str, list[s.Step]] = {
        "tuning_curve": [s.empty_matrix(*_INDIVIDUAL), s.wrap_scalar(axis, *_CURVE_FIELDS)],
        **_UNITS,
        "fitless": [metrics],
        **{name: [metrics, s.wrap_scalar("parameters", "values", "fit")] for name in _FIT_BLOCKS},
    }
    return [s.within_each({**parts, "abs": [s.within_each(parts)]})]


def _readable_mixture(fields: Column) -> Column:
    """There is a table, all its columns are known, and it has a record."""
    # A header with an unknown column gives no records.
    return F.coalesce(F.size(csv_records(s.text(fields, "mixture_table"), _MIXTURE_SCHEMA)) > 0, F.lit(False))


def _unreadable_mixture(value: Column) -> Column:
    fields = s.as_fields(value)
    return s.get(fields, "mixture_table").isNotNull() & ~_readable_mixture(fields)


def _mixture(fields: Column) -> Column:
    return s.let(
        csv_records(s.text(fields, "mixture_table"), _MIXTURE_SCHEMA),
        lambda records: F.when(
            F.size(records) > 0,
            s.variant(
                F.transform(
                    records,
                    lambda r: F.struct(
                        ontology_term(r["ontologyName"], r["name"]).alias("chemical"),
                        concentration(r["value"], r["unitName"]).alias("amount"),
                    ),
                )
            ),
        ),
    )


def _dimensions(fields: Column) -> Column:
    """A comma list of CURIEs -> records with positional axis labels; labels stay empty without a lookup."""
    old = F.when(F.schema_of_variant(s.get(fields, "dimensions")) == "STRING", s.text(fields, "dimensions"))
    return F.when(
        old.isNotNull(),
        s.variant(
            F.transform(
                split_list(old),
                lambda node, i: F.struct(
                    F.concat(F.lit("axis_"), (i + 1).cast("string")).alias("axis"),
                    node.alias("node"),
                    F.lit("").alias("name"),
                ),
            )
        ),
    )


def _term_from_node(name: str) -> s.Step:
    """A lone CURIE text becomes a term with an empty label."""
    return s.put(
        name,
        lambda f: F.when(
            F.schema_of_variant(s.get(f, name)) == "STRING",
            s.variant(ontology_term(s.text(f, name), F.lit(""))),
        ),
    )


#: Terms collapsed from coordinated texts: switched off by ``collapse_ontology=False``.
TERM_CONVERSIONS: dict[str, list[s.Step]] = {
    "probe_location": [
        s.compose_term("location", ["ontology_name"], ["name"], node=_text_node("ontology_name")),
    ],
    "treatment": [
        s.compose_term(
            "treatment_name", ["ontology_name", "ontologyName"], ["name"], node=_text_node("ontologyName", "ontology_name")
        ),
    ],
}

BLOCK_CONVERSIONS: dict[str, list[s.Step]] = {
    "ontology_image": [
        s.compose_term("region", ["ontology_name"], ["ontology_region"], node=_text_node("ontology_name")),
    ],
    "ontology_label": [s.compose_term("term", ["ontology_name", "label_id"], ["label"], node=_label_node)],
    "contrast_tuning": [
        s.within_each(
            {
                "tuning_curve": [s.empty_matrix(*_INDIVIDUAL), s.wrap_scalar("contrast", *_CURVE_FIELDS)],
                **_UNITS,
                "fit": [
                    s.regroup_prefixed("naka_rushton", _NAKA_RUSHTON, s.unwrap_singleton(*_NAKA_RUSHTON_SCALARS))
                ],
            }
        ),
    ],
    "contrast_tuning_calc": [s.drop_path("depends_on")],
    "contrast_sensitivity_calc": [
        s.drop_path("depends_on"),
        s.lower_names(r"_(RB|RBN|RBNS)$"),
        s.cast_flag("is_modulated_response"),
    ],
    "spatial_frequency_tuning": _frequency_tuning("spatial_frequency"),
    "spatial_frequency_tuning_calc": [s.drop_path("depends_on")],
    "temporal_frequency_tuning": _frequency_tuning("temporal_frequency"),
    "temporal_frequency_tuning_calc": [s.drop_path("depends_on")],
    "speed_tuning": [
        s.within_each(
            {
                "tuning_curve": [
                    s.empty_matrix(*_INDIVIDUAL),
                    s.wrap_scalar("spatial_frequency", "temporal_frequency", "mean", "stddev", "stderr"),
                ],
                **_UNITS,
                **{
                    name: [s.lower_names(r"^Priebe_"), s.unwrap_singleton("priebe_fit_speed_tuning_index")]
                    for name in _PRIEBE_BLOCKS
                },
            }
        ),
    ],
    "speed_tuning_calc": [s.drop_path("depends_on")],
    "orientation_direction_tuning": [
        s.within_each(
            {
                "properties": [s.lower_values("coordinates"), *_UNITS["properties"]],
                "tuning_curve": [s.empty_matrix(*_INDIVIDUAL), s.wrap_scalar("direction", "mean", "stddev", "stderr")],
                "fit": [s.unwrap_singleton(*_RATIOS)],
            }
        ),
    ],
    "oridirtuning_calc": [
        s.drop_path("depends_on"),
        s.put(
            "input_parameters",
            lambda f: F.coalesce(s.get(f, "input_parameters"), F.parse_json(F.lit("{}"))),
        ),
    ],
    "hartley_reverse_correlation": [
        s.coalesce_paths("frame_times", "frameTimes"),
        s.within_each(
            {
                "stimulus_properties": [s.lower_names(r"^(M|L_max|K_max)$")],
                "reconstruction_properties": [s.lower_names(r"^[TXY]_coords$")],
            }
        ),
    ],
    "hartley_calc": [
        s.drop_path("depends_on"),
        s.within("input_parameters", s.lower_names(r"^(T|X_sampling|Y_sampling)$")),
    ],
    "element_epoch": [s.split_zip("clocks", "epoch_clock", "t0_t1", ["t0", "t1"])],
    "position_metadata": [
        s.coalesce_paths("measurement", "ontologyNode", "ontology_node"),
        _term_from_node("measurement"),
        _term_from_node("units"),
        s.put("dimensions", _dimensions),
    ],
    "stimulus_bath": [
        s.within("location", s.coalesce_paths("node", "ontologyNode")),
        s.put("mixture", _mixture),
        # A table that gave no record stays, and the document is flagged.
        lambda f: F.map_filter(f, lambda k, _: ~((k == "mixture_table") & _readable_mixture(f))),
    ],
    "stimulus_presentation": [s.wrap_scalar("stimuli")],
    "app": [s.rename_fields({"name": "app_name", "version": "app_version"})],
    # Text that used to carry JSON: objects and number arrays are parsed ...
    "syncgraph": [s.parse_json_text("graph_structure")],
    "fitcurve": [s.parse_json_text("fit_parameters")],
    "openminds": [s.parse_json_text("openminds_data")],
    "syncrule_mapping": [s.parse_json_text("mapping_data")],
    "spike_interface_sorting_outputs": [s.parse_json_text("sorter_parameters")],
    "tuningcurve_calc": [s.parse_json_text("result_data")],
    "vmspikefit": [s.parse_json_text("fit_parameters")],
    "spike_extraction_parameters_modification": [s.parse_json_text("modified_fields")],
    "site2channelmap": [s.parse_json_text("site_to_channel")],
    "probe_geometry": [s.parse_json_text("channel_positions")],
    "stimulus_parameter_table": [s.parse_json_text("table_data"), s.join_list("parameter_names")],
    "ngrid": [s.parse_json_text("dim_sizes"), s.join_list("dim_labels")],
    "electrode_offset_voltage": [s.parse_json_text("offset_voltages")],
    "stimulus_parameter": [s.parse_json_text("parameter_values")],
    # ... and arrays of texts become comma lists.
    "subject_group": [s.join_list("subject_ids")],
    "daqmetadatareader": [s.join_list("metadata_names")],
    "control_stimulus_ids": [s.join_list("control_ids")],
}


#: Inputs a conversion cannot settle: (block, path, test on the value, flag).
def _bad_label_id(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(number == 0, F.lit(True))


FLAGS: list[tuple[str, tuple[str, ...], Callable[[Column], Column], str]] = [
    ("element_epoch", (), s.not_zippable("epoch_clock", "t0_t1"), "unequal_lists"),
    ("stimulus_bath", (), _unreadable_mixture, "unreadable_table"),
    ("ontology_label", ("label_id",), _bad_label_id, "label_id_missing"),
    *[
        ("contrast_tuning", ("fit", f"naka_rushton_{tag}_{metric}"), s.not_singleton, "not_a_singleton")
        for tag in _NAKA_RUSHTON
        for metric in _NAKA_RUSHTON_SCALARS
    ],
    *[("orientation_direction_tuning", ("fit", name), s.not_singleton, "not_a_singleton") for name in _RATIOS],
    *[
        ("speed_tuning", (fit, "Priebe_fit_speed_tuning_index"), s.not_singleton, "not_a_singleton")
        for fit in _PRIEBE_BLOCKS
    ],
]


# -- the universal renames -------------------------------------------------------------------
def _rename_blocks(renames: Mapping[str, str]) -> s.Step:
    return s.rename_fields(renames)


def _base_block(df: DataFrame) -> s.Step:
    """Identity fields that stood at the top level move into the base block."""
    columns = {"id": "id", "session_id": "session_id", "name": "name", "datestamp": "datestamp_raw"}

    def step(blocks: Column) -> Column:
        present = F.coalesce(s.as_fields(s.get(blocks, BASE_CLASS)), F.create_map().cast("map<string,variant>"))
        lifted = F.map_filter(
            F.create_map(*[x for f in BASE_FIELDS for x in (F.lit(f), s.scalar_variant(F.col(columns[f])))]),
            lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(present), k),
        )
        return s.put(BASE_CLASS, lambda _: s.variant(F.map_concat(present, lifted)))(
            F.map_filter(blocks, lambda k, _: ~k.isin(*BASE_FIELDS))
        )

    return step


def _file_records(blocks: Column) -> Column:
    """``files.file_list`` -> records of a top-level ``file`` array."""
    names = F.try_variant_get(s.get(blocks, "files"), "$.file_list", "array<string>")
    records = F.when(names.isNotNull(), s.variant(F.transform(names, lambda n: F.struct(n.alias("name")))))
    return F.map_filter(s.put("file", lambda _: records)(blocks), lambda k, _: ~((k == "files") & names.isNotNull()))


def _convert_blocks(conversions: Mapping[str, Sequence[s.Step]]) -> list[s.Step]:
    """The block conversions as stages: stage *i* runs the *i*-th step of every block.

    Each stage is one flat CASE inside one transform, so a block pays for its own
    steps only and no stage nests deeply.
    """
    general = s.rename_fields(FIELD_RENAMES)

    def rename(name: Column, value: Column) -> Column:
        # Only blocks that hold a legacy name are rebuilt.
        affected = F.arrays_overlap(F.map_keys(s.as_fields(value)), F.array(*[F.lit(k) for k in FIELD_RENAMES]))
        return F.when(
            affected & ~name.isin(*FILE_KEYS), s.variant(s.let(s.as_fields(value), general))
        ).otherwise(value)

    def stage(i: int) -> s.Step:
        todo = {block: steps[i] for block, steps in conversions.items() if i < len(steps)}

        def convert(name: Column, value: Column) -> Column:
            out = F
            for block, step in todo.items():
                out = out.when(name == block, F.coalesce(s.variant(s.let(s.as_fields(value), step)), value))
            return out.otherwise(value)

        return lambda blocks: F.transform_values(blocks, convert)

    longest = max((len(steps) for steps in conversions.values()), default=0)
    return [lambda blocks: F.transform_values(blocks, rename), *[stage(i) for i in range(longest)]]


def _pad_blocks(catalog: Catalog, class_name: Column) -> s.Step:
    """Every class of the chain that hosts fields gets its block, if only an empty one."""
    empty = F.parse_json(F.lit("{}"))
    table = literal_map({c: catalog.blocks(c) for c in sorted(catalog.classes)}, "array<string>")

    def step(blocks: Column) -> Column:
        wanted = F.try_element_at(table, class_name)
        lacking = F.array_except(wanted, F.map_keys(blocks))
        padded = F.map_concat(blocks, F.map_from_arrays(lacking, F.transform(lacking, lambda _: empty)))
        return F.coalesce(padded, blocks)

    return step


def _snapshot(catalog: Catalog, class_name: Column, otherwise: Column) -> Column:
    """The superclass snapshot of the target catalog; classes it lacks keep their own."""
    table = {
        name: [{"class_name": a, "class_version": catalog.classes[a].version} for a in catalog.ancestors(name)]
        for name in sorted(catalog.classes)
    }
    chains = literal_map(table, "array<struct<class_name:string,class_version:string>>")
    return F.coalesce(F.try_element_at(chains, class_name), otherwise)


def _flags(body: Column, blocks) -> Column:
    found = []
    for block, path, test, flag in FLAGS:
        if block not in blocks:
            continue
        # A class's block may still have its legacy name here.
        names = [block, *[old for old, new in CLASS_RENAMES.items() if new == block]]
        holder = F.coalesce(*[F.try_variant_get(body, f'$["{n}"]', "variant") for n in names])
        value = F.try_variant_get(holder, "$" + "".join(f'["{p}"]' for p in path), "variant")
        found.append(F.when(holder.isNotNull() & test(value), F.lit(f"{flag}:{'.'.join((block, *path))}")))
    return F.array_compact(F.array(*found).cast("array<string>"))


# -- the dispatcher ------------------------------------------------------------------------------
def conversions(collapse_ontology: bool = True) -> dict[str, list[s.Step]]:
    return {**BLOCK_CONVERSIONS, **(TERM_CONVERSIONS if collapse_ontology else {})}


def migrate(
    df: DataFrame,
    catalog: Catalog,
    collapse_ontology: bool = True,
    block_renames: Mapping[str, str] | None = None,
    blocks: Mapping[str, Sequence[s.Step]] | None = None,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Bring every legacy document to the current shape.

    Current documents pass through (missing blocks are padded).  Withdrawn classes
    are kept unconverted and reported.  Adds ``migration_status`` (``current``,
    ``migrated``, ``flagged``, ``withdrawn``) and ``migration_flags``.

    ``block_renames`` maps property-block names that never equalled their class
    name; ``blocks`` replaces the built-in conversions by a caller's own; ``only`` names
    the blocks known to occur, which keeps the plan small.
    """
    current = F.coalesce(F.col("schema_version") == CURRENT_SCHEMA_VERSION, F.lit(False))
    withdrawn = F.col("class_name").isin(*WITHDRAWN_CLASSES)
    untouched = current | withdrawn
    renames = {**CLASS_RENAMES, **(block_renames or {})}
    todo = conversions(collapse_ontology) if blocks is None else dict(blocks)
    if only is not None:
        todo = {block: steps for block, steps in todo.items() if block in only}
    new_class = F.when(untouched, F.col("class_name")).otherwise(snake_class(F.col("class_name")))
    raw = s.as_fields(F.col("body"))
    pad = _pad_blocks(catalog, new_class)
    # NULL for rows that stay as they are: every stage skips them.
    staged = df.withColumn("__blocks", F.when(~untouched, raw))
    for step in (_rename_blocks(renames), _base_block(df), _file_records, *_convert_blocks(todo), pad):
        staged = staged.withColumn("__blocks", s.let(F.col("__blocks"), step))
    body = (
        F.when(withdrawn, F.col("body"))
        .when(current, s.variant(s.let(raw, pad)))
        .otherwise(s.variant(F.col("__blocks")))
    )
    flags = F.when(untouched, F.array().cast("array<string>")).otherwise(_flags(F.col("body"), todo))
    status = (
        F.when(current, "current")
        .when(withdrawn, "withdrawn")
        .when(F.size(flags) > 0, "flagged")
        .otherwise("migrated")
    )
    parents = F.when(untouched, F.col("superclasses")).otherwise(
        _snapshot(catalog, new_class, F.col("superclasses"))
    )
    replaced = {
        "class_name": new_class,
        "schema_version": F.when(withdrawn, F.col("schema_version")).otherwise(F.lit(CURRENT_SCHEMA_VERSION)),
        "superclasses": parents,
        "lineage": F.array_distinct(F.concat(F.transform(parents, lambda p: p["class_name"]), F.array(new_class))),
        "body": body,
    }
    out = staged.select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns if not c.startswith("migration_")],
        status.alias("migration_status"),
        flags.alias("migration_flags"),
    )
    # Bound once: whatever reads the new body must not repeat the conversion.
    return compute_once(out, "body")


def withdrawn_documents(df: DataFrame) -> DataFrame:
    """Documents of classes without a successor."""
    return df.where(F.col("class_name").isin(*WITHDRAWN_CLASSES))


def migration_report(migrated: DataFrame, catalog: Catalog | None = None, **options) -> DataFrame:
    """Documents per class and outcome; with a catalog also how many results fail validation.

    The outcome travels on the row, so before and after need no join.
    """
    from docquarry.operators.validation import is_valid, validate

    if catalog is None:
        return migrated.groupBy("class_name", "migration_status").agg(F.count(F.lit(1)).alias("n_documents"))
    checked = validate(migrated, catalog, **options)
    return checked.groupBy("class_name", "migration_status").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(~is_valid()).alias("n_invalid")
    )
