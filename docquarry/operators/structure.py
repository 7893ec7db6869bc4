"""Document structure: headers, flat views, arrays of structures, dependencies, tables in fields."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docquarry.fixed_values import BASE_CLASS, CANONICAL_FIELD, TEXT_TYPES, UID_TYPE
from docquarry.functions.scalars import split_list
from docquarry.functions.values import DocumentLayout, VariantPlace
from docquarry.operators.steps import let
from docquarry.sources.catalog import Catalog, FieldDef
from docquarry.sources.documents import block_keys


def header(df: DataFrame) -> DataFrame:
    """Class identity, number of dependencies and block names of every document."""
    return df.select(
        "id",
        "class_name",
        "class_version",
        F.size("depends_on").alias("n_dependencies"),
        block_keys(df).alias("blocks"),
    )


def field(df: DataFrame, path: str) -> Column:
    """The value at a plain dot-path (NULL where absent)."""
    place = DocumentLayout(df.schema).locate(path.split("."))
    return F.lit(None) if place is None else place.value()


def _block_fields(body: Column) -> Column:
    """body -> map(block -> map(field -> variant)); values that are not objects become NULL."""
    return F.transform_values(
        F.try_variant_get(body, "$", "map<string,variant>"),
        lambda _, v: F.try_variant_get(v, "$", "map<string,variant>"),
    )


def field_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Long form with provenance: one row per (document, block, field)."""
    blocks = df.select(*keep, "id", "class_name", F.explode(_block_fields(F.col("body"))).alias("block", "fields"))
    return blocks.select(*keep, "id", "class_name", "block", F.explode("fields").alias("field", "value"))


def flatten_fields(df: DataFrame, catalog: Catalog) -> DataFrame:
    """Every declared field of each document's chain, ancestors first, with its value if present."""
    declared = F.broadcast(catalog.fields_table(df.sparkSession))  # metadata, fixed size
    prepared = df.select("id", "class_name", _block_fields(F.col("body")).alias("__fields"))
    return prepared.join(declared, "class_name").select(
        "id",
        "class_name",
        "position",
        "declaring_class",
        "block",
        "field",
        "type",
        F.try_element_at(F.try_element_at("__fields", F.col("block")), F.col("field")).alias("value"),
    )


def block_of(catalog: Catalog, class_name: str, field_name: str) -> str | None:
    """The block that hosts a field in documents of ``class_name`` (placement resolved)."""
    return next((b for b, f in catalog.placed_fields(class_name) if f.name == field_name), None)


def explode_structures(
    df: DataFrame,
    path: str,
    keep: Sequence[str] = ("id",),
    position: bool = False,
    outer: bool = False,
    fields: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per element of an array-of-structures.

    ``fields`` (name -> Spark type) are the columns of elements that live in an open body;
    without it such elements stay one VARIANT column ``element``.
    """
    column = field(df, path)
    if isinstance(DocumentLayout(df.schema).locate(path.split(".")), VariantPlace):
        return _explode_open(df, column, fields, keep, position, outer)
    if position:
        explode = F.posexplode_outer if outer else F.posexplode
        rows = df.select(*keep, explode(column).alias("position", "element"))
        kept = [*keep, "position"]
    else:
        explode = F.explode_outer if outer else F.explode
        rows = df.select(*keep, explode(column).alias("element"))
        kept = list(keep)
    if isinstance(rows.schema["element"].dataType, T.StructType):
        return rows.select(*kept, "element.*")
    return rows


def _explode_open(
    df: DataFrame, column: Column, fields: Mapping[str, str] | None, keep: Sequence[str], position: bool, outer: bool
) -> DataFrame:
    items = F.try_variant_get(column, "$", "array<variant>")
    explode = (F.posexplode_outer if outer else F.posexplode)(items)
    rows = df.select(*keep, explode.alias("position", "element"))
    kept = [*keep, "position"] if position else list(keep)
    if fields is None:
        return rows.select(*kept, "element")
    return rows.select(*kept, *[F.try_variant_get("element", f'$["{n}"]', t).alias(n) for n, t in fields.items()])


def _spark_type(f: FieldDef) -> str:
    """Spark type of a declared field; VARIANT where the declaration leaves it open."""
    if f.type in CANONICAL_FIELD:
        one = f"struct<{CANONICAL_FIELD[f.type]}:double,source_unit:string,source_value:double,approximate:boolean>"
    elif f.type == "ontology_term":
        one = "struct<node:string,name:string>"
    elif f.type == "matrix":
        return "array<array<double>>"
    elif f.type == "structure" and f.fields:
        one = "struct<" + ",".join(f"`{x.name}`:{_spark_type(x)}" for x in f.fields) + ">"
    elif f.type in (*TEXT_TYPES, UID_TYPE, "timestamp"):
        one = "string"
    else:
        one = {"integer": "bigint", "double": "double", "boolean": "boolean"}.get(f.type, "variant")
    return one if f.scalar else f"array<{one}>"


def _typed_value(place: VariantPlace, f: FieldDef) -> Column:
    """The value in its declared type; NULL where the document holds another one."""
    kind = _spark_type(f)
    if kind == "string":
        return place.text()
    if kind in ("bigint", "double"):
        return place.number().try_cast(kind)
    if kind == "boolean":
        return place.flag()
    if f.type == "matrix":
        row = place.vector()
        return F.coalesce(place.matrix(), F.when(row.isNotNull(), F.array(row)))
    if not f.scalar:
        # Element by element: one of another type is NULL and leaves its neighbours alone.
        items = F.try_variant_get(place.root, place.path, "array<variant>")
        return F.transform(items, lambda e: _typed_value(VariantPlace(e), replace(f, scalar=True)))
    parts = _typed_parts(place, f)
    if parts is None:
        return F.try_variant_get(place.root, place.path, kind)
    return F.when(place.is_object(), F.struct(*parts))


def _typed_parts(place: VariantPlace, f: FieldDef) -> list[Column] | None:
    """The fields of a composite or a structure, each in its own type; None for other fields."""
    if f.type in CANONICAL_FIELD:
        kinds = {CANONICAL_FIELD[f.type]: "number", "source_unit": "text", "source_value": "number", "approximate": "flag"}
    elif f.type == "ontology_term":
        kinds = {"node": "text", "name": "text"}
    elif f.type == "structure" and f.fields:
        return [_typed_value(place.child(x.name), x).alias(x.name) for x in f.fields]
    else:
        return None
    return [getattr(place.child(name), kind)().alias(name) for name, kind in kinds.items()]


def typed(df: DataFrame, catalog: Catalog, class_name: str) -> DataFrame:
    """Documents of one class, their blocks as typed columns instead of the open body.

    Every operator that reads typed blocks runs on the result.  The layout comes from the
    catalog, so no pass has to look at the data.
    """
    blocks: dict[str, list[Column]] = {}
    for block, f in catalog.placed_fields(class_name):
        if block != BASE_CLASS:
            place = VariantPlace(F.col("body")).child(block).child(f.name)
            blocks.setdefault(block, []).append(_typed_value(place, f).alias(f.name))
    kept = [c for c in df.columns if c != "body"]
    return df.where(F.col("class_name") == class_name).select(*kept, *[F.struct(*fs).alias(b) for b, fs in blocks.items()])


def dependencies(df: DataFrame, *keep: str) -> DataFrame:
    """The edge table; ``x_3`` splits into stem ``x`` and index 3."""
    edges = df.select("id", *keep, F.inline("depends_on").alias("dep_name", "document_id"))
    # Most roles carry no number; only a trailing digit is worth a regular expression.
    digit = F.substring("dep_name", -1, 1).between("0", "9")
    number = F.when(digit, F.nullif(F.regexp_extract("dep_name", r"_([1-9][0-9]*)$", 1), F.lit("")))
    stem = F.when(digit, F.regexp_replace("dep_name", r"_[1-9][0-9]*$", "")).otherwise(F.col("dep_name"))
    return edges.select(
        "id", *keep, "dep_name", stem.alias("dep_base_name"), number.cast("int").alias("dep_index"), "document_id"
    )


def numbered_dependencies(pattern: str) -> Column:
    """Array of ids bound to ``x_1``, ``x_2``, ... (for ``x_#``), in numeric order."""
    stem = pattern.removesuffix("_#")
    regex = rf"^{stem}_([1-9][0-9]*)$"
    hits = F.filter("depends_on", lambda d: d["name"].rlike(regex))
    keyed = F.transform(
        hits,
        lambda d: F.struct(
            F.regexp_extract(d["name"], regex, 1).cast("long").alias("number"),
            d["document_id"].alias("document_id"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["document_id"])


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill absent values with the declared default (never with the blank value).

    ``defaults``: column or ``block.field`` of a typed block -> default value.
    """
    if _is_open(df):
        return _open_defaults(df, defaults)
    layout = DocumentLayout(df.schema)
    by_block: dict[str, list[tuple[str, object]]] = {}
    out = df
    for path, default in defaults.items():
        head, _, rest = path.partition(".")
        if rest:
            by_block.setdefault(head, []).append((rest, default))
        elif layout.block(head) is not None:
            out = out.withColumn(head, F.coalesce(F.col(head), _literal(default, df.schema[head].dataType)))
    for block, fields in by_block.items():
        column = F.col(block)
        for name, default in fields:
            kind = df.schema[block].dataType[name].dataType
            column = column.withField(name, F.coalesce(F.col(block).getField(name), _literal(default, kind)))
        out = out.withColumn(block, F.when(F.col(block).isNotNull(), column))
    return out


def _literal(value: object, kind: T.DataType) -> Column:
    """A default as a column; lists and objects take the type of the field they fill."""
    if isinstance(kind, T.VariantType):
        return F.parse_json(F.lit(json.dumps(value)))
    if isinstance(value, (list, dict)):
        return F.from_json(F.lit(json.dumps(value)), kind)
    return F.lit(value)


def _is_open(df: DataFrame) -> bool:
    fields = df.schema.fieldNames()
    return "body" in fields and isinstance(df.schema["body"].dataType, T.VariantType)


def _open_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Defaults of blocks that live in the open body; blocks that are absent stay absent."""
    body = F.try_variant_get("body", "$", "map<string,variant>")
    by_block: dict[str, dict[str, object]] = {}
    out = df
    for path, default in defaults.items():
        head, _, rest = path.partition(".")
        if rest:
            by_block.setdefault(head, {})[rest] = default
        elif head in df.columns:
            out = out.withColumn(head, F.coalesce(F.col(head), F.lit(default)))

    def filled(name: Column, value: Column) -> Column:
        cases = F
        for block, fields in by_block.items():
            held = F.try_variant_get(value, "$", "map<string,variant>")
            given = F.from_json(F.lit(json.dumps({k: json.dumps(v) for k, v in fields.items()})), F.lit("map<string,string>"))
            absent = lambda v: v.isNull() | F.is_variant_null(v)  # noqa: E731 - of NULL the latter is false
            lacking = F.map_filter(given, lambda k, _: absent(F.try_element_at(held, k)))
            kept = F.map_filter(held, lambda k, _: ~F.array_contains(F.map_keys(lacking), k))
            whole = F.to_variant_object(F.map_concat(kept, F.transform_values(lacking, lambda _, v: F.parse_json(v))))
            cases = cases.when((name == block) & held.isNotNull(), whole)
        return cases.otherwise(value)

    if not by_block:
        return out
    return out.withColumn("body", F.to_variant_object(F.transform_values(body, filled)))


def catalog_defaults(catalog: Catalog, class_name: str) -> dict[str, object]:
    """Declared defaults of a class, lists and objects too, keyed the way :func:`with_defaults` expects."""
    return {
        f"{block}.{f.name}": f.default
        for block, f in catalog.placed_fields(class_name)
        if f.default is not None and block != BASE_CLASS
    }


def matrix_rows(df: DataFrame, path: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """A matrix (a vector counts as one row) as (row, col, value), both zero-based."""
    place = DocumentLayout(df.schema).locate(path.split("."))
    options = [place.matrix()]
    if place.vector() is not None:
        options.append(F.when(place.vector().isNotNull(), F.array(place.vector())))
    whole = F.coalesce(*[o for o in options if o is not None])
    rows = df.select(*keep, F.posexplode(whole).alias("row", "__cells"))
    return rows.select(*keep, "row", F.posexplode("__cells").alias("col", "value"))


# -- tables and lists kept inside fields -----------------------------------------------
def explode_inline_csv(df: DataFrame, col: str, schema: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Embedded CSV text with a header line -> one row per record."""
    return df.select(*keep, F.inline(csv_records(F.col(col), schema)))


def _csv_names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def _csv_header(text: Column) -> Column:
    """Trimmed names of the header line, without quotes."""
    first = F.regexp_replace(F.get(F.split(text, r"\r?\n"), F.lit(0)), '[\ufeff"]', "")
    return F.transform(F.split(first, ","), lambda name: F.trim(name))


def known_csv_header(text: Column, schema: str) -> Column:
    """True where the header line names columns of the schema only, each once."""
    return let(_csv_header(text), lambda names: _known_names(names, schema))


def _known_names(names: Column, schema: str) -> Column:
    known = F.size(F.array_except(names, F.array(*[F.lit(n) for n in _csv_names(schema)]))) == 0
    return known & (F.size(F.array_distinct(names)) == F.size(names))


def csv_records(text: Column, schema: str) -> Column:
    """CSV text with a header line -> array of records; blank lines are not records.

    Columns are found by the name in the header, in any order; a column the header lacks is
    NULL.  A header with a name outside the schema gives no records (:func:`known_csv_header`).
    """
    parts, names = schema.split(","), _csv_names(schema)
    # Read as text by position first, since the order of the columns is a matter of the row.
    wide = ", ".join(f"c{i} string" for i in range(len(parts)))
    none = F.array().cast(f"array<struct<{','.join(f'{n}:{p.split()[1]}' for n, p in zip(names, parts))}>>")

    # Lambda bodies are evaluated per line, so the header, its places and the cells of a line are bound once.
    def cells(line: Column) -> Column:
        return let(F.from_csv(line, F.lit(wide)), lambda row: F.array(*[row[f"c{i}"] for i in range(len(parts))]))

    def record(line: Column, places: Column) -> Column:
        return let(
            cells(line),
            lambda found: F.struct(
                *[
                    F.when(F.get(places, F.lit(i)) > 0, F.get(found, F.get(places, F.lit(i)) - 1))
                    .try_cast(part.split()[1])
                    .alias(name)
                    for i, (name, part) in enumerate(zip(names, parts))
                ]
            ),
        )

    def records(table: Column) -> Column:
        lines = F.filter(
            F.slice(table["lines"], F.lit(2), F.greatest(F.size(table["lines"]) - 1, F.lit(0))), lambda line: F.trim(line) != ""
        )
        places = F.array(*[F.array_position(table["names"], F.lit(n)).cast("int") for n in names])
        return F.when(
            _known_names(table["names"], schema), let(places, lambda p: F.transform(lines, lambda line: record(line, p)))
        ).otherwise(none)

    return let(F.struct(F.split(text, r"\r?\n").alias("lines"), _csv_header(text).alias("names")), records)


PROBE_MAP_FIELDS = ("name", "reference", "type", "devicestring", "subjectstring")


def explode_probe_map(df: DataFrame, col: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Tab-separated probe map (first line names the columns, in any order) -> one row per probe."""
    lines = F.filter(F.split(F.col(col), r"\r?\n"), lambda line: F.trim(line) != "")
    header = F.transform(F.split(F.get(lines, F.lit(0)), "\t"), lambda name: F.lower(F.trim(name)))

    def cell(parts: Column, name: str) -> Column:
        place = F.array_position(header, name).cast("int")
        return F.when(place > 0, F.get(parts, place - 1))

    records = F.transform(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda line: F.transform(
            F.array(F.split(line, "\t")), lambda p: F.struct(*[cell(p, name).alias(name) for name in PROBE_MAP_FIELDS])
        )[0],
    )
    return df.select(*keep, F.inline(records))


def ontology_table_long(df: DataFrame, block: str = "ontology_table_row", keep: Sequence[str] = ("id",)) -> DataFrame:
    """Parallel comma lists plus keyed data -> (position, variable, label, node, value)."""
    layout = DocumentLayout(df.schema)

    def parts(name: str) -> Column:
        place = layout.locate([block, name])
        return split_list(place.text())

    data = layout.locate([block, "data"])
    values = (
        data.col
        if isinstance(getattr(data, "dtype", None), T.MapType)
        else F.transform_values(
            F.try_variant_get(data.col, "$", "map<string,variant>"), lambda _, v: F.try_variant_get(v, "$", "string")
        )
    )
    zipped = F.arrays_zip(
        parts("variable_names").alias("variable"), parts("names").alias("label"), parts("ontology_nodes").alias("node")
    )
    rows = df.select(*keep, values.alias("__data"), F.posexplode(zipped).alias("position", "__part"))
    return rows.select(
        *keep,
        "position",
        F.col("__part")["variable"].alias("variable"),
        F.col("__part")["label"].alias("label"),
        F.col("__part")["node"].alias("node"),
        F.try_element_at("__data", F.col("__part")["variable"]).alias("value"),
    )


def ontology_table_wide(long: DataFrame, variables: Sequence[str], keep: Sequence[str] = ("id",)) -> DataFrame:
    """Inverse of the long form; the variables are named so that no pass has to find them."""
    return long.groupBy(*keep).agg(
        *[
            F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v)
            for v in variables
        ]
    )


def parameter_table_long(
    df: DataFrame, names_path: str, table_path: str, keep: Sequence[str] = ("id",)
) -> DataFrame:
    """Rows of a parameter table zipped with their names -> (stimulus, parameter, value)."""
    layout = DocumentLayout(df.schema)
    names = split_list(layout.locate(names_path.split(".")).text())
    table = layout.locate(table_path.split(".")).matrix()
    rows = df.select(*keep, names.alias("__names"), F.posexplode(table).alias("stimulus", "__row"))
    cells = rows.select(
        *keep,
        "stimulus",
        F.posexplode(F.arrays_zip(F.col("__names").alias("parameter"), F.col("__row").alias("value"))).alias(
            "parameter_index", "__cell"
        ),
    )
    return cells.select(
        *keep, "stimulus", "parameter_index",
        F.col("__cell")["parameter"].alias("parameter"), F.col("__cell")["value"].alias("value"),
    )


def property_map(names: Column, values: Column) -> Column:
    """Parallel names / values -> map; pairs beyond the shorter side have no value or no name."""
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: p["n"].isNotNull())
    return F.map_from_arrays(
        F.array_distinct(F.transform(pairs, lambda p: p["n"])),
        F.transform(
            F.array_distinct(F.transform(pairs, lambda p: p["n"])),
            lambda n: F.get(F.transform(F.filter(pairs, lambda p: p["n"] == n), lambda p: p["v"]), F.lit(0)),
        ),
    )


def merge_name_values(df: DataFrame, names_path: str, values_path: str, alias: str = "properties") -> DataFrame:
    """Add the map of a property list; a lone scalar value counts as a one-element array."""
    layout = DocumentLayout(df.schema)
    names_place = layout.locate(names_path.split("."))
    values_place = layout.locate(values_path.split("."))
    names = names_place.col.cast("array<string>") if isinstance(
        getattr(names_place, "dtype", None), T.ArrayType
    ) else F.try_variant_get(names_place.col, "$", "array<string>")
    options = [values_place.vector()]
    if values_place.number() is not None:
        options.append(F.when(values_place.number().isNotNull(), F.array(values_place.number())))
    return df.withColumn(alias, property_map(names, F.coalesce(*[o for o in options if o is not None])))
