"""Reading and writing document corpora.

Canonical layout: typed header columns, ``depends_on`` as an array of structs and
``body``, a VARIANT holding the class blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquarry.fixed_values import (
    BASE_CLASS,
    CLASS_NAME_KEYS,
    CLASS_VERSION_KEYS,
    DEPENDENCY_ID_KEYS,
    DEPENDENCY_NAME_KEYS,
    DEPENDS_ON_KEYS,
    FILE_KEYS,
    HEADER_KEY,
    NUMBER_TYPES,
    SUPERCLASS_KEYS,
    TEXT_TYPES,
)
from docquarry.functions.scalars import parse_datestamp
from docquarry.functions.values import BOUND_KIND, BOUNDS, PROMOTED, DocumentLayout, VariantPlace, elements_at

HEADER_COLUMNS = (
    "id",
    "session_id",
    "name",
    "datestamp_raw",
    "datestamp",
    "class_name",
    "class_version",
    "schema_version",
    "superclasses",
    "lineage",
    "depends_on",
)


def _text(doc: Column, *paths: str) -> Column:
    """First of several spellings that holds a value."""
    return F.coalesce(*[F.try_variant_get(doc, p, "string") for p in paths])


def _either(parent: str, keys) -> list[str]:
    return [f'{parent}["{k}"]' for k in keys]


def depends_on_entries(doc: Column) -> Column:
    raw = F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in _either("$", DEPENDS_ON_KEYS)])
    return F.coalesce(
        F.transform(
            raw,
            lambda e: F.struct(
                _text(e, *_either("$", DEPENDENCY_NAME_KEYS)).alias("name"),
                _text(e, *_either("$", DEPENDENCY_ID_KEYS)).alias("document_id"),
            ),
        ),
        F.array().cast("array<struct<name:string,document_id:string>>"),
    )


def superclass_entries(doc: Column) -> Column:
    paths = _either(f'$["{HEADER_KEY}"]', SUPERCLASS_KEYS) + _either("$", SUPERCLASS_KEYS)
    raw = F.coalesce(*[F.try_variant_get(doc, p, "array<variant>") for p in paths])
    return F.coalesce(
        F.transform(
            raw,
            lambda e: F.struct(
                _text(e, *_either("$", CLASS_NAME_KEYS)).alias("class_name"),
                _text(e, *_either("$", CLASS_VERSION_KEYS)).alias("class_version"),
            ),
        ),
        F.array().cast("array<struct<class_name:string,class_version:string>>"),
    )


def normalise_wire_shape(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Any accepted spelling of the header and dependency keys -> canonical columns.

    ``df`` has one VARIANT column with the whole document; its other columns are kept.
    """
    whole = F.col(doc)
    header = f'$["{HEADER_KEY}"]'
    class_name = _text(whole, *_either(header, CLASS_NAME_KEYS), *_either("$", CLASS_NAME_KEYS))
    parents = superclass_entries(whole)
    blocks = F.map_filter(
        F.try_variant_get(whole, "$", "map<string,variant>"),
        lambda k, v: ~k.isin(
            HEADER_KEY, *DEPENDS_ON_KEYS, *CLASS_NAME_KEYS, *CLASS_VERSION_KEYS, *SUPERCLASS_KEYS
        ),
    )
    return df.select(
        _text(whole, "$.base.id", "$.id").alias("id"),
        _text(whole, "$.base.session_id", "$.session_id").alias("session_id"),
        _text(whole, "$.base.name", "$.name").alias("name"),
        _text(whole, "$.base.datestamp", "$.datestamp").alias("datestamp_raw"),
        parse_datestamp(_text(whole, "$.base.datestamp", "$.datestamp")).alias("datestamp"),
        class_name.alias("class_name"),
        _text(whole, *_either(header, CLASS_VERSION_KEYS), *_either("$", CLASS_VERSION_KEYS)).alias(
            "class_version"
        ),
        _text(whole, f'{header}["schema_version"]').alias("schema_version"),
        parents.alias("superclasses"),
        F.array_distinct(
            F.concat(F.transform(parents, lambda p: p["class_name"]), F.array(class_name))
        ).alias("lineage"),
        depends_on_entries(whole).alias("depends_on"),
        F.to_variant_object(blocks).alias("body"),
        envelope_gaps(whole).alias("envelope_gaps"),
        *[F.col(c) for c in df.columns if c != doc],
    )


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON Lines (splittable), or one document per file with ``multi_line``.

    ``source_file`` names the file of each document; text that is no JSON object stays, as a
    row of its own, in ``unreadable``.  Blank lines are no documents.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=multi_line)
    lines = lines.select("value", F.col("_metadata.file_path").alias("source_file"))
    return documents_from_text(lines.where(F.trim("value", F.lit(" \t\r\n")) != ""))


def documents_from_text(df: DataFrame, col: str = "value") -> DataFrame:
    """Documents held as JSON text in a table.

    Text that is no JSON object is kept in ``unreadable`` (NULL for all others), with NULL
    header columns; :func:`docquarry.operators.validation.validate` rejects such rows.
    """
    parsed = df.select(
        F.try_parse_json(col).alias("doc"), F.col(col).alias("__text"), *[c for c in df.columns if c != col]
    )
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    kept = parsed.withColumn("unreadable", F.when(~is_object, F.coalesce("__text", F.lit("")))).drop("__text")
    return normalise_wire_shape(kept)


def envelope_gaps(doc: Column) -> Column:
    """Parts of the envelope that a document lacks: header, class name, dependencies."""
    header = f'$["{HEADER_KEY}"]'
    has = {
        HEADER_KEY: [header, *_either("$", CLASS_NAME_KEYS)],
        CLASS_NAME_KEYS[0]: _either(header, CLASS_NAME_KEYS) + _either("$", CLASS_NAME_KEYS),
        DEPENDS_ON_KEYS[0]: _either("$", DEPENDS_ON_KEYS),
    }
    found = {k: F.coalesce(*[F.try_variant_get(doc, p, "variant") for p in paths]) for k, paths in has.items()}
    return F.array_compact(F.array(*[F.when(v.isNull(), F.lit(k)) for k, v in found.items()]))


def block_keys(df: DataFrame) -> Column:
    """Names of the top-level class blocks of a canonical corpus."""
    keys = F.map_keys(F.try_variant_get("body", "$", "map<string,variant>"))
    return F.array_sort(F.filter(keys, lambda k: ~k.isin(*FILE_KEYS)))


def with_bounds(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Add, for each ``[*]`` path, the least and the greatest of its numbers and of its texts.

    Queries over elements then push what they imply about these columns down to the scan.  NaN
    meets no operation and doesn't count; a document without such elements has NULL.
    """
    out, layout = df, DocumentLayout(df.schema)
    for path in paths:
        stem = path.replace("[*]", "").replace(".", "__")
        numbers = elements_at(layout, path, lambda p: p.number())
        if numbers is not None:
            real = F.filter(numbers, lambda x: ~F.isnan(x))
            out = _bound(out, f"{stem}__least", F.array_min(real), path, "least")
            out = _bound(out, f"{stem}__greatest", F.array_max(real), path, "greatest")
        texts = elements_at(layout, path, lambda p: p.text())
        if texts is not None:
            out = _bound(out, f"{stem}__least_text", F.array_min(texts), path, "least_text")
            out = _bound(out, f"{stem}__greatest_text", F.array_max(texts), path, "greatest_text")
    return out


def _bound(df: DataFrame, name: str, value: Column, path: str, kind: str) -> DataFrame:
    return df.withColumn(name, value).withMetadata(name, {BOUNDS: path, BOUND_KIND: kind})


def queryable_elements(catalog, classes=None) -> list[str]:
    """``bounds`` for the lists that the catalog declares queryable: their elements, or the
    elements' own scalar fields."""
    out = []
    for name in sorted(catalog.classes if classes is None else classes):
        for block, f in catalog.placed_fields(name):
            if not f.queryable or f.scalar or block == BASE_CLASS:
                continue
            if f.type == "structure":
                out += [f"{block}.{f.name}[*].{x.name}" for x in f.fields if x.scalar and x.type in (*TEXT_TYPES, *NUMBER_TYPES)]
            elif f.type in (*TEXT_TYPES, *NUMBER_TYPES):
                out.append(f"{block}.{f.name}[*]")
    return list(dict.fromkeys(out))


def write_corpus(
    df: DataFrame,
    path: str,
    promote: dict[str, tuple[str, str]] | None = None,
    mode: str = "errorifexists",
    bounds: Sequence[str] = (),
) -> None:
    """Persist a corpus partitioned by class.

    ``promote`` lifts fields out of the VARIANT into typed columns (column -> (dot path below
    body, type)), so that their filters reach the scan; :func:`queryable_columns` derives it
    from a catalog.  A value of another type than asked stays in the body only.  The column
    remembers its path, and queries on that path then use it.  ``bounds`` are ``[*]`` paths for
    :func:`with_bounds`; :func:`queryable_elements` derives them.
    """
    out = with_bounds(df, bounds)
    for name, (field_path, as_type) in (promote or {}).items():
        place = VariantPlace(F.col("body"))
        for step in field_path.split("."):
            place = place.child(step)
        value = {"string": place.text, "boolean": place.flag}.get(as_type, place.number)()
        out = out.withColumn(name, value.cast(as_type))
        out = out.withMetadata(name, {PROMOTED: field_path})
    out.write.mode(mode).partitionBy("class_name").parquet(path)


def queryable_columns(catalog, classes=None) -> dict[str, tuple[str, str]]:
    """``promote`` for the scalar fields that the catalog declares queryable."""
    types = {**dict.fromkeys(TEXT_TYPES, "string"), **dict.fromkeys(NUMBER_TYPES, "double"), "boolean": "boolean"}
    out = {}
    for name in sorted(catalog.classes if classes is None else classes):
        for block, f in catalog.placed_fields(name):
            if f.queryable and f.type in types and block != BASE_CLASS:
                out[f"{block}__{f.name}"] = (f"{block}.{f.name}", types[f.type])
    return out


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Directory manifests (JSON Lines).

    ``directory_id`` comes from the folder layout (``directory_id=<id>/``) where there
    is one, else it is the stem of the manifest's file name.
    """
    lines = (
        spark.read.schema("filename string, size long, checksum_sha256 string, directory_id string")
        .option("recursiveFileLookup", "true")
        .json(path)
    )
    source = F.col("_metadata.file_path")
    folder = F.nullif(F.regexp_extract(source, r"/directory_id=([^/]+)/", 1), F.lit(""))
    stem = F.regexp_extract(source, r"([^/]+?)(?:\.[^./]+)*$", 1)
    return lines.select(
        F.coalesce(folder, stem).alias("directory_id"),
        "filename",
        "size",
        "checksum_sha256",
        source.alias("source_file"),
    )
