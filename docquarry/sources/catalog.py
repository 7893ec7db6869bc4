"""The class catalog: a few hundred metadata rows, resolved once on the driver.

Corpus-sized work never depends on collecting documents; only class files are.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquarry.fixed_values import BASE_CLASS

_MISSING = object()


def entry(mapping: Mapping, key: str, default=None):
    """Read a metadata key in its plain or underscore-prefixed spelling."""
    found = mapping.get(key, _MISSING)
    return mapping.get("_" + key, default) if found is _MISSING else found


#: Spellings of the bound keywords that mean the same.
CONSTRAINT_SYNONYMS = {
    "minimum": ("minimum", "min", "min_value"),
    "maximum": ("maximum", "max", "max_value"),
    "maxLength": ("maxLength", "max_length"),
    "minLength": ("minLength", "min_length"),
}


@dataclass(frozen=True)
class FieldDef:
    declaring_class: str
    name: str
    type: str
    non_empty: bool = False
    scalar: bool = True
    no_nan: bool = False
    queryable: bool = False
    placement: str = "declaring_class"
    default: object = None
    ontology: Mapping | None = None
    constraints: Mapping = field(default_factory=dict)
    fields: tuple["FieldDef", ...] = ()
    discriminator: str | None = None

    def constraint(self, key: str):
        for spelling in CONSTRAINT_SYNONYMS.get(key, (key,)):
            if self.constraints.get(spelling) is not None:
                return self.constraints[spelling]
        return None


@dataclass(frozen=True)
class DependencyDef:
    declaring_class: str
    name: str
    required: bool
    multiple: bool
    must_refer_to: str

    @property
    def base_name(self) -> str:
        """``x_#`` declares ``x_1``, ``x_2``, ...; the shared stem is ``x``."""
        return self.name.removesuffix("_#")


@dataclass(frozen=True)
class ClassDef:
    name: str
    version: str
    superclasses: tuple[str, ...]
    abstract: bool
    fields: tuple[FieldDef, ...]
    dependencies: tuple[DependencyDef, ...]
    files: tuple[str, ...]
    directories: tuple[str, ...]


def _field(owner: str, raw: Mapping) -> FieldDef:
    return FieldDef(
        declaring_class=owner,
        name=entry(raw, "name"),
        type=raw["type"],
        non_empty=bool(entry(raw, "mustBeNonEmpty", False)),
        scalar=bool(entry(raw, "mustBeScalar", True)),
        no_nan=bool(entry(raw, "mustNotHaveNaN", False)),
        queryable=bool(entry(raw, "queryable", False)),
        placement=entry(raw, "placement", "declaring_class"),
        default=entry(raw, "default_value"),
        ontology=entry(raw, "ontology"),
        constraints=entry(raw, "constraints", {}) or {},
        fields=tuple(_field(owner, sub) for sub in entry(raw, "fields", []) or []),
        discriminator=entry(raw, "discriminator"),
    )


def parse_class(raw: Mapping) -> ClassDef:
    header = raw.get("document_class", raw)
    name = entry(header, "class_name") or entry(header, "classname")
    parents = []
    for parent in entry(header, "superclasses", []) or []:
        parents.append(entry(parent, "class_name") or entry(parent, "classname"))
    return ClassDef(
        name=name,
        version=entry(header, "class_version", "1.0.0"),
        superclasses=tuple(parents),
        abstract=bool(entry(header, "abstract", False)),
        fields=tuple(_field(name, f) for f in entry(raw, "fields", []) or []),
        dependencies=tuple(
            DependencyDef(
                name,
                entry(d, "name"),
                bool(entry(d, "mustBeNonEmpty", False)),
                bool(entry(d, "multiple", False)),
                entry(d, "must_refer_to_document_class", "") or "",
            )
            for d in entry(raw, "depends_on", []) or []
        ),
        files=tuple(entry(f, "name") for f in entry(raw, "file", []) or []),
        directories=tuple(entry(f, "name") for f in entry(raw, "directory", []) or []),
    )


class Catalog:
    """Resolved classes: chains, blocks, fields by block, dependencies by chain."""

    def __init__(self, classes: Iterable[ClassDef]):
        self.classes = {c.name: c for c in classes}
        self._chain = lru_cache(maxsize=None)(self._resolve_chain)

    @classmethod
    def from_definitions(cls, definitions: Iterable[Mapping]) -> "Catalog":
        return cls(parse_class(d) for d in definitions)

    def _resolve_chain(self, name: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(known ancestors, unknown ancestors), ancestors first, each once, cycles cut."""
        order: dict[str, None] = {}
        unknown: dict[str, None] = {}

        def visit(current: str, path: frozenset[str]) -> None:
            for parent in self.classes[current].superclasses:
                if parent in path:
                    continue
                if parent not in self.classes:
                    unknown.setdefault(parent)
                    continue
                visit(parent, path | {parent})
                order.setdefault(parent)

        if name in self.classes:
            visit(name, frozenset({name}))
        order.pop(name, None)
        return tuple(order), tuple(unknown)

    def ancestors(self, name: str) -> tuple[str, ...]:
        return self._chain(name)[0]

    def unresolved(self, name: str) -> tuple[str, ...]:
        return self._chain(name)[1]

    def lineage(self, name: str) -> tuple[str, ...]:
        return (*self.ancestors(name), name)

    def descendants(self, name: str) -> set[str]:
        """The class itself and every class below it."""
        return {c for c in self.classes if name in self.lineage(c)}

    def concrete(self) -> list[str]:
        return sorted(c.name for c in self.classes.values() if not c.abstract)

    def placed_fields(self, name: str) -> list[tuple[str, FieldDef]]:
        """(block, field) for every field of the chain, ancestors first."""
        return [
            (name if f.placement == "concrete_class" else owner, f)
            for owner in self.lineage(name)
            for f in self.classes[owner].fields
        ]

    def blocks(self, name: str) -> list[str]:
        """Blocks a document of this class carries, ancestors first."""
        out = []
        for owner in self.lineage(name):
            definition = self.classes[owner]
            hosts = any(f.placement != "concrete_class" for f in definition.fields)
            if not definition.abstract or hosts:
                out.append(owner)
        return out

    def dependencies(self, name: str) -> list[DependencyDef]:
        return [d for owner in self.lineage(name) for d in self.classes[owner].dependencies]

    def queryable(self, path: str) -> bool | None:
        """True / False for a declared path, None when no class declares it."""
        segments = [s.removesuffix("[*]") for s in path.split(".")]
        if segments[0] in ("id", "session_id", "name", "datestamp") and len(segments) == 1:
            segments = [BASE_CLASS, *segments]
        definition = self.classes.get(segments[0])
        if definition is None or len(segments) < 2:
            return None
        for block, found in self.placed_fields(segments[0]):
            if block == segments[0] and found.name == segments[1]:
                for name in segments[2:]:
                    inner = next((f for f in found.fields if f.name == name), None)
                    if inner is None:
                        break
                    found = inner
                return found.queryable
        return None

    # -- metadata as tables -------------------------------------------------------
    def classes_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c.name, c.version, c.abstract, list(self.ancestors(c.name)), list(self.unresolved(c.name)))
            for c in self.classes.values()
        ]
        return spark.createDataFrame(
            rows,
            "class_name string, class_version string, abstract boolean, "
            "ancestors array<string>, unresolved_parents array<string>",
        )

    def fields_table(self, spark: SparkSession) -> DataFrame:
        """One row per (concrete class, field of its chain), with the block it is placed in."""
        rows = []
        for name in self.classes:
            for position, (block, f) in enumerate(self.placed_fields(name)):
                annotation = f.ontology or {}
                rows.append(
                    (
                        name,
                        position,
                        block,
                        f.declaring_class,
                        f.name,
                        f.type,
                        f.queryable,
                        annotation.get("node"),
                        annotation.get("name"),
                        None if f.default is None else json.dumps(f.default),
                    )
                )
        return spark.createDataFrame(
            rows,
            "class_name string, position int, block string, declaring_class string, field string, "
            "type string, queryable boolean, ontology_node string, ontology_name string, default_json string",
        )

    def dependencies_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, d.declaring_class, d.base_name, d.required, d.multiple, d.must_refer_to)
            for name in self.classes
            for d in self.dependencies(name)
        ]
        return spark.createDataFrame(
            rows,
            "class_name string, declaring_class string, dep_base_name string, required boolean, "
            "multiple boolean, must_refer_to string",
        )

    def files_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c.name, kind, record)
            for c in self.classes.values()
            for kind, records in (("file", c.files), ("directory", c.directories))
            for record in records
        ]
        return spark.createDataFrame(rows, "class_name string, kind string, record string")


def read_catalog(spark: SparkSession, path: str, pattern: str = "*.json") -> Catalog:
    """Class files below ``path`` (flat or in tier folders), by the pattern of their names.

    Only metadata is collected: one small JSON file per class.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .where(F.contains("value", F.lit("fields")))
    )
    parsed = (json.loads(row["value"]) for row in files.collect())
    return Catalog.from_definitions(d for d in parsed if "document_class" in d or "_classname" in d)
