"""The query model: search structures compiled to one Catalyst predicate.

A query is a tree of leaves ``Q(field, operation, param1, param2)`` joined by
AND / OR.  Leaves are two-valued: an absent field, a null or a wrong type is
false *before* a ``~`` prefix negates it.  ``[*]`` means "any element".
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field as dc_field, replace

from pyspark.sql import Column, DataFrame, functions as F

from docquarry.functions.quantities import to_canonical_literal
from docquarry.functions.values import DocumentLayout, Place, bound_columns, false_if_null
from docquarry.fixed_values import CANONICAL_FIELD


# -- the tree --------------------------------------------------------------------
class Query:
    def __and__(self, other: "Query") -> "Query":
        return And((self, other))

    def __or__(self, other: "Query") -> "Query":
        return Or((self, other))


@dataclass(frozen=True)
class Q(Query):
    """One search structure."""

    field: str
    operation: str
    param1: object = None
    param2: object = None

    def __invert__(self) -> "Q":
        op = self.operation
        return replace(self, operation=op[1:] if op.startswith("~") else "~" + op)


@dataclass(frozen=True)
class And(Query):
    parts: tuple[Query, ...]


@dataclass(frozen=True)
class Or(Query):
    parts: tuple[Query, ...]


def and_(*parts: Query) -> Query:
    return And(tuple(parts))


def or_(*parts: Query) -> Query:
    return Or(tuple(parts))


def all_() -> Q:
    """Every document."""
    return Q("", "isa", "base")


def none_() -> Q:
    """No document: class names start with a letter, so this one cannot exist."""
    return Q("", "isa", "0no_such_class")


def quantity(path: str, comparison: str, value: float, unit: str, dimension: str) -> Q:
    """Compare a quantity field with a literal in any unit of its dimension."""
    return Q(f"{path}.{CANONICAL_FIELD[dimension]}", comparison, to_canonical_literal(value, unit, dimension))


def query_from_struct(tree: Mapping | Sequence) -> Query:
    """Array / object literal form: a list is AND, operation ``or`` holds two lists."""
    if isinstance(tree, Query):
        return tree
    if isinstance(tree, Mapping):
        if tree["operation"] == "or":
            return Or(tuple(query_from_struct(tree[k]) for k in ("param1", "param2") if tree.get(k) is not None))
        return Q(tree.get("field", ""), tree["operation"], tree.get("param1"), tree.get("param2"))
    return And(tuple(query_from_struct(part) for part in tree))


# -- operations on one place ---------------------------------------------------------
def _compare(test: Callable[[Column, Column], Column], nan_passes: bool = False) -> Callable:
    """A numeric comparison; Spark orders NaN last, so upper-open ones must exclude it."""

    def leaf(place: Place, bound, _=None) -> Column | None:
        number = place.number()
        if number is None:
            return None
        if place.integral() and float(bound).is_integer():
            return test(place.col, F.lit(int(bound)))
        truth = test(number, F.lit(float(bound)))
        return truth & ~F.isnan(number) if nan_passes else truth

    return leaf


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _exact_string(place: Place, want: str, _=None) -> Column | None:
    text = place.text()
    return None if text is None else text == F.lit(want)


def _contains_string(place: Place, want: str, _=None) -> Column | None:
    text = place.text()
    return None if text is None else F.contains(text, F.lit(want))


def _regexp(place: Place, pattern: str, _=None) -> Column | None:
    text = place.text()
    return None if text is None else text.rlike(pattern)


def _double_array(values: Sequence) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def _exact_number(place: Place, want, _=None) -> Column | None:
    if _is_number(want):
        if place.integral() and float(want).is_integer():
            return place.col == F.lit(int(want))
        number = place.number()
        return None if number is None else (number == F.lit(float(want))) & ~F.isnan(number)
    if want and isinstance(want[0], (list, tuple)):
        matrix = place.matrix()
        return None if matrix is None else matrix == F.array(*[_double_array(row) for row in want])
    vector = place.vector()
    return None if vector is None else vector == _double_array(want)


def _hasmember(place: Place, want, _=None) -> Column | None:
    if isinstance(want, str):
        return place.any_element(lambda e: _exact_string(e, want))
    return place.any_element(lambda e: _exact_number(e, want))


#: Extension point: operation name -> function of (place, param1, param2).
OPERATIONS: dict[str, Callable] = {
    "exact_string": _exact_string,
    "contains_string": _contains_string,
    "regexp": _regexp,
    "exact_number": _exact_number,
    "lessthan": _compare(lambda n, b: n < b),
    "lessthaneq": _compare(lambda n, b: n <= b),
    "greaterthan": _compare(lambda n, b: n > b, nan_passes=True),
    "greaterthaneq": _compare(lambda n, b: n >= b, nan_passes=True),
    "hasfield": lambda place, *_: place.present(),
    "hasmember": _hasmember,
    "is_empty": lambda place, *_: place.empty(),
}
DOCUMENT_OPERATIONS = ("isa", "depends_on")


# -- corpora whose arrays are stored as rows -------------------------------------------
@dataclass(frozen=True)
class ChildTable:
    """An array-of-structures kept one element per row, keyed to its document.

    ``rows.<parent_key>`` equals ``documents.<key>``.  A document with millions of
    elements never has to fit in one row.
    """

    rows: DataFrame
    parent_key: str
    key: str


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    children: Mapping[str, ChildTable] = dc_field(default_factory=dict)


# -- compilation -----------------------------------------------------------------------
def _segments(path: str) -> list[str]:
    return path.split(".")


def _desugar(leaf: Q) -> Q:
    """``hasanysubfield_contains_string`` is ``contains_string`` below ``[*]``."""
    bare = leaf.operation.lstrip("~")
    if bare != "hasanysubfield_contains_string":
        return leaf
    return Q(
        f"{leaf.field}[*].{leaf.param1}", leaf.operation.replace(bare, "contains_string"), leaf.param2
    )


def _walk(place: Place | None, segments: list[str], test: Callable) -> Column | None:
    """Follow the segments below ``place``; ``x[*]`` turns into an existential."""
    if place is None:
        return None
    for i, segment in enumerate(segments):
        name = segment.removesuffix("[*]")
        place = place.child(name)
        if place is None:
            return None
        if segment.endswith("[*]"):
            rest = segments[i + 1 :]
            return place.any_element(lambda e: _walk(e, rest, test))
    return test(place)


class QueryCompiler:
    """Turns a tree into one boolean Column for a given layout."""

    def __init__(
        self,
        layout: DocumentLayout,
        catalog=None,
        snapshot_checked: bool = False,
        not_queryable: str | None = None,
        precomputed: Mapping[Q, Column] | None = None,
    ):
        self.layout = layout
        self.catalog = catalog
        self.snapshot_checked = snapshot_checked
        self.not_queryable = not_queryable
        self.precomputed = precomputed or {}

    def compile(self, tree: Query, as_filter: bool = False) -> Column:
        """The two-valued truth of ``tree``.

        ``as_filter``: the column is only used by ``where``.  AND / OR are monotone
        and a filter drops NULL like false, so plain leaves may stay NULL there and
        reach the Parquet scan as pushed filters.  Negated leaves never may.
        """
        if isinstance(tree, And):
            return self._fold(tree.parts, lambda a, b: a & b, True, as_filter)
        if isinstance(tree, Or):
            return self._fold(tree.parts, lambda a, b: a | b, False, as_filter)
        leaf = _desugar(tree)
        negated = leaf.operation.startswith("~")
        found = self._leaf(replace(leaf, operation=leaf.operation.lstrip("~")))
        if negated:
            return ~false_if_null(found)
        if as_filter and found is not None:
            implied = implied_bounds(self.layout, leaf)
            return found if implied is None else implied & found
        return false_if_null(found)

    def _fold(self, parts, join, unit: bool, as_filter: bool) -> Column:
        columns = [self.compile(p, as_filter) for p in parts]
        out = columns[0] if columns else F.lit(unit)
        for col in columns[1:]:
            out = join(out, col)
        return out

    def _leaf(self, leaf: Q) -> Column | None:
        if leaf.operation == "isa":
            return self._isa(leaf.param1)
        if leaf.operation == "depends_on":
            return F.exists(
                "depends_on",
                lambda d: (d["name"] == F.lit(leaf.param1)) & (d["document_id"] == F.lit(leaf.param2)),
            )
        if leaf.operation not in OPERATIONS:
            raise ValueError(f"unknown operation {leaf.operation!r}")
        self._guard(leaf.field)
        key = _child_key(leaf)
        if key in self.precomputed:
            return self.precomputed[key]
        return leaf_column(self.layout, leaf)

    def _isa(self, class_name: str) -> Column:
        # Class names alone answer `isa` (and prune partitions) once the stored
        # superclass snapshots were checked against the catalog.
        if self.snapshot_checked and self.catalog is not None and class_name in self.catalog.classes:
            return F.col("class_name").isin(sorted(self.catalog.descendants(class_name)))
        return (F.col("class_name") == class_name) | F.array_contains("lineage", class_name)

    def _guard(self, path: str) -> None:
        if self.catalog is None or self.not_queryable is None or not path:
            return
        if self.catalog.queryable(path) is False:
            message = f"field {path!r} is declared as not queryable"
            if self.not_queryable == "raise":
                raise ValueError(message)
            warnings.warn(message, stacklevel=4)


def leaf_column(layout: DocumentLayout, leaf: Q) -> Column | None:
    operation = OPERATIONS[leaf.operation]
    segments = _segments(leaf.field)

    def test(place: Place) -> Column | None:
        return operation(place, leaf.param1, leaf.param2)

    plain = [s for s in segments if not s.endswith("[*]")]
    if len(plain) == len(segments):
        place = layout.locate(segments)
        if place is None:
            return F.lit(True) if leaf.operation == "is_empty" else None
        return test(place)
    head = segments[0].removesuffix("[*]")
    place = layout.block(head)
    if segments[0].endswith("[*]"):
        return None if place is None else place.any_element(lambda e: _walk(e, segments[1:], test))
    return _walk(place, segments[1:], test)


#: What an operation on some element says about the least and the greatest of all elements.
_IMPLIED: dict[str, Callable] = {
    "exact_number": lambda low, high, v: (low <= v) & (high >= v),
    "lessthan": lambda low, high, v: low < v,
    "lessthaneq": lambda low, high, v: low <= v,
    "greaterthan": lambda low, high, v: high > v,
    "greaterthaneq": lambda low, high, v: high >= v,
}


def implied_bounds(layout: DocumentLayout, leaf: Q) -> Column | None:
    """What a leaf over elements implies about stored bounds of its path.

    The condition holds wherever the leaf does, and it is on plain columns, so it reaches the
    scan as a pushed filter and files without a match are skipped; the leaf itself can't.
    """
    path, operation, value = leaf.field, leaf.operation, leaf.param1
    if operation == "hasmember":
        path, operation = f"{path}[*]", "exact_string" if isinstance(value, str) else "exact_number"
    if "[*]" not in path:
        return None
    bounds = bound_columns(layout.schema, path)
    if operation == "exact_string" and isinstance(value, str) and {"least_text", "greatest_text"} <= bounds.keys():
        return _IMPLIED["exact_number"](bounds["least_text"], bounds["greatest_text"], F.lit(value))
    if operation in _IMPLIED and _is_number(value) and {"least", "greatest"} <= bounds.keys():
        return _IMPLIED[operation](bounds["least"], bounds["greatest"], F.lit(float(value)))
    return None


def _child_key(leaf: Q) -> Q:
    """Leaves are looked up by value; list parameters become hashable."""
    freeze = lambda p: tuple(freeze(x) for x in p) if isinstance(p, (list, tuple)) else p
    return Q(leaf.field, leaf.operation, freeze(leaf.param1), freeze(leaf.param2))


def leaves(tree: Query) -> list[Q]:
    if isinstance(tree, (And, Or)):
        return [leaf for part in tree.parts for leaf in leaves(part)]
    leaf = _desugar(tree)
    return [replace(leaf, operation=leaf.operation.lstrip("~"))]


def _child_flags(corpus: Corpus, tree: Query) -> tuple[DataFrame, dict[Q, Column]]:
    """Join one flag per ``[*]`` leaf over row-stored arrays to the documents.

    Rows that satisfy no leaf are dropped at the scan, the rest collapse to one
    row per document map-side (bool_or), so a document owning a third of all
    rows is as cheap to shuffle as any other.
    """
    documents = corpus.documents
    flags: dict[Q, Column] = {}
    for number, (path, child) in enumerate(corpus.children.items()):
        prefix = path + "[*]."
        layout = DocumentLayout(child.rows.schema, body="")
        hits: dict[Q, tuple[str, Column]] = {}  # leaf -> flag name, raw truth of a row
        for leaf in leaves(tree):
            key = _child_key(leaf)
            if key in hits:
                continue
            name = f"__hit_{number}_{len(hits)}"
            if leaf.field.startswith(prefix):
                inner = replace(leaf, field=leaf.field[len(prefix) :])
                found = leaf_column(layout, inner)
                hits[key] = (name, F.lit(False) if found is None else found)
            elif leaf.field == path and leaf.operation in ("hasfield", "is_empty"):
                hits[key] = (name, F.lit(True))
        if not hits:
            continue
        wanted = [hit for _, hit in hits.values()]
        any_hit = wanted[0]
        for hit in wanted[1:]:
            any_hit = any_hit | hit
        joined = f"__key_{number}"
        summary = (
            child.rows.where(any_hit)
            .groupBy(F.col(child.parent_key).alias(joined))
            .agg(*[F.bool_or(hit).alias(name) for name, hit in hits.values()])
        )
        documents = documents.join(summary, documents[child.key] == summary[joined], "left").drop(joined)
        for key, (name, _) in hits.items():
            seen = F.coalesce(F.col(name), F.lit(False))
            flags[key] = ~seen if key.operation == "is_empty" and key.field == path else seen
    return documents, flags


def find(
    corpus: Corpus | DataFrame,
    tree: Query | Mapping | Sequence,
    catalog=None,
    snapshot_checked: bool = False,
    not_queryable: str | None = None,
) -> DataFrame:
    """The documents that match, with their own columns."""
    if isinstance(corpus, DataFrame):
        corpus = Corpus(corpus)
    tree = query_from_struct(tree)
    documents, flags = _child_flags(corpus, tree)
    compiler = QueryCompiler(
        DocumentLayout(documents.schema), catalog, snapshot_checked, not_queryable, flags
    )
    return documents.where(compiler.compile(tree, as_filter=True)).select(*corpus.documents.columns)


def matches(df: DataFrame, tree: Query, catalog=None) -> Column:
    """The predicate itself, for use as a flag column."""
    return QueryCompiler(DocumentLayout(df.schema), catalog).compile(query_from_struct(tree))
