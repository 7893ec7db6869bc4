"""Phase 1 validation: every rule is a Column, one narrow pass over the corpus.

The errors of a document stay on its row (``errors``), because blank, missing and
repeated ids are errors themselves and could not be joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docquarry.fixed_values import (
    BASE_CLASS,
    CANONICAL_FIELD,
    CLASS_NAME_KEYS,
    CONCENTRATION_FIELDS,
    CURIE_PATTERN,
    CURRENT_SCHEMA_VERSION,
    DEPENDS_ON_KEYS,
    FILE_KEYS,
    HEADER_KEY,
    LEGACY_SCHEMA_VERSIONS,
    NUMBER_TYPES,
    PREFIXES,
    TEXT_TYPES,
    TIMESTAMP_PATTERN,
    UID_PATTERN,
)
from docquarry.functions.quantities import canonical, unit_entry
from docquarry.functions.scalars import literal_map, same_major, split_list
from docquarry.functions.terms import curie_prefix
from docquarry.functions.values import DocumentLayout, Place, TypedPlace, VariantPlace, false_if_null
from docquarry.session import compute_once
from docquarry.sources.catalog import Catalog, FieldDef

ERROR_TYPE = "array<struct<declaring_class:string,field:string,rule:string,message:string,severity:string>>"


@dataclass(frozen=True)
class Check:
    """One rule on one place: ``test`` gets the place and returns true where it is violated."""

    rule: str
    message: str
    test: Callable[[Place], Column | None]
    path: str = ""
    severity: str = "error"


def _text_test(test: Callable[[Column], Column]) -> Callable:
    def run(place: Place) -> Column | None:
        text = place.text()
        return None if text is None else test(text)

    return run


def _number_test(test: Callable[[Column], Column]) -> Callable:
    def run(place: Place) -> Column | None:
        number = place.number()
        return None if number is None else test(number)

    return run


def _cells(place: Place) -> Column | None:
    """All numbers of a vector or matrix as one array."""
    options = []
    if place.vector() is not None:
        options.append(place.vector())
    if place.matrix() is not None:
        options.append(F.flatten(place.matrix()))
    return F.coalesce(*options) if options else None


def _rows(place: Place) -> Column | None:
    options = []
    if place.matrix() is not None:
        options.append(place.matrix())
    if place.vector() is not None:
        options.append(F.when(place.vector().isNotNull(), F.array(place.vector())))
    return F.coalesce(*options) if options else None


def _any(column: Column | None, test: Callable[[Column], Column]) -> Column | None:
    return None if column is None else F.exists(column, lambda x: F.coalesce(test(x), F.lit(False)))


# -- per type -------------------------------------------------------------------------
def _sub(place: Place, name: str, kind: str) -> Column | None:
    """Text / number / flag of a sub-field, None where it cannot exist."""
    found = place.child(name)
    return None if found is None else getattr(found, kind)()


def _quantity_checks(f: FieldDef) -> list[Check]:
    main = CANONICAL_FIELD[f.type]
    expected = [main, "approximate", "source_unit", "source_value"]
    units = f.constraints.get("allowed_units")

    def shape(place: Place) -> Column:
        keys = place.keys()
        wrong_keys = F.lit(True) if keys is None else ~(
            F.array_sort(keys) == F.array(*[F.lit(k) for k in sorted(expected)])
        )
        parts = [
            _sub(place, main, "number"),
            _sub(place, "approximate", "flag"),
            _sub(place, "source_unit", "text"),
            _sub(place, "source_value", "number"),
        ]
        wrong_type = F.lit(False)
        for part in parts:
            wrong_type = wrong_type | (F.lit(True) if part is None else part.isNull())
        return ~place.is_null() & (F.coalesce(wrong_keys, F.lit(True)) | wrong_type)

    def invariant(place: Place) -> Column | None:
        unit, value = _sub(place, "source_unit", "text"), _sub(place, "source_value", "number")
        stored, approximate = _sub(place, main, "number"), _sub(place, "approximate", "flag")
        if unit is None or value is None or stored is None or approximate is None:
            return None
        entry = unit_entry(f.type, unit)
        exact = canonical(value, entry["exponent10"], entry["multiplier"])
        plain = value * F.pow(F.lit(10.0), entry["exponent10"]) * entry["multiplier"]
        agrees = ((stored == exact) | (stored == plain)) & (approximate == entry["approximate"])
        complete = stored.isNotNull() & approximate.isNotNull() & unit.isNotNull() & value.isNotNull()
        return complete & ~F.coalesce(agrees, F.lit(False))

    checks = [
        Check("V15", "quantity needs exactly its four typed sub-fields", shape),
        Check("V16", "canonical value or approximate flag disagrees with the source unit", invariant),
    ]
    if units:
        checks.append(
            Check("V17", f"unit not in {list(units)}", lambda p: _not_in(_sub(p, "source_unit", "text"), units))
        )
    low, high = f.constraint("minimum"), f.constraint("maximum")
    if low is not None:
        checks.append(Check("V18", f"below minimum {low}", lambda p: _less(_sub(p, main, "number"), low)))
    if high is not None:
        checks.append(Check("V18", f"above maximum {high}", lambda p: _more(_sub(p, main, "number"), high)))
    if f.no_nan:
        for name in (main, "source_value"):
            checks.append(
                Check("V8", "NaN is not allowed", lambda p, n=name: _nan(_sub(p, n, "number")), path=f".{name}")
            )
    return checks


def _not_in(text: Column | None, allowed: Sequence[str]) -> Column | None:
    return None if text is None else ~text.isin(list(allowed))


def _less(number: Column | None, bound) -> Column | None:
    return None if number is None else number < F.lit(float(bound))


def _more(number: Column | None, bound) -> Column | None:
    return None if number is None else (number > F.lit(float(bound))) & ~F.isnan(number)


def _nan(number: Column | None) -> Column | None:
    return None if number is None else F.isnan(number)


def _concentration_checks(f: FieldDef) -> list[Check]:
    allowed = [*CONCENTRATION_FIELDS, "approximate", "source_unit", "source_value"]

    def shape(place: Place) -> Column:
        keys = place.keys()
        extra = F.lit(False) if keys is None else F.size(
            F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))
        ) > 0
        unit, value = _sub(place, "source_unit", "text"), _sub(place, "source_value", "number")
        missing = (F.lit(True) if unit is None else unit.isNull()) | (F.lit(True) if value is None else value.isNull())
        return ~place.is_null() & (F.coalesce(extra, F.lit(True)) | missing)

    return [Check("V15", "concentration needs source unit and value, and only known sub-fields", shape)]


def _term_checks(f: FieldDef, registry) -> list[Check]:
    def shape(place: Place) -> Column:
        keys = place.keys()
        right = F.lit(False) if keys is None else F.array_sort(keys) == F.array(F.lit("name"), F.lit("node"))
        if isinstance(place, TypedPlace):  # a typed struct cannot tell an absent name from a null one
            right = F.lit({"name", "node"} == set(getattr(place.dtype, "names", [])))
        return ~place.is_null() & ~F.coalesce(right, F.lit(False))

    def curie(place: Place) -> Column | None:
        node = _sub(place, "node", "text")
        if node is None:
            return None
        has_node = false_if_null(place.child("node").present())
        return has_node & ~F.coalesce(node.rlike(CURIE_PATTERN), F.lit(False))

    def namespace(place: Place, allowed: Sequence[str]) -> Column | None:
        node = _sub(place, "node", "text")
        return None if node is None else ~curie_prefix(node).isin([a.lower() for a in allowed])

    checks = [
        Check("V19", "term needs exactly node and name", shape),
        Check("V20", "node is not a CURIE", curie),
    ]
    allowed = f.constraints.get("allowed_namespaces")
    if allowed:
        checks.append(Check("V21", f"namespace not in {list(allowed)}", lambda p: namespace(p, allowed)))
    known = [p[0].lower() for p in registry]
    vague = [p[0].lower() for p in registry if p[3]]
    checks.append(
        Check("V33", "prefix is not in the registry", lambda p: namespace(p, known), severity="warning")
    )
    if vague:

        def approximate(place: Place) -> Column | None:
            node = _sub(place, "node", "text")
            return None if node is None else curie_prefix(node).isin(vague)

        checks.append(Check("V33", "prefix is only approximate", approximate, severity="warning"))
    return checks


def _matrix_checks(f: FieldDef) -> list[Check]:
    c = f.constraints
    n_rows, n_cols = c.get("rows"), c.get("cols")
    shape = c.get("shape")
    if isinstance(shape, str) and "x" in shape:
        last = shape.rsplit("x", 1)[1].strip()
        n_cols = int(last) if last.isdigit() and n_cols is None else n_cols
    checks = []
    if n_rows is not None:
        checks.append(Check("V14", f"needs {n_rows} rows", lambda p: _sized(_rows(p), n_rows)))
    if n_cols is not None:
        checks.append(
            Check("V14", f"needs {n_cols} columns", lambda p: _any(_rows(p), lambda r: F.size(r) != int(n_cols)))
        )
    low, high = f.constraint("minimum"), f.constraint("maximum")
    if low is not None:
        checks.append(Check("V14", f"element below {low}", lambda p: _any(_cells(p), lambda x: x < float(low))))
    if high is not None:
        checks.append(
            Check("V14", f"element above {high}", lambda p: _any(_cells(p), lambda x: (x > float(high)) & ~F.isnan(x)))
        )
    if c.get("element_type") == "integer":
        checks.append(Check("V14", "element is not an integer", lambda p: _any(_cells(p), lambda x: x != F.floor(x))))
    return checks


def _sized(column: Column | None, n: int) -> Column | None:
    return None if column is None else F.size(column) != int(n)


def _structure_checks(f: FieldDef, registry) -> list[Check]:
    out: list[Check] = []
    value_type = f.constraints.get("value_type")
    if value_type:
        out.append(Check("V28", f"a value is not of type {value_type}", lambda p: _map_values(p, value_type)))
    for sub in f.fields:
        for check in field_checks(sub, registry):
            if f.scalar:
                out.append(
                    replace(
                        check,
                        path=f".{sub.name}{check.path}",
                        test=lambda p, s=sub, t=check.test: ~p.is_null() & false_if_null(_on_child(p, s.name, t)),
                    )
                )
            else:
                rule = check.rule if check.rule == "V29" else f"V29/{check.rule}"
                out.append(
                    replace(
                        check,
                        rule=rule,
                        path=f"[*].{sub.name}{check.path}",
                        test=lambda p, s=sub, t=check.test: p.any_element(lambda e: _on_child(e, s.name, t)),
                    )
                )
    if not f.scalar:
        out.append(
            Check("V29", "must be an array of records", lambda p: ~p.is_null() & ~p.is_array())
        )
    return out


def _map_values(place: Place, value_type: str) -> Column | None:
    if isinstance(place, TypedPlace) and not isinstance(place.dtype, T.MapType):
        return None
    if isinstance(place, TypedPlace):
        values, of = F.map_values(place.col), place.dtype.valueType
        wrap = lambda v: TypedPlace.of(v, of)
    else:
        values = F.map_values(F.try_variant_get(place.col, "$", "map<string,variant>"))
        wrap = VariantPlace

    def bad(v: Column) -> Column:
        found = wrap(v)
        if value_type in NUMBER_TYPES:
            number = found.number()
            if number is None:
                return F.lit(True)
            wrong = number.isNull()
            return wrong | (number != F.floor(number)) if value_type == "integer" else wrong
        text = found.text()
        return F.lit(True) if text is None else text.isNull()

    return F.exists(values, lambda v: F.coalesce(bad(v), F.lit(False)))


def _on_child(place: Place, name: str, test: Callable) -> Column | None:
    child = place.child(name)
    return None if child is None else test(child)


# -- per field --------------------------------------------------------------------------
def _blank(f: FieldDef, place: Place) -> Column:
    """The per-type meaning of "empty"; zero and false are values."""
    if f.type == "ontology_term":
        node = place.child("node")
        return F.lit(True) if node is None else node.empty()
    if f.type in CANONICAL_FIELD:
        parts = [place.child(n) for n in (CANONICAL_FIELD[f.type], "source_unit", "source_value")]
        out = F.lit(False)
        for part in parts:
            out = out | (F.lit(True) if part is None else part.empty())
        return out
    return place.empty()


def field_checks(f: FieldDef, registry=PREFIXES) -> list[Check]:
    """All rules that follow from one field definition, in reporting order."""
    checks: list[Check] = [
        # Only an open layout can tell an absent field from a null one.
        Check("V5", "field is missing", lambda p: ~p.present() if isinstance(p, VariantPlace) else None)
    ]
    if f.non_empty:
        checks.append(
            Check(
                "V6",
                "must be non-empty",
                lambda p: (p.present() & _blank(f, p)) if isinstance(p, VariantPlace) else _blank(f, p),
            )
        )
    structured = f.type == "structure" or f.type == "matrix"
    if f.scalar and f.type != "matrix":
        checks.append(Check("V7", "must be a single value", lambda p: p.is_array()))
    if f.type in TEXT_TYPES:
        longest, shortest = f.constraint("maxLength"), f.constraint("minLength")
        pattern, allowed = f.constraints.get("pattern"), f.constraints.get("enum")
        if longest is not None:
            checks.append(
                Check("V11", f"longer than {longest}", _text_test(lambda t: F.length(t) > int(longest)))
            )
        if shortest is not None:
            checks.append(
                Check("V13", f"shorter than {shortest}", _text_test(lambda t: F.length(t) < int(shortest)))
            )
        if pattern:
            checks.append(Check("V13", f"does not match {pattern}", _text_test(lambda t: ~t.rlike(pattern))))
        if allowed:
            checks.append(Check("V13", f"not one of {list(allowed)}", _text_test(lambda t: ~t.isin(list(allowed)))))
    elif f.type == "timestamp":
        checks.append(
            Check("V9", "bad timestamp format", _text_test(lambda t: (t != "") & ~t.rlike(TIMESTAMP_PATTERN)))
        )
        checks.append(
            Check(
                "V9",
                "no such calendar instant",
                _text_test(lambda t: t.rlike(TIMESTAMP_PATTERN) & F.try_to_timestamp(t).isNull()),
                severity="warning",
            )
        )
    elif f.type == "did_uid":
        checks.append(Check("V10", "bad identifier format", _text_test(lambda t: (t != "") & ~t.rlike(UID_PATTERN))))
    elif f.type in NUMBER_TYPES:
        low, high = f.constraint("minimum"), f.constraint("maximum")
        if low is not None:
            checks.append(Check("V12", f"below minimum {low}", _number_test(lambda n: _less(n, low))))
        if high is not None:
            checks.append(Check("V12", f"above maximum {high}", _number_test(lambda n: _more(n, high))))
        if f.no_nan:
            checks.append(Check("V8", "NaN is not allowed", _number_test(F.isnan)))
    elif f.type == "matrix":
        checks += _matrix_checks(f)
        if f.no_nan:
            checks.append(Check("V8", "NaN is not allowed", lambda p: _any(_cells(p), F.isnan)))
    elif f.type in CANONICAL_FIELD:
        checks += _quantity_checks(f)
    elif f.type == "concentration":
        checks += _concentration_checks(f)
    elif f.type == "ontology_term":
        checks += _term_checks(f, registry)
    if structured and f.type == "structure":
        checks += _structure_checks(f, registry)
    return checks


# -- per document --------------------------------------------------------------------------
def _error(declaring: str, name: str, rule: str, message: str, severity: str = "error") -> Column:
    return F.struct(
        F.lit(declaring).alias("declaring_class"),
        F.lit(name).alias("field"),
        F.lit(rule).alias("rule"),
        F.lit(message).alias("message"),
        F.lit(severity).alias("severity"),
    )


@dataclass(frozen=True)
class DocumentRule:
    """A rule across several fields of a block: ``test(layout)`` is true where violated."""

    rule: str
    field: str
    message: str
    test: Callable[[DocumentLayout], Column | None]
    severity: str = "error"


def parallel_lists(block: str, lists: Sequence[str], keyed: str, keys: str) -> list[DocumentRule]:
    """Comma lists of equal length; the keys of ``keyed`` are exactly the entries of ``keys``."""

    def part(layout: DocumentLayout, name: str) -> Column | None:
        place = layout.locate([block, name])
        return None if place is None or place.text() is None else split_list(place.text())

    def counts(layout: DocumentLayout) -> Column | None:
        parts = [part(layout, n) for n in lists]
        if any(p is None for p in parts):
            return None
        out = F.lit(False)
        for other in parts[1:]:
            out = out | (F.size(other) != F.size(parts[0]))
        return out

    def same_keys(layout: DocumentLayout) -> Column | None:
        place, names = layout.locate([block, keyed]), part(layout, keys)
        if place is None or names is None or place.keys() is None:
            return None
        found = place.keys()
        return (F.size(F.array_except(found, names)) > 0) | (F.size(F.array_except(names, found)) > 0)

    return [
        DocumentRule("V25", lists[0], "list lengths differ", counts),
        DocumentRule("V25", keyed, "keys differ from the listed names", same_keys),
    ]


def _count_of(layout: DocumentLayout, path: str) -> Column | None:
    """How many entries a path holds: a number, a comma list, an array or an object."""
    column_count = path.endswith("#cols")
    place = layout.locate(path.removesuffix("#cols").split("."))
    if place is None:
        return None
    if column_count:
        rows = _rows(place)
        return None if rows is None else F.size(F.get(rows, F.lit(0)))
    options = []
    if place.number() is not None:
        options.append(place.number().cast("int"))
    if place.text() is not None:
        options.append(F.size(split_list(place.text())))
    if place.size() is not None:
        options.append(place.size())
    return F.coalesce(*options) if options else None


def same_size(rule: str, paths: Sequence[str]) -> DocumentRule:
    """All paths hold equally many entries; absent ones are not compared."""

    def test(layout: DocumentLayout) -> Column | None:
        counts = [c for c in (_count_of(layout, p) for p in paths) if c is not None]
        if len(counts) < 2:
            return None
        out = F.lit(False)
        for other in counts[1:]:
            out = out | F.coalesce(other != counts[0], F.lit(False))
        return out

    return DocumentRule(rule, paths[-1].rsplit(".", 1)[1], "sizes differ: " + ", ".join(paths), test)


def matrix_shape(rule: str, matrix: str, rows: str, cols: str | None = None) -> DocumentRule:
    """A matrix has as many rows (and columns) as other fields say; what is absent isn't compared.

    A vector is a matrix of one row or of one column.
    """

    def test(layout: DocumentLayout) -> Column | None:
        place, n_rows = layout.locate(matrix.split(".")), _count_of(layout, rows)
        if place is None or n_rows is None:
            return None
        n_cols = F.lit(None).cast("int") if cols is None else _count_of(layout, cols)
        n_cols = F.lit(None).cast("int") if n_cols is None else n_cols
        wrong = F.lit(False)
        if place.matrix() is not None:
            uneven = F.exists(place.matrix(), lambda r: F.coalesce(F.size(r) != n_cols, F.lit(False)))
            wrong = wrong | F.coalesce((F.size(place.matrix()) != n_rows) | uneven, F.lit(False))
        if place.vector() is not None:
            size = F.size(place.vector())
            one_row = (n_rows == 1) & F.coalesce(size == n_cols, F.lit(True))
            one_col = (size == n_rows) & F.coalesce(n_cols == 1, F.lit(True))
            wrong = wrong | F.coalesce(~(one_row | one_col), F.lit(False))
        return wrong

    sizes = rows if cols is None else f"{rows} x {cols}"
    return DocumentRule(rule, matrix.rsplit(".", 1)[1], f"shape differs from {sizes}", test)


def variant_requirements(block: str, tag: str, required: Mapping[str, Sequence[str]]) -> list[DocumentRule]:
    """Discriminated union: which sub-fields each tag value needs."""

    def test(layout: DocumentLayout, value: str, name: str) -> Column | None:
        tag_place, place = layout.locate([block, tag]), layout.locate([block, name])
        if tag_place is None or tag_place.text() is None:
            return None
        lacking = F.lit(True) if place is None else place.empty()
        return (tag_place.text() == value) & lacking

    return [
        DocumentRule("V30", name, f"needed when {tag} is {value}", lambda l, v=value, n=name: test(l, v, n))
        for value, names in required.items()
        for name in names
    ]


def keyed_body(
    block: str,
    body: str,
    tag: str,
    central: Mapping[str, Sequence[FieldDef]],
    local: Mapping[str, Sequence[FieldDef]] | None = None,
    registry=PREFIXES,
) -> list[DocumentRule]:
    """Body fields chosen by a discriminator; unknown or doubly defined kinds are errors."""
    local = local or {}
    known = sorted({*central, *local})
    both = sorted({*central} & {*local})

    def tag_text(layout: DocumentLayout) -> Column | None:
        place = layout.locate([block, tag])
        return None if place is None else place.text()

    def unknown(layout: DocumentLayout) -> Column | None:
        text = tag_text(layout)
        return None if text is None else ~text.isin(known) if known else text.isNotNull()

    def doubled(layout: DocumentLayout) -> Column | None:
        text = tag_text(layout)
        return None if text is None else text.isin(both)

    rules = [DocumentRule("V32", tag, "kind is not registered", unknown)]
    if both:
        rules.append(DocumentRule("V32", tag, "kind is defined twice", doubled))
    for kind in known:
        if kind in both:
            continue
        for f in central.get(kind, local.get(kind, ())):
            for check in field_checks(f, registry):

                def test(layout: DocumentLayout, kind=kind, f=f, check=check) -> Column | None:
                    text, place = tag_text(layout), layout.locate([block, body])
                    if text is None or place is None:
                        return None
                    return (text == kind) & false_if_null(_on_child(place, f.name, check.test))

                rules.append(
                    DocumentRule(f"V32/{check.rule}", f"{body}.{f.name}{check.path}", check.message, test, check.severity)
                )
    return rules


#: Cross-field rules of known classes.
DOCUMENT_RULES: dict[str, list[DocumentRule]] = {
    "ontology_table_row": parallel_lists(
        "ontology_table_row", ["names", "variable_names", "ontology_nodes"], "data", "variable_names"
    ),
    "ngrid": [
        same_size("V26", ["ngrid.ndims", "ngrid.dim_sizes"]),
        same_size("V26", ["ngrid.ndims", "ngrid.dim_labels"]),
    ],
    "site2channelmap": [same_size("V26", ["site2channelmap.num_sites", "site2channelmap.site_to_channel"])],
    "probe_geometry": [same_size("V26", ["probe_geometry.num_channels", "probe_geometry.channel_positions"])],
    "neuron_extracellular": [
        same_size(
            "V26",
            ["neuron_extracellular.number_of_samples_per_channel", "neuron_extracellular.waveform_sample_times"],
        ),
        matrix_shape(
            "V26",
            "neuron_extracellular.mean_waveform",
            "neuron_extracellular.number_of_samples_per_channel",
            "neuron_extracellular.number_of_channels",
        ),
    ],
    "stimulus_parameter_table": [
        same_size(
            "V26", ["stimulus_parameter_table.parameter_names", "stimulus_parameter_table.table_data#cols"]
        ),
        matrix_shape("V26", "stimulus_parameter_table.table_data", "stimulus_parameter_table.num_stimuli"),
    ],
    "stimulus_tuningcurve": [
        same_size(
            "V27",
            [
                "stimulus_tuningcurve.independent_values",
                "stimulus_tuningcurve.response_mean",
                "stimulus_tuningcurve.response_stderr",
            ],
        )
    ],
}


def _bound(name: str) -> Column:
    return F.exists(
        "depends_on", lambda d: (d["name"] == name) & (F.coalesce(d["document_id"], F.lit("")) != "")
    )


def _numbered_blank(stem: str) -> Column:
    """Zero numbered entries are fine; one that is there must not be empty."""
    return F.exists(
        "depends_on",
        lambda d: d["name"].rlike(rf"^{stem}_[1-9][0-9]*$") & (F.coalesce(d["document_id"], F.lit("")) == ""),
    )


def _dependency_checks(catalog: Catalog, owner: str) -> list[Column]:
    out = []
    for dep in catalog.classes[owner].dependencies:
        if not dep.required:
            continue
        wrong = _numbered_blank(dep.base_name) if dep.multiple else ~_bound(dep.name)
        out.append(
            F.when(F.coalesce(wrong, F.lit(True)), _error(owner, dep.name, "V22", "dependency must be non-empty"))
        )
    return out


def _class_error(name: str, rule: str, message: str, severity: str = "error") -> Column:
    """An error declared by the document's own class."""
    return F.struct(
        F.col("class_name").alias("declaring_class"),
        F.lit(name).alias("field"),
        F.lit(rule).alias("rule"),
        F.lit(message).alias("message"),
        F.lit(severity).alias("severity"),
    )


def _header_errors(df: DataFrame, catalog: Catalog, names: Sequence[str], schema_versions, schema_version_required: bool = False) -> list[Column]:
    class_name, columns = F.col("class_name"), set(df.columns)
    # A missing class name is unknown too: every row falls under some rule.
    known = F.coalesce(class_name.isin(list(names)), F.lit(False))
    out = [F.when(~known, _class_error("class_name", "unknown_class", "class is not in the catalog"))]
    if "unreadable" in columns:
        out.append(F.when(F.col("unreadable").isNotNull(), _class_error("", "unreadable", "no JSON object")))
    if "envelope_gaps" in columns:
        for part in (HEADER_KEY, CLASS_NAME_KEYS[0], DEPENDS_ON_KEYS[0]):
            lacks = F.coalesce(F.array_contains("envelope_gaps", part), F.lit(False))
            out.append(F.when(lacks, _class_error(part, "V1", "the envelope lacks it")))
    abstract = [n for n in names if catalog.classes[n].abstract]
    if abstract:
        out.append(
            F.when(class_name.isin(abstract), _class_error("class_name", "V2", "abstract classes have no documents"))
        )
    if "superclasses" in columns:
        chain = F.try_element_at(literal_map({n: catalog.ancestors(n) for n in names}, "array<string>"), class_name)
        seen = F.transform("superclasses", lambda s: s["class_name"])
        differs = chain.isNotNull() & F.coalesce(seen != chain, F.lit(True))
        out.append(F.when(differs, _class_error("superclasses", "V3", "differs from the catalog chain")))
    if "class_version" in columns:
        version = F.try_element_at(literal_map({n: catalog.classes[n].version for n in names}, "string"), class_name)
        agrees = F.coalesce(same_major(F.col("class_version"), version), F.lit(False))
        out.append(
            F.when(
                version.isNotNull() & ~agrees,
                _class_error("class_version", "V23", "other MAJOR version than the catalog"),
            )
        )
    if "schema_version" in columns:
        bad = F.col("schema_version").isNotNull() & ~F.col("schema_version").isin(list(schema_versions))
        out.append(F.when(bad, _class_error("schema_version", "V24", "unknown schema set")))
        if schema_version_required:
            absent = F.col("schema_version").isNull()
            out.append(F.when(absent, _class_error("schema_version", "V24", "no schema set is named")))
    incomplete = [n for n in names if catalog.unresolved(n)]
    if incomplete:
        out.append(
            F.when(
                class_name.isin(incomplete),
                _class_error("superclasses", "unresolved_parent", "a parent class is not in the catalog", "warning"),
            )
        )
    return out


def _block_errors(df: DataFrame, catalog: Catalog, names: Sequence[str], layout: DocumentLayout) -> list[Column]:
    """V1 and V4, for blocks kept in the open body."""
    if layout.body not in df.columns:
        return []
    class_name = F.col("class_name")
    blocks = F.map_filter(
        F.try_variant_get(layout.body, "$", "map<string,variant>"), lambda k, _: ~k.isin(*FILE_KEYS)
    )
    keys = F.map_keys(blocks)
    wanted = F.try_element_at(literal_map({n: catalog.blocks(n) for n in names}, "array<string>"), class_name)
    # The block of a parent the catalog lacks is no stranger.
    complete = class_name.isin([n for n in names if not catalog.unresolved(n)])
    declared: dict[str, list[str]] = {}
    for name in names:
        for block, f in catalog.placed_fields(name):
            fields = declared.setdefault(block, [])
            if f.name not in fields:
                fields.append(f.name)
    for block in {b for n in names for b in catalog.blocks(n)}:
        declared.setdefault(block, [])
    extra = F.exists(
        F.map_entries(blocks),
        lambda e: F.coalesce(
            F.size(
                F.array_except(
                    F.map_keys(F.try_variant_get(e["value"], "$", "map<string,variant>")),
                    F.try_element_at(literal_map(declared, "array<string>"), e["key"]),
                )
            )
            > 0,
            F.lit(False),
        ),
    )
    return [
        F.when(
            complete & (F.size(F.array_except(keys, wanted)) > 0),
            _class_error("", "V1", "block of a class outside the chain"),
        ),
        F.when(
            wanted.isNotNull() & F.coalesce(F.size(F.array_except(wanted, keys)) > 0, F.lit(True)),
            _class_error("", "V1", "block of the chain is missing"),
        ),
        F.when(wanted.isNotNull() & extra, _class_error("", "V4", "a block has undeclared fields")),
    ]


def _field_place(layout: DocumentLayout, block: str, f: FieldDef) -> Place | None:
    if block == BASE_CLASS and layout.body in layout.schema.fieldNames():
        return VariantPlace(F.col(layout.body)).child(BASE_CLASS).child(f.name)
    return layout.locate([block, f.name])


def _field_errors(layout: DocumentLayout, block: str, f: FieldDef, registry) -> list[Column]:
    place = _field_place(layout, block, f)
    if place is None:
        hosted = layout.block(block) is not None or block == BASE_CLASS
        return [_error(f.declaring_class, f.name, "V5", "field is missing")] if hosted else []
    out = []
    for check in field_checks(f, registry):
        violated = check.test(place)
        if violated is not None:
            out.append(
                F.when(
                    false_if_null(violated),
                    _error(f.declaring_class, f.name + check.path, check.rule, check.message, check.severity),
                )
            )
    return out


def _part(errors: Sequence[Column], applies: Column | None = None) -> list[Column]:
    if not errors:
        return []
    found = F.array_compact(F.array(*errors)).cast(ERROR_TYPE)
    return [found if applies is None else F.when(applies, found)]


def validate(
    df: DataFrame,
    catalog: Catalog,
    classes: Sequence[str] | None = None,
    registry=PREFIXES,
    schema_versions: Iterable[str] = (CURRENT_SCHEMA_VERSION, *LEGACY_SCHEMA_VERSIONS),
    rules: Mapping[str, Sequence[DocumentRule]] = DOCUMENT_RULES,
    schema_version_required: bool = False,
) -> DataFrame:
    """Add the ``errors`` array to every document, in one pass without a shuffle.

    ``classes`` names the classes known to occur (default: the whole catalog); a
    document of any other class gets the error ``unknown_class``.  Rules are built
    once per *declaring* class and apply to every class whose chain contains it.
    Documents of the current schema set name it; older ones need not, so its absence is an
    error only with ``schema_version_required``.
    """
    names = sorted(catalog.classes) if classes is None else sorted(classes)
    layout = DocumentLayout(df.schema)
    class_name = F.col("class_name")
    parts = _part(
        _header_errors(df, catalog, names, list(schema_versions), schema_version_required) + _block_errors(df, catalog, names, layout)
    )
    owners = list(dict.fromkeys(owner for name in names for owner in catalog.lineage(name)))
    for owner in owners:
        below = [n for n in names if owner in catalog.lineage(n)]
        errors = []
        for f in catalog.classes[owner].fields:
            if f.placement != "concrete_class":
                errors += _field_errors(layout, owner, f, registry)
                continue
            for name in below:  # the field sits in the block of the concrete class
                parts += _part(_field_errors(layout, name, f, registry), class_name == name)
        errors += _dependency_checks(catalog, owner)
        for rule in rules.get(owner, ()):
            violated = rule.test(layout)
            if violated is not None:
                errors.append(
                    F.when(false_if_null(violated), _error(owner, rule.field, rule.rule, rule.message, rule.severity))
                )
        parts += _part(errors, class_name.isin(below))
    # Bound once: a filter on the errors would otherwise be copied down into the scan's projections.
    return compute_once(df.withColumn("errors", F.flatten(F.array_compact(F.array(*parts)))), "errors")


def is_valid() -> Column:
    """True for rows of :func:`validate` without an error (warnings do not reject)."""
    return ~F.exists("errors", lambda e: e["severity"] == "error")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): complementary filters on the row's own errors."""
    return validated.where(is_valid()), validated.where(~is_valid())


def error_rows(validated: DataFrame) -> DataFrame:
    """One row per error."""
    return validated.select("id", "class_name", F.explode("errors").alias("e")).select("id", "class_name", "e.*")


def validate_rows(rows: DataFrame, array_field: FieldDef, keep: Sequence[str], registry=PREFIXES) -> DataFrame:
    """Element rules for an array stored one element per row (no document is assembled)."""
    layout = DocumentLayout(rows.schema, body="")
    found = []
    for sub in array_field.fields:
        place = layout.block(sub.name)
        if place is None:
            found.append(_error(array_field.declaring_class, f"{array_field.name}[*].{sub.name}", "V29/V5", "field is missing"))
            continue
        for check in field_checks(sub, registry):
            violated = check.test(place)
            if violated is not None:
                found.append(
                    F.when(
                        false_if_null(violated),
                        _error(
                            array_field.declaring_class,
                            f"{array_field.name}[*].{sub.name}{check.path}",
                            f"V29/{check.rule}",
                            check.message,
                            check.severity,
                        ),
                    )
                )
    return rows.select(*keep, F.array_compact(F.array(*found)).cast(ERROR_TYPE).alias("errors"))


def version_impact(df: DataFrame, catalog_new: Catalog, classes: Sequence[str] | None = None, **options) -> DataFrame:
    """Documents per class that another catalog version would reject."""
    checked = validate(df, catalog_new, classes, **options)
    return checked.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(~is_valid()).alias("n_failing"),
    )


