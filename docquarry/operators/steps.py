"""Generic migration steps over one object of a document.

A step maps the fields of an object, ``map<string,variant>``, to new fields.
``edit(...)`` chains steps; each intermediate is bound once, so a long chain
costs one pass per step and its plan grows linearly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from docquarry.functions.scalars import split_list
from docquarry.functions.values import VariantPlace

Step = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def edit(fields: Column, *steps: Step) -> Column:
    out = fields
    for step in steps:
        out = let(out, step)
    return out


def as_fields(value: Column) -> Column:
    """An object's fields; NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def variant(value: Column) -> Column:
    """Any Spark value as VARIANT."""
    return F.to_variant_object(value)


def scalar_variant(value: Column) -> Column:
    return value.cast("variant")


def get(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def text(fields: Column, name: str) -> Column:
    return F.try_variant_get(get(fields, name), "$", "string")


def put(name: str, value: Callable[[Column], Column]) -> Step:
    """Set a field to a VARIANT computed from the object; NULL leaves the object unchanged."""

    def step(fields: Column) -> Column:
        return let(
            value(fields),
            lambda v: F.when(v.isNull(), fields).otherwise(
                F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), v))
            ),
        )

    return step


def _always(value: Column) -> Callable[[Column], Column]:
    return lambda _: value


def drop_path(*names: str) -> Step:
    return lambda fields: F.map_filter(fields, lambda k, _: ~k.isin(*names))


def _rename(fields: Column, new: Callable[[Column], Column]) -> Column:
    """Rename keys; where a new name is taken already, it wins and the old one goes.

    Lambda bodies are evaluated per key, so everything shared is bound outside them.
    """
    changed = F.filter(
        F.transform(F.map_keys(fields), lambda k: F.struct(k.alias("old"), new(k).alias("new"))),
        lambda p: p["old"] != p["new"],
    )

    def apply(pairs: Column) -> Column:
        renames = F.map_from_entries(pairs)
        taken = F.map_keys(fields)
        return let(
            F.struct(renames.alias("to"), taken.alias("taken")),
            lambda b: F.map_from_entries(
                F.filter(
                    F.transform(
                        F.map_entries(fields),
                        lambda e: F.struct(
                            F.when(
                                ~F.array_contains(b["taken"], F.coalesce(F.try_element_at(b["to"], e["key"]), F.lit(""))),
                                F.coalesce(F.try_element_at(b["to"], e["key"]), e["key"]),
                            )
                            .when(F.try_element_at(b["to"], e["key"]).isNull(), e["key"])
                            .alias("key"),
                            e["value"].alias("value"),
                        ),
                    ),
                    lambda e: e["key"].isNotNull(),
                )
            ),
        )

    # Most objects have nothing to rename and stay as they are.
    return let(changed, lambda pairs: F.when(F.size(pairs) == 0, fields).otherwise(apply(pairs)))


def rename_fields(renames: Mapping[str, str]) -> Step:
    def step(fields: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
        return _rename(fields, lambda k: F.coalesce(F.try_element_at(table, k), k))

    return step


def lower_names(pattern: str) -> Step:
    """Lower-case the names of fields matching ``pattern``."""
    return lambda fields: _rename(fields, lambda k: F.when(k.rlike(pattern), F.lower(k)).otherwise(k))


def within_each(inner: Mapping[str, Sequence[Step]]) -> Step:
    """Apply steps to several nested objects in one pass; what is no object stays as it is."""

    def step(fields: Column) -> Column:
        def one(k: Column, v: Column) -> Column:
            out = F
            for name, steps in inner.items():
                out = out.when(k == name, F.coalesce(variant(edit(as_fields(v), *steps)), v))
            return out.otherwise(v)

        return F.transform_values(fields, one)

    return step


def within(name: str, *steps: Step) -> Step:
    return within_each({name: steps})


def coalesce_paths(target: str, *sources: str) -> Step:
    """Read a value from whichever spelling is there and keep it under ``target``."""

    def step(fields: Column) -> Column:
        found = put(target, lambda m: F.coalesce(*[get(m, s) for s in (target, *sources)]))(fields)
        return F.map_filter(found, lambda k, _: ~k.isin(*[s for s in sources if s != target]))

    return step


def move_path(source: str, parent: str, name: str) -> Step:
    """Move a field into a nested object, creating it when absent."""

    def step(fields: Column) -> Column:
        value = get(fields, source)
        inside = F.coalesce(as_fields(get(fields, parent)), F.create_map().cast("map<string,variant>"))
        moved = variant(F.map_concat(F.map_filter(inside, lambda k, _: k != name), F.create_map(F.lit(name), value)))
        return F.when(value.isNull(), fields).otherwise(
            drop_path(source)(put(parent, lambda _: moved)(fields))
        )

    return step


def compose_term(
    target: str, node_from: Sequence[str], name_from: Sequence[str], node: Callable[[Column], Column] | None = None
) -> Step:
    """Collapse two coordinated texts into a term; a missing input gives an empty part.

    Objects that hold the target already keep it.
    """

    def step(fields: Column) -> Column:
        node_text = node(fields) if node else F.coalesce(*[text(fields, n) for n in node_from], F.lit(""))
        name_text = F.coalesce(*[text(fields, n) for n in name_from], F.lit(""))
        term = variant(F.struct(node_text.alias("node"), name_text.alias("name")))
        built = put(target, lambda _: F.coalesce(get(fields, target), term))(fields)
        gone = [n for n in (*node_from, *name_from) if n != target]
        return F.map_filter(built, lambda k, _: ~k.isin(*gone))

    return step


def unwrap_singleton(*names: str) -> Step:
    """``[x]`` becomes ``x``; arrays of another size stay (see :func:`not_singleton`)."""

    def step(fields: Column) -> Column:
        def one(k: Column, v: Column) -> Column:
            items = F.try_variant_get(v, "$", "array<variant>")
            return F.when(k.isin(*names) & (F.size(items) == 1), F.get(items, F.lit(0))).otherwise(v)

        return F.transform_values(fields, one)

    return step


def not_singleton(value: Column) -> Column:
    """True for an array that cannot be unwrapped."""
    return F.coalesce(F.size(F.try_variant_get(value, "$", "array<variant>")) != 1, F.lit(False))


def wrap_scalar(*names: str) -> Step:
    """A lone value becomes a one-element array."""

    def step(fields: Column) -> Column:
        return F.transform_values(
            fields,
            lambda k, v: F.when(
                k.isin(*names) & ~F.is_variant_null(v) & F.try_variant_get(v, "$", "array<variant>").isNull(),
                variant(F.array(v)),
            ).otherwise(v),
        )

    return step


def cast_flag(*names: str) -> Step:
    """0 / 1 becomes false / true; other values stay."""

    def step(fields: Column) -> Column:
        def one(k: Column, v: Column) -> Column:
            number = F.when(F.schema_of_variant(v) != "BOOLEAN", F.try_variant_get(v, "$", "double"))
            return F.when(k.isin(*names) & number.isin(0.0, 1.0), scalar_variant(number == 1.0)).otherwise(v)

        return F.transform_values(fields, one)

    return step


def lower_values(*names: str) -> Step:
    def step(fields: Column) -> Column:
        return F.transform_values(
            fields,
            lambda k, v: F.when(
                k.isin(*names) & (F.schema_of_variant(v) == "STRING"),
                scalar_variant(F.lower(F.try_variant_get(v, "$", "string"))),
            ).otherwise(v),
        )

    return step


def regroup_prefixed(prefix: str, variants: Sequence[str], *inner: Step) -> Step:
    """``<prefix>_<VARIANT>_<metric>`` siblings become one object ``<prefix>_<variant>`` each."""

    def group(fields: Column, tag: str) -> Column:
        start = f"{prefix}_{tag}_"
        mine = F.map_filter(fields, lambda k, _: k.startswith(start))
        named = F.transform_keys(mine, lambda k, _: F.substr(k, F.lit(len(start) + 1)))
        return F.when(F.size(mine) > 0, variant(edit(named, *inner)))

    def step(fields: Column) -> Column:
        pattern = rf"^{prefix}_({'|'.join(variants)})_"
        out = F.map_filter(fields, lambda k, _: ~k.rlike(pattern))
        for tag in variants:
            out = put(f"{prefix}_{tag}".lower(), _always(group(fields, tag)))(out)
        return out

    return step


def split_zip(target: str, names: str, rows: str, columns: Sequence[str]) -> Step:
    """A comma list and an N x k matrix, zipped row-wise into an array of records.

    The sources go only where they were zipped: lists of unequal length, or a table that
    can't be read, stay as they are (see :func:`not_zippable`).
    """

    def step(fields: Column) -> Column:
        labels = split_list(text(fields, names))
        place = VariantPlace(get(fields, rows))
        table = F.coalesce(place.matrix(), F.when(place.vector().isNotNull(), F.array(place.vector())))
        records = F.transform(
            F.arrays_zip(labels.alias("label"), table.alias("row")),
            lambda p: F.struct(
                p["label"].alias("name"), *[F.get(p["row"], F.lit(i)).alias(c) for i, c in enumerate(columns)]
            ),
        )
        fits = F.coalesce(F.size(labels) == F.size(table), F.lit(False))
        built = put(target, lambda _: F.coalesce(get(fields, target), F.when(fits, variant(records))))(fields)
        return F.map_filter(built, lambda k, _: ~(k.isin(names, rows) & fits))

    return step


def not_zippable(names: str, rows: str) -> Callable[[Column], Column]:
    """Test on an object: it has a source of :func:`split_zip` that can't be zipped."""

    def test(value: Column) -> Column:
        fields = as_fields(value)
        labels = split_list(text(fields, names))
        place = VariantPlace(get(fields, rows))
        table = F.coalesce(place.matrix(), F.when(place.vector().isNotNull(), F.array(place.vector())))
        has = get(fields, names).isNotNull() | get(fields, rows).isNotNull()
        return F.coalesce(has, F.lit(False)) & ~F.coalesce(F.size(labels) == F.size(table), F.lit(False))

    return test


def empty_matrix(*names: str) -> Step:
    """The placeholder ``{}`` of a matrix becomes an empty matrix."""

    def step(fields: Column) -> Column:
        return F.transform_values(
            fields,
            lambda k, v: F.when(k.isin(*names) & (F.schema_of_variant(v) == "OBJECT<>"), F.parse_json(F.lit("[]"))).otherwise(v),
        )

    return step


def zero_to_text(*names: str) -> Step:
    """The placeholder 0 of a text becomes an empty text; other values stay."""

    def step(fields: Column) -> Column:
        def one(k: Column, v: Column) -> Column:
            number = F.when(~F.schema_of_variant(v).isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$", "double"))
            return F.when(k.isin(*names) & F.coalesce(number == 0, F.lit(False)), scalar_variant(F.lit(""))).otherwise(v)

        return F.transform_values(fields, one)

    return step


def parse_json_text(*names: str) -> Step:
    """Text that holds JSON becomes the value it holds; other text stays."""

    def step(fields: Column) -> Column:
        return F.transform_values(
            fields,
            lambda k, v: F.when(
                k.isin(*names), F.coalesce(F.try_parse_json(F.try_variant_get(v, "$", "string")), v)
            ).otherwise(v),
        )

    return step


def join_list(*names: str) -> Step:
    """An array of texts (or JSON text of one) becomes a comma list."""

    def step(fields: Column) -> Column:
        def one(k: Column, v: Column) -> Column:
            direct = F.try_variant_get(v, "$", "array<string>")
            parsed = F.try_variant_get(F.try_parse_json(F.try_variant_get(v, "$", "string")), "$", "array<string>")
            items = F.coalesce(direct, parsed)
            return F.when(k.isin(*names) & items.isNotNull(), scalar_variant(F.array_join(items, ","))).otherwise(v)

        return F.transform_values(fields, one)

    return step
