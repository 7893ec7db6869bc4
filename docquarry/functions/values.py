"""Typed access to a place inside a document.

A *place* is either a Catalyst-typed column (nested struct, array or map) or a
path into a VARIANT.  Both answer the same questions (child, any element, text,
number, ...), so that predicates and rules are written once.  Every question
returns a Column, or None where the static type already rules a match out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def false_if_null(col: Column | None) -> Column:
    """Two-valued truth: unknown counts as false."""
    return F.lit(False) if col is None else F.coalesce(col, F.lit(False))


class TypedPlace:
    """A place whose type Catalyst knows."""

    def __init__(self, col: Column, dtype: T.DataType):
        self.col = col
        self.dtype = dtype

    def child(self, name: str):
        if isinstance(self.dtype, T.StructType):
            if name in self.dtype.fieldNames():
                return TypedPlace.of(self.col.getField(name), self.dtype[name].dataType)
            return None
        if isinstance(self.dtype, T.MapType) and isinstance(self.dtype.keyType, T.StringType):
            return TypedPlace.of(F.try_element_at(self.col, F.lit(name)), self.dtype.valueType)
        return None

    @staticmethod
    def of(col: Column, dtype: T.DataType):
        return VariantPlace(col) if isinstance(dtype, T.VariantType) else TypedPlace(col, dtype)

    def any_element(self, test: Callable) -> Column | None:
        if not isinstance(self.dtype, T.ArrayType):
            return None
        inner = self.dtype.elementType
        return F.exists(self.col, lambda x: false_if_null(test(TypedPlace.of(x, inner))))

    def text(self) -> Column | None:
        return self.col if isinstance(self.dtype, T.StringType) else None

    def number(self) -> Column | None:
        return self.col.cast("double") if isinstance(self.dtype, NUMERIC) else None

    def integral(self) -> bool:
        """Statically known to hold whole numbers, so bounds compare without a cast."""
        return isinstance(self.dtype, NUMERIC[:4])

    def flag(self) -> Column | None:
        return self.col if isinstance(self.dtype, T.BooleanType) else None

    def vector(self) -> Column | None:
        if isinstance(self.dtype, T.ArrayType) and isinstance(self.dtype.elementType, NUMERIC):
            return self.col.cast("array<double>")
        return None

    def matrix(self) -> Column | None:
        if isinstance(self.dtype, T.ArrayType) and isinstance(self.dtype.elementType, T.ArrayType):
            if isinstance(self.dtype.elementType.elementType, NUMERIC):
                return self.col.cast("array<array<double>>")
        return None

    def present(self) -> Column:
        return self.col.isNotNull()

    def is_null(self) -> Column:
        return self.col.isNull()

    def is_array(self) -> Column:
        return self.col.isNotNull() if isinstance(self.dtype, T.ArrayType) else F.lit(False)

    def is_object(self) -> Column:
        known = isinstance(self.dtype, (T.StructType, T.MapType))
        return self.col.isNotNull() if known else F.lit(False)

    def keys(self) -> Column | None:
        if isinstance(self.dtype, T.StructType):
            return F.array_compact(
                F.array(*[F.when(self.col.getField(n).isNotNull(), F.lit(n)) for n in self.dtype.fieldNames()])
            )
        if isinstance(self.dtype, T.MapType):
            return F.map_keys(self.col)
        return None

    def size(self) -> Column | None:
        if isinstance(self.dtype, (T.ArrayType, T.MapType)):
            return F.size(self.col)
        keys = self.keys()
        return None if keys is None else F.size(keys)

    def empty(self) -> Column:
        if isinstance(self.dtype, T.StringType):
            return self.col.isNull() | (self.col == "")
        size = self.size()
        return self.col.isNull() if size is None else self.col.isNull() | (size == 0)

    def value(self) -> Column:
        return self.col


class VariantPlace:
    """A path into a VARIANT column; the path is read only once per question."""

    def __init__(self, root: Column, path: str = "$"):
        self.root = root
        self.path = path

    def _get(self, as_type: str) -> Column:
        return F.try_variant_get(self.root, self.path, as_type)

    @property
    def col(self) -> Column:
        return self.root if self.path == "$" else self._get("variant")

    def _shape(self) -> Column:
        return F.schema_of_variant(self.col)

    def child(self, name: str):
        return VariantPlace(self.root, f'{self.path}["{name}"]')

    def any_element(self, test: Callable) -> Column:
        return F.exists(self._get("array<variant>"), lambda x: false_if_null(test(VariantPlace(x))))

    def text(self) -> Column:
        return F.when(self._shape() == "STRING", self._get("string"))

    def number(self) -> Column:
        shape = self._shape()
        return F.when(
            shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL"), self._get("double")
        )

    def integral(self) -> bool:
        return False

    def flag(self) -> Column:
        return F.when(self._shape() == "BOOLEAN", self._get("boolean"))

    def vector(self) -> Column:
        return F.when(
            self._shape().rlike(r"^ARRAY<(BIGINT|DOUBLE|FLOAT|VOID|DECIMAL\(\d+,\d+\))>$"),
            self._get("array<double>"),
        )

    def matrix(self) -> Column:
        return F.when(
            self._shape().rlike(r"^ARRAY<ARRAY<(BIGINT|DOUBLE|FLOAT|VOID|DECIMAL\(\d+,\d+\))>>$"),
            self._get("array<array<double>>"),
        )

    def present(self) -> Column:
        return self.col.isNotNull()

    def is_null(self) -> Column:
        return self.col.isNull() | F.is_variant_null(self.col)

    def is_array(self) -> Column:
        return false_if_null(self._shape().startswith("ARRAY"))

    def is_object(self) -> Column:
        return false_if_null(self._shape().startswith("OBJECT"))

    def keys(self) -> Column:
        return F.map_keys(self._get("map<string,variant>"))

    def size(self) -> Column:
        return F.coalesce(
            F.array_size(self._get("array<variant>")), F.size(F.map_keys(self._get("map<string,variant>")))
        )

    def empty(self) -> Column:
        return self.is_null() | F.coalesce(
            self._shape().isin("OBJECT<>", "ARRAY<VOID>") & (self.size() == 0), F.lit(False)
        ) | false_if_null(self.text() == "")

    def value(self) -> Column:
        return self.col


class PromotedPlace(VariantPlace):
    """A path into the body of which one type of value is also a column of its own."""

    def __init__(self, root: Column, path: str, column: TypedPlace):
        super().__init__(root, path)
        self.column = column

    def text(self) -> Column:
        found = self.column.text()
        return super().text() if found is None else found

    def number(self) -> Column:
        found = self.column.number()
        return super().number() if found is None else found

    def flag(self) -> Column:
        found = self.column.flag()
        return super().flag() if found is None else found


#: Column metadata: the document path that a promoted column was taken from.
PROMOTED = "promoted_from"

#: Column metadata: the ``[*]`` path whose values a column bounds, and which bound it is.
BOUNDS = "bounds_of"
BOUND_KIND = "bound"

Place = TypedPlace | VariantPlace


class DocumentLayout:
    """Finds the place a dot-path names, for the columns a corpus really has.

    A block stored as a typed column wins over the open ``body``; the four base
    fields always resolve to their header columns.
    """

    HEADER = {"id": "id", "session_id": "session_id", "name": "name", "datestamp": "datestamp_raw"}

    def __init__(self, schema: T.StructType, body: str = "body"):
        self.schema = schema
        self.body = body

    def _column(self, name: str):
        if name in self.schema.fieldNames():
            return TypedPlace.of(F.col(name), self.schema[name].dataType)
        return None

    def block(self, name: str):
        """The place of a class block (or of a row's own column)."""
        found = self._column(name)
        if found is not None:
            return found
        if self.body in self.schema.fieldNames():
            return VariantPlace(F.col(self.body)).child(name)
        return None

    def locate(self, segments: list[str]):
        """The place named by plain segments (no iteration), or None."""
        if segments[0] == "base" and len(segments) == 2 and segments[1] in self.HEADER:
            head = self._column(self.HEADER[segments[1]])
            if head is not None:
                return head
        if len(segments) == 1 and segments[0] in self.HEADER:
            head = self._column(self.HEADER[segments[0]])
            if head is not None:
                return head
        place = self.block(segments[0])
        for name in segments[1:]:
            if place is None:
                return None
            place = place.child(name)
        if isinstance(place, VariantPlace):
            for f in self.schema.fields:
                if f.metadata.get(PROMOTED) == ".".join(segments):
                    return PromotedPlace(place.root, place.path, TypedPlace(F.col(f.name), f.dataType))
        return place


def bound_columns(schema: T.StructType, path: str) -> dict[str, Column]:
    """The bounds (least, greatest, least_text, greatest_text) that a corpus keeps of a ``[*]`` path."""
    return {f.metadata[BOUND_KIND]: F.col(f"`{f.name}`") for f in schema.fields if f.metadata.get(BOUNDS) == path}


def elements_at(layout: DocumentLayout, path: str, ask: Callable[[Place], Column | None]) -> Column | None:
    """Array of what ``ask`` says of every place that a path with ``[*]`` names, or None."""

    def below(place: Place | None, segments: list[str]) -> Column | None:
        for i, segment in enumerate(segments):
            place = place if place is None else place.child(segment.removesuffix("[*]"))
            if place is None:
                return None
            if segment.endswith("[*]"):
                return each(place, segments[i + 1 :])
        found = ask(place)
        return None if found is None else F.array(found)

    def each(place: Place, rest: list[str]) -> Column | None:
        if isinstance(place, VariantPlace):
            items, inner = place._get("array<variant>"), VariantPlace
        elif isinstance(place.dtype, T.ArrayType):
            items, inner = place.col, lambda x: TypedPlace.of(x, place.dtype.elementType)
        else:
            return None
        found = None

        def one(x: Column) -> Column:
            nonlocal found
            found = below(inner(x), rest)
            return F.lit(None) if found is None else found

        parts = F.transform(items, one)
        return None if found is None else F.flatten(F.filter(parts, lambda p: p.isNotNull()))

    head, *rest = path.split(".")
    place = layout.block(head.removesuffix("[*]"))
    if place is None:
        return None
    return each(place, rest) if head.endswith("[*]") else below(place, rest)


def _at(df, path: str) -> Place | None:
    return DocumentLayout(df.schema).locate(path.split("."))


def text_at(df, path: str) -> Column:
    """Text at a dot-path of a typed or open corpus; NULL where absent or of another type."""
    place = _at(df, path)
    found = None if place is None else place.text()
    return F.lit(None).cast("string") if found is None else found


def number_at(df, path: str) -> Column:
    """Number at a dot-path of a typed or open corpus; NULL where absent or of another type."""
    place = _at(df, path)
    found = None if place is None else place.number()
    return F.lit(None).cast("double") if found is None else found
