"""The query model's own examples, its two-valued logic and its properties."""

import json

import pytest
from conftest import wire
from pyspark.sql import functions as F

from docquarry.plans.query import ChildTable, Corpus, Q, all_, and_, find, none_, or_, quantity, query_from_struct
from docquarry.sources import tables as t

AXES = [{"name": "z", "unit": "second"}, {"name": "x", "unit": "micrometer"}]
THING = {
    "axes": AXES,
    "channels": [{"window": {"min": 250}}, {"window": {"min": 50}}],
    "multiscales": [{"datasets": [{"path": "1/a"}]}, {"datasets": [{"path": "2/b"}, {"path": "0/c"}]}],
    "sizes": [1, 2.5],
    "grid": [[1, 2], [3, 4]],
    "words": ["a", "b"],
    "text": "5",
    "number": 5,
    "flag": True,
    "nothing": None,
    "blank": "",
    "none": [],
    "shape": {},
    "lone": {"name": "z"},
    "wait": {"seconds": 172801.0, "approximate": False, "source_unit": "second", "source_value": 172801.0},
}

CASES = [
    (Q("thing.axes[*].unit", "exact_string", "micrometer"), True),
    (Q("thing.channels[*].window.min", "lessthan", 100), True),
    (Q("thing.channels[*].window.min", "lessthan", 50), False),
    (Q("thing.multiscales[*].datasets[*].path", "regexp", "^0/"), True),
    (Q("thing.multiscales[*].datasets[*].path", "regexp", "^3/"), False),
    # independent quantifiers: different elements may satisfy the two leaves
    (and_(Q("thing.axes[*].name", "exact_string", "z"), Q("thing.axes[*].unit", "exact_string", "micrometer")), True),
    (Q("thing.axes", "hasanysubfield_contains_string", "unit", "micro"), True),
    (Q("thing.axes", "~hasanysubfield_contains_string", "unit", "micro"), False),
    (Q("thing.wait.seconds", "greaterthan", 172800), True),
    (quantity("thing.wait", "greaterthan", 2, "day", "duration"), True),
    (Q("thing.sizes", "exact_number", [1, 2.5]), True),
    (Q("thing.sizes", "exact_number", [1]), False),
    (Q("thing.grid", "exact_number", [[1, 2], [3, 4]]), True),
    (Q("thing.grid", "exact_number", [[1, 2]]), False),
    (Q("thing.sizes", "hasmember", 2.5), True),
    (Q("thing.words", "hasmember", "b"), True),
    (Q("thing.words", "hasmember", 1), False),
    (Q("thing.number", "exact_number", 5), True),
    # a text that looks like a number is no number, and the other way round
    (Q("thing.text", "lessthan", 10), False),
    (Q("thing.text", "exact_number", 5), False),
    (Q("thing.number", "exact_string", "5"), False),
    (Q("thing.flag", "exact_number", 1), False),
    # presence: a null is there, an absent field is not
    (Q("thing.nothing", "hasfield"), True),
    (Q("thing.absent", "hasfield"), False),
    (Q("thing.axes[*].name", "hasfield"), True),
    (Q("thing.none[*].name", "hasfield"), False),
    # a lone object is no array
    (Q("thing.lone[*].name", "exact_string", "z"), False),
    # emptiness
    (Q("thing.blank", "is_empty"), True),
    (Q("thing.none", "is_empty"), True),
    (Q("thing.shape", "is_empty"), True),
    (Q("thing.nothing", "is_empty"), True),
    (Q("thing.absent", "is_empty"), True),
    (Q("thing.number", "is_empty"), False),
    (Q("thing.axes", "is_empty"), False),
    # whole-document predicates and aliases
    (Q("", "isa", "thing"), True),
    (Q("", "isa", "base"), True),
    (Q("", "~isa", "other"), True),
    (Q("", "depends_on", "probe_id", "p1"), True),
    (Q("", "depends_on", "probe_id", "p2"), False),
    (Q("id", "exact_string", "d1"), True),
    (Q("base.id", "exact_string", "d1"), True),
    (Q("base.name", "contains_string", "test"), True),
    (all_(), True),
    (none_(), False),
]
ABSENT = [
    Q("thing.absent", "exact_string", "x"),
    Q("thing.none[*].name", "exact_string", "x"),
    Q("thing.nothing", "contains_string", "x"),
    Q("thing.text", "greaterthan", 0),
    Q("thing.axes[*].nope", "regexp", "."),
    Q("nowhere.at.all", "hasmember", 1),
]


@pytest.fixture(scope="module")
def thing(documents):
    return documents(
        wire("thing", {"thing": THING}, id="d1", depends_on=[{"name": "probe_id", "document_id": "p1"}])
    ).cache()


def _typed(thing):
    """The same document with its block as a Catalyst struct."""
    spark = thing.sparkSession
    block = spark.read.json(spark.createDataFrame([(json.dumps(THING),)], "v string").rdd.map(lambda r: r["v"]))
    return thing.drop("body").crossJoin(block.select(F.struct(*block.columns).alias("thing")))


@pytest.mark.parametrize("tree,expected", CASES)
def test_open_layout(thing, tree, expected):
    assert (find(thing, tree).count() == 1) is expected
    if isinstance(tree, Q):
        assert (find(thing, ~tree).count() == 1) is not expected


@pytest.mark.parametrize("tree,expected", [c for c in CASES if "nothing" not in str(c[0]) and "shape" not in str(c[0])])
def test_typed_layout(thing, tree, expected):
    assert (find(_typed(thing), tree).count() == 1) is expected


@pytest.mark.parametrize("leaf", ABSENT)
def test_unknown_is_false_before_negation(thing, leaf):
    assert find(thing, leaf).count() == 0
    assert find(thing, ~leaf).count() == 1
    assert find(_typed(thing), leaf).count() == 0
    assert find(_typed(thing), ~leaf).count() == 1


def test_nan_matches_no_comparison(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double").select(F.struct("x").alias("b"))
    for op in ("lessthan", "lessthaneq", "greaterthan", "greaterthaneq", "exact_number"):
        assert find(df, Q("b.x", op, 1.0)).count() == (1 if op.endswith("eq") or op == "exact_number" else 0)
    assert find(df, Q("b.x", "exact_number", float("nan"))).count() == 0


def test_struct_literals(thing):
    tree = [
        {"field": "thing.number", "operation": "exact_number", "param1": 5},
        {
            "field": "",
            "operation": "or",
            "param1": [{"field": "thing.text", "operation": "exact_string", "param1": "no"}],
            "param2": [{"field": "", "operation": "isa", "param1": "thing"}],
        },
    ]
    assert find(thing, tree).count() == 1
    assert query_from_struct(tree[0]) == Q("thing.number", "exact_number", 5)


def test_complement_and_de_morgan(spark):
    docs = t.order_corpus(spark, "/root/testdata/sf0.001")
    total = docs.documents.count()
    a = Q("order_doc.lines[*].quantity", "greaterthan", 48)
    b = Q("order_doc.status", "exact_string", "F")
    for leaf in (a, b, Q("order_doc.lines", "hasfield"), Q("order_doc.none", "hasfield")):
        assert find(docs, leaf).count() + find(docs, ~leaf).count() == total
    both = find(docs, and_(a, b)).count()
    assert both + find(docs, or_(~a, ~b)).count() == total
    assert find(docs, a).count() + find(docs, b).count() - both == find(docs, or_(a, b)).count()


def test_row_stored_arrays_agree_with_nested_ones(spark):
    """One document owns a third of all rows; it is found the same way as in a nested layout."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("parent"), (F.col("id") % 97).alias("n")
    )
    docs = spark.range(60).select(F.struct(F.col("id").alias("key")).alias("d"))
    corpus = Corpus(docs, {"d.items": ChildTable(rows, "parent", "d.key")})
    lists = rows.groupBy("parent").agg(F.collect_list(F.struct("n")).alias("items"))
    nested = docs.join(lists, F.col("d.key") == F.col("parent"), "left").select(
        F.struct(F.col("d.key").alias("key"), "items").alias("d")
    )
    for tree in (
        Q("d.items[*].n", "greaterthan", 95),
        Q("d.items[*].n", "~exact_number", 3),
        Q("d.items", "hasfield"),
        Q("d.items", "is_empty"),
        and_(Q("d.items[*].n", "exact_number", 1), Q("d.items[*].n", "exact_number", 96)),
    ):
        keys = lambda df: sorted(r[0] for r in df.select("d.key").collect())
        assert keys(find(corpus, tree)) == keys(find(nested, tree)), tree


def test_queryable_guard(spark):
    docs = t.pages(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError, match="not queryable"):
        find(docs, Q("page.html", "contains_string", "x"), t.CATALOG, not_queryable="raise")
    with pytest.warns(UserWarning, match="not queryable"):
        find(docs, Q("page.html", "contains_string", "x"), t.CATALOG, not_queryable="warn")
    find(docs, Q("page.url", "contains_string", "x"), t.CATALOG, not_queryable="raise")


def test_unknown_operation_and_unit():
    with pytest.raises(ValueError):
        quantity("a.b", "lessthan", 1, "furlong", "length")


def test_bounds_of_elements_are_pushed_and_change_nothing(spark, documents, tmp_path):
    """Conditions on list elements reach the scan through stored bounds; the rows stay the same."""
    from conftest import wire
    from docquarry.plans.query import implied_bounds
    from docquarry.functions.values import DocumentLayout
    from docquarry.sources.documents import read_corpus, write_corpus

    lists = [[1, 5, 9], [], [2.5], ["b", 7, None], ["a", "z"], None, [[3]], "7", [{"x": 7}], [-1, "m"]]
    blocks = [{"thing": {"v": v, "axes": [{"unit": "mm", "n": i}, {"unit": None}], "deep": [{"w": [i, 2 * i]}, {}]}} for i, v in enumerate(lists)]
    docs = documents(*[wire("thing", b, id=f"d{i}") for i, b in enumerate(blocks)])
    paths = ["thing.v[*]", "thing.axes[*].unit", "thing.axes[*].n", "thing.deep[*].w[*]", "thing.none[*]"]
    write_corpus(docs, str(tmp_path / "c"), bounds=paths)
    stored = read_corpus(spark, str(tmp_path / "c"))
    leaves = [Q("thing.v[*]", op, x) for op in ("exact_number", "lessthan", "lessthaneq", "greaterthan", "greaterthaneq") for x in (-1, 2.5, 7, 9)]
    leaves += [Q("thing.v", "hasmember", x) for x in (7, 2.5, "a", "zz")] + [Q("thing.v[*]", "exact_string", "m")]
    leaves += [Q("thing.axes[*].n", "greaterthan", 7), Q("thing.axes[*].unit", "exact_string", "mm"), Q("thing.deep[*].w[*]", "exact_number", 16)]
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    for leaf in leaves:
        assert implied_bounds(DocumentLayout(stored.schema), leaf) is not None
        assert ids(find(stored, leaf)) == ids(find(docs, leaf)), leaf
        assert ids(find(stored, ~leaf)) == ids(find(docs, ~leaf)), leaf
    plan = find(stored, leaves[-3])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(thing__axes__n__greatest,7.0)" in plan
    assert implied_bounds(DocumentLayout(stored.schema), Q("thing.v[*]", "contains_string", "a")) is None
