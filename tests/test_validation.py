"""Golden documents and single rules."""

import pytest
from conftest import wire
from pyspark.sql import functions as F

from docquarry.operators import validation as v
from docquarry.operators.reports import validation_summary
from docquarry.sources import tables as t
from docquarry.sources.catalog import Catalog

# A published class and document.
LOCATION = t.define(
    "probe_location",
    [t.define_field("location", "ontology_term")],
    depends_on=[t.define_dependency("probe_id")],
    version="2.0.0",
)
GOLDEN = Catalog.from_definitions([t.BASE, LOCATION])
GOOD_LOCATION = wire(
    "probe_location",
    {"probe_location": {"location": {"node": "uberon:0002436", "name": "primary visual cortex"}}},
    version="2.0.0",
    depends_on=[{"name": "probe_id", "value": "aabb1122ccdd3344_aabb1122ccdd3344"}],
)


def errors(df, catalog, **options):
    rows = v.validate(df, catalog, **options).select("errors").collect()
    return [[(e["rule"], e["field"]) for e in r["errors"]] for r in rows]


def test_golden_documents(documents):
    docs = documents(wire(), GOOD_LOCATION, wire(id=""), wire(datestamp="not-a-timestamp"))
    found = v.validate(docs, GOLDEN).select("errors").collect()
    assert found[0]["errors"] == [] and found[1]["errors"] == []
    [missing] = found[2]["errors"]
    assert missing["field"] == "id" and "non-empty" in missing["message"]
    [stamp] = found[3]["errors"]
    assert stamp["field"] == "datestamp"


def test_older_wire_shape(documents):
    """Underscored keys and ``classname`` read as the same document."""
    old = {
        "document_class": {"classname": "probe_location", "class_version": "1.0.0", "superclasses": [{"classname": "base", "class_version": "1.0.0"}]},
        "_depends_on": [{"_name": "probe_id", "value": "aabb1122ccdd3344_aabb1122ccdd3344"}],
        "base": wire()["base"],
        "probe_location": {"ontology_name": "uberon:0002436", "name": "primary visual cortex"},
    }
    older = t.define(
        "probe_location",
        [t.define_field("ontology_name", "char"), t.define_field("name", "char")],
        depends_on=[t.define_dependency("probe_id")],
    )
    assert errors(documents(old), Catalog.from_definitions([t.BASE, older])) == [[]]


DURATION = {"seconds": 172800.0, "approximate": False, "source_unit": "day", "source_value": 2.0}
CATALOG = Catalog.from_definitions(
    [
        t.BASE,
        t.define(
            "thing",
            [
                t.define_field("wait", "duration", mustBeNonEmpty=True, constraints={"minimum": 10, "allowed_units": ["day", "month", "second"]}),
                t.define_field("dose", "volume"),
                t.define_field("term", "ontology_term", mustBeNonEmpty=True, constraints={"allowed_namespaces": ["uberon", "placeholder"]}),
                t.define_field("count", "integer", constraints={"min": 1, "maximum": 9}),
                t.define_field("label", "char", constraints={"max_length": 5, "enum": ["abc", "abcde", "abcdef"]}),
                t.define_field("grid", "matrix", constraints={"shape": "Nx2", "min_value": 0, "element_type": "integer"}),
                t.define_field("map", "structure", fields=[], constraints={"value_type": "integer"}),
                t.define_field(
                    "clocks",
                    "structure",
                    mustBeScalar=False,
                    mustBeNonEmpty=True,
                    fields=[
                        t.define_field("name", "char", mustBeNonEmpty=True),
                        t.define_field("at", "structure", fields=[t.define_field("t0", "double", constraints={"minimum": 0})]),
                    ],
                ),
            ],
            depends_on=[t.define_dependency("rule_#", multiple=True)],
        ),
    ]
)
GOOD = {
    "wait": DURATION,
    "dose": {"liters": 1.5e-9, "approximate": False, "source_unit": "nanoliter", "source_value": 1.5},
    "term": {"node": "uberon:1", "name": "x"},
    "count": 5,
    "label": "abc",
    "grid": [[1, 2], [3, 4]],
    "map": {"a": 1},
    "clocks": [{"name": "utc", "at": {"t0": 0}}],
}
FAULTS = [
    ({}, []),
    ({"dose": {**GOOD["dose"], "liters": 1.5 * 1e-9}}, []),  # the plain product is accepted too
    ({"dose": {**GOOD["dose"], "liters": 1.4e-9}}, [("V16", "dose")]),
    ({"dose": {**GOOD["dose"], "source_unit": "pint"}}, [("V16", "dose")]),
    ({"dose": None}, []),
    ({"wait": {**DURATION, "approximate": True}}, [("V16", "wait")]),
    ({"wait": {"seconds": 2592000.0, "approximate": True, "source_unit": "month", "source_value": 1}}, []),
    ({"wait": {"seconds": 7200.0, "approximate": False, "source_unit": "hour", "source_value": 2}}, [("V17", "wait")]),
    ({"wait": {"seconds": 5.0, "approximate": False, "source_unit": "second", "source_value": 5}}, [("V18", "wait")]),
    ({"wait": {"seconds": 172800.0}}, [("V6", "wait"), ("V15", "wait")]),
    ({"wait": {**DURATION, "extra": 1}}, [("V15", "wait")]),
    ({"wait": None}, [("V6", "wait")]),
    ({"term": {"node": "", "name": ""}}, [("V6", "term"), ("V20", "term")]),
    ({"term": {"node": "uberon:1"}}, [("V19", "term")]),
    ({"term": {"node": "no curie", "name": ""}}, [("V20", "term")]),
    ({"term": {"node": "chebi:1", "name": ""}}, [("V21", "term")]),
    ({"term": {"node": "placeholder:1", "name": ""}}, [("V33", "term")]),
    ({"count": 0}, [("V12", "count")]),
    ({"count": 10}, [("V12", "count")]),
    ({"count": [5]}, [("V7", "count")]),
    ({"count": "5"}, []),
    ({"label": "abcdef"}, [("V11", "label")]),
    ({"label": "zzz"}, [("V13", "label")]),
    ({"grid": [[1, 2, 3]]}, [("V14", "grid")]),
    ({"grid": [[1, -2]]}, [("V14", "grid")]),
    ({"grid": [[1, 2.5]]}, [("V14", "grid")]),
    ({"map": {"a": 1.5}}, [("V28", "map")]),
    ({"map": {"a": "1"}}, [("V28", "map")]),
    ({"clocks": []}, [("V6", "clocks")]),
    ({"clocks": {"name": "utc"}}, [("V29", "clocks")]),
    ({"clocks": [{"name": "", "at": {"t0": 0}}]}, [("V29/V6", "clocks[*].name")]),
    ({"clocks": [{"name": "a", "at": {"t0": 1}}, {"name": "b", "at": {"t0": -1}}]}, [("V29/V12", "clocks[*].at.t0")]),
]


def test_single_faults(documents):
    docs = documents(*[wire("thing", {"thing": {**GOOD, **change}}) for change, _ in FAULTS])
    for (change, expected), found in zip(FAULTS, errors(docs, CATALOG)):
        assert found == expected, change


def test_missing_field_and_extras(documents):
    lacking = {k: x for k, x in GOOD.items() if k != "label"}
    found = errors(
        documents(
            wire("thing", {"thing": lacking}),
            wire("thing", {"thing": {**GOOD, "stray": 1}}),
            wire("thing", {"thing": GOOD, "stranger": {}}),
            wire("thing", {}),
            wire("nobody", {"nobody": {}}),
        ),
        CATALOG,
    )
    assert found[0] == [("V5", "label")]
    assert found[1] == [("V4", "")]
    assert found[2] == [("V1", "")]
    assert found[3][0] == ("V1", "") and ("V5", "wait") in found[3]
    assert found[4] == [("unknown_class", "class_name")]


def test_dependencies(documents):
    found = errors(
        documents(
            wire("thing", {"thing": GOOD}, depends_on=[{"name": "rule_1", "document_id": "x"}]),
            wire("thing", {"thing": GOOD}, depends_on=[{"name": "rule_2", "document_id": ""}]),
        ),
        CATALOG,
    )
    assert found == [[], [("V22", "rule_#")]]


def test_calendar_warning_does_not_reject(documents):
    checked = v.validate(documents(wire(datestamp="2024-02-30T00:00:00Z"), wire(id="short")), GOLDEN)
    good, bad = v.split_valid(checked)
    assert [e["severity"] for e in good.first()["errors"]] == ["warning"]
    assert good.count() == 1 and bad.count() == 1


def test_accept_and_reject_cover_everything(documents):
    """Blank, missing and repeated ids do not lose rows."""
    no_id = wire()
    del no_id["base"]["id"]
    docs = documents(wire(), wire(), wire(id=""), wire(id=""), no_id)
    good, bad = v.split_valid(v.validate(docs, GOLDEN))
    assert (good.count(), bad.count()) == (2, 3)


def test_summary_counts_documents_once(documents):
    two = [{"name": "", "at": {"t0": -1}}, {"name": "", "at": {"t0": -2}}]
    docs = documents(wire("thing", {"thing": {**GOOD, "clocks": two}}), wire("thing", {"thing": {**GOOD, "clocks": two}}))
    rows = {r["rule"]: (r["n_errors"], r["n_documents"]) for r in validation_summary(v.validate(docs, CATALOG)).collect()}
    assert rows == {"V29/V6": (2, 2), "V29/V12": (2, 2)}


def test_catalog_chain_rules():
    catalog = Catalog.from_definitions(
        [
            t.BASE,
            t.define("app"),
            t.define("calc", [t.define_field("input", "structure", placement="concrete_class", fields=[])], parents=("base", "app"), abstract=True),
            t.define("deep", parents=("calc", "lost")),
            t.define("loop_a", parents=("loop_b",)),
            t.define("loop_b", parents=("loop_a",)),
        ]
    )
    assert catalog.lineage("deep") == ("base", "app", "calc", "deep")
    assert catalog.unresolved("deep") == ("lost",)
    assert catalog.blocks("deep") == ["base", "app", "deep"]
    assert [(b, f.name) for b, f in catalog.placed_fields("deep")][-1] == ("deep", "input")
    assert catalog.lineage("loop_a") == ("loop_b", "loop_a")
    assert catalog.descendants("app") == {"app", "calc", "deep"}
    assert catalog.queryable("base.id") is True and catalog.queryable("no.thing") is None


def test_read_catalog(spark, tmp_path):
    import json

    from docquarry.sources.catalog import read_catalog

    (tmp_path / "stable").mkdir()
    (tmp_path / "stable" / "base.json").write_text(json.dumps(t.BASE))
    (tmp_path / "probe_location.json").write_text(json.dumps(LOCATION))
    (tmp_path / "old.json").write_text(
        json.dumps(
            {
                "_classname": "old",
                "_class_version": "1.0.0",
                "_superclasses": [{"_classname": "base"}],
                "_depends_on": [{"_name": "x", "_mustBeNonEmpty": True}],
                "_fields": [{"_name": "f", "type": "char", "_queryable": True, "_constraints": {"maxLength": 3}}],
            }
        )
    )
    catalog = read_catalog(spark, str(tmp_path))
    assert sorted(catalog.classes) == ["base", "old", "probe_location"]
    assert catalog.lineage("old") == ("base", "old")
    assert catalog.classes["old"].fields[0].constraint("maxLength") == 3
    assert catalog.dependencies("old")[0].required
    assert catalog.classes_table(spark).count() == 3
    assert catalog.fields_table(spark).where("class_name = 'old'").count() == 5
    assert catalog.files_table(spark).count() == 0


@pytest.mark.parametrize("rule", ["V5"])
def test_typed_null_is_not_missing(spark, rule):
    docs = t.customers(spark, "/root/testdata/sf0.001").withColumn(
        "party", F.col("party").withField("acctbal", F.lit(None).cast("double"))
    )
    rules = {e["rule"] for r in v.validate(docs, t.CATALOG, ["customer"]).select("errors").collect() for e in r["errors"]}
    assert rule not in rules
