"""Printed before / after pairs and the properties of the dispatcher."""

import json

import pytest
from conftest import wire
from pyspark.sql import functions as F

from docquarry.gallery.conversions import TARGET
from docquarry.operators.migration import migrate

# Documents before and after migration as they are published.
PAIRS = [
    (
        "probe_location",
        {"probe_location": {"ontology_name": "uberon:0002436", "name": "primary visual cortex"}},
        "probe_location",
        {"probe_location": {"location": {"node": "uberon:0002436", "name": "primary visual cortex"}}},
    ),
    (
        "treatment",
        {
            "treatment": {
                "ontologyName": "chebi:6015",
                "name": "isoflurane",
                "numeric_value": [2.0],
                "string_value": "2 percent in O2",
            }
        },
        "treatment",
        {
            "treatment": {
                "treatment_name": {"node": "chebi:6015", "name": "isoflurane"},
                "numeric_value": [2.0],
                "string_value": "2 percent in O2",
            }
        },
    ),
    (
        "ontologyImage",
        {"ontologyImage": {"ontology_name": "allen_ccf_v3:12345", "ontology_region": "primary visual cortex"}},
        "ontology_image",
        {"ontology_image": {"region": {"node": "allen_ccf_v3:12345", "name": "primary visual cortex"}}},
    ),
    (
        "ontologyLabel",
        {"ontologyLabel": {"ontology_name": "Allen CCF v3", "label": "primary visual cortex", "label_id": 12345}},
        "ontology_label",
        {"ontology_label": {"term": {"node": "allen_ccf_v3:12345", "name": "primary visual cortex"}}},
    ),
    # rules given in words
    (
        "probe_location",
        {"probe_location": {}},
        "probe_location",
        {"probe_location": {"location": {"node": "", "name": ""}}},
    ),
    (
        "contrasttuning_calc",
        {
            "contrast_tuning": {
                "fit": {
                    "naka_rushton_RB_pref": [1.5],
                    "naka_rushton_RB_sensitivity": [0, 1],
                    "naka_rushton_RBNS_parameters": [7],
                    "other": 1,
                },
                "tuning_curve": {"contrast": 0, "mean": [1, 2]},
                "fitless": {"interpolated_c50": 0.5},
            },
            "contrasttuning_calc": {"depends_on": {"stimulus_tuningcurve_id": "x"}, "input_parameters": {"a": 1}},
            "app": {"name": "calc.contrast", "version": "2", "os": "x"},
        },
        "contrast_tuning_calc",
        {
            "contrast_tuning": {
                "fit": {
                    "naka_rushton_rb": {"pref": 1.5, "sensitivity": [0, 1]},
                    "naka_rushton_rbns": {"parameters": [7]},
                    "other": 1,
                },
                "tuning_curve": {"contrast": [0], "mean": [1, 2]},
                "fitless": {"interpolated_c50": 0.5},
            },
            "contrast_tuning_calc": {"input_parameters": {"a": 1}},
            "app": {"app_name": "calc.contrast", "app_version": "2", "os": "x"},
        },
    ),
    (
        "element_epoch",
        {"element_epoch": {"epoch_clock": "dev_local_time", "t0_t1": [0, 1]}},
        "element_epoch",
        {"element_epoch": {"clocks": [{"name": "dev_local_time", "t0": 0, "t1": 1}]}, "epochid": {}},
    ),
    (
        "stimulus_presentation",
        {"stimulus_presentation": {"stimuli": [{"parameters": {}}, {"parameters": {"M": 1}}], "presentation_order": 1}},
        "stimulus_presentation",
        {
            "stimulus_presentation": {"stimuli": [{"parameters": {}}, {"parameters": {"M": 1}}], "presentation_order": 1},
            "epochid": {},
            "app": {},
        },
    ),
]


@pytest.fixture(scope="module")
def migrated(documents):
    docs = [wire(name, blocks, depends_on=[{"name": "probe_id", "id": "p", "version": "3"}]) for name, blocks, _, _ in PAIRS]
    return migrate(documents(*docs), TARGET).cache()


def test_pairs(migrated):
    rows = migrated.select("class_name", "schema_version", F.to_json("body").alias("body"), "depends_on").collect()
    for (name, _, new_name, blocks), row in zip(PAIRS, rows):
        assert row["class_name"] == new_name
        assert row["schema_version"] == "V_delta"
        body = json.loads(row["body"])
        assert body.pop("base") == wire()["base"], name
        assert body == blocks, name
        assert [d.asDict() for d in row["depends_on"]] == [{"name": "probe_id", "document_id": "p"}]


def test_migrating_again_changes_nothing(migrated):
    again = migrate(migrated, TARGET, only=["ontology_label", "contrast_tuning", "element_epoch"])
    body = lambda df: [r[0] for r in df.select(F.to_json("body")).collect()]
    assert body(again) == body(migrated)
    assert {r[0] for r in again.select("migration_status").collect()} == {"current"}


def test_results_validate(documents):
    from docquarry.operators.validation import is_valid, validate

    docs = documents(*[wire(name, blocks) for name, blocks, _, _ in PAIRS[:4]])
    names = ["probe_location", "treatment", "ontology_image", "ontology_label"]
    checked = validate(migrate(docs, TARGET, only=names), TARGET, names)
    assert checked.where(~is_valid()).count() == 0


def test_flags_withdrawn_and_current(documents):
    docs = documents(
        wire("ontologyLabel", {"ontologyLabel": {"ontology_name": "A", "label": "b", "label_id": 0}}),
        wire("orientation_direction_tuning", {"orientation_direction_tuning": {"fit": {"direction_preferred_null_ratio": [1, 2]}}}),
        wire("animalsubject", {"animalsubject": {"a": 1}}),
    )
    rows = migrate(docs, TARGET, only=["ontology_label", "orientation_direction_tuning"]).select("migration_status", "migration_flags", F.to_json("body").alias("b")).collect()
    assert [r["migration_status"] for r in rows] == ["flagged", "flagged", "withdrawn"]
    assert rows[0]["migration_flags"] == ["label_id_missing:ontology_label.label_id"]
    assert json.loads(rows[0]["b"])["ontology_label"]["term"]["node"] == "a:0"
    # what cannot be unwrapped stays as it was
    assert json.loads(rows[1]["b"])["orientation_direction_tuning"]["fit"]["direction_preferred_null_ratio"] == [1, 2]
    assert json.loads(rows[2]["b"])["animalsubject"] == {"a": 1}


def test_flat_terms_can_be_kept(documents):
    block = {"probe_location": {"ontology_name": "UBERON:1", "name": "x"}}
    body = migrate(documents(wire("probe_location", block)), TARGET, collapse_ontology=False, only=["probe_location"]).select(F.to_json("body")).first()[0]
    assert json.loads(body)["probe_location"] == block["probe_location"]


def test_a_taken_name_wins(documents):
    block = {"hartley_reverse_correlation": {"frameTimes": [1], "frame_times": [2], "stimulus_properties": {"M": 1, "m": 2}}}
    body = migrate(documents(wire("hartley_calc", block)), TARGET, only=["hartley_reverse_correlation"]).select(F.to_json("body")).first()[0]
    assert json.loads(body)["hartley_reverse_correlation"] == {"frame_times": [2], "stimulus_properties": {"m": 2}}


def test_tasks_grow_in_number(spark, tmp_path):
    """A bound on stored bytes gives an input more tasks than cores; a small input keeps one a core."""
    from docquarry.session import spread

    spark.range(400000).selectExpr("id", "md5(cast(id as string)) AS s").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    parts = lambda df: df._jdf.queryExecution().toRdd().getNumPartitions()
    assert parts(spread(rows, 1 << 20)) > cores and parts(spread(rows, 1 << 40)) == cores
    assert spread(rows, 1 << 20).agg(F.count_distinct("id")).first()[0] == 400000


def test_a_csv_line_is_read_once(spark):
    from docquarry.operators.structure import csv_records

    plan = spark.range(1).select(csv_records(F.concat(F.lit("a,b\n1,x\n"), F.col("id").cast("string")), "a double, b string").alias("r"))
    assert plan._jdf.queryExecution().analyzed().toString().count("from_csv") == 1
    found = spark.createDataFrame([("b,a\nx,1\n\ny,2",), ("a,z\n1,2",), (None,), ("a\n3",)], "t string").select(csv_records(F.col("t"), "a double, b string").alias("r"))
    assert [[tuple(x) for x in r["r"]] for r in found.collect()] == [[(1.0, "x"), (2.0, "y")], [], [], [(3.0, None)]]
