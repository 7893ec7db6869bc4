"""Dependencies, directory trees, quantities, manifests and skew, against plain Python on small fixtures."""

import json
from decimal import Decimal

import pytest
from conftest import wire
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.fixed_values import CANONICAL_FIELD, UNITS
from docquarry.functions import quantities as q
from docquarry.functions import scalars as sc
from docquarry.functions import terms as tm
from docquarry.operators import directories as d
from docquarry.operators import edges as e
from docquarry.sources import tables as t
from docquarry.sources.documents import read_documents, read_manifests, write_corpus


def directory(name, role, parent, id):  # noqa: A002
    deps = [{"name": "parent_doc_id", "document_id": "A"}, {"name": "parent_directory_id", "document_id": parent}]
    return wire("directory", {"directory": {"dirname": name, "directory_role": role, "num_entries": 1}}, depends_on=deps, id=id)


@pytest.fixture(scope="module")
def tree(documents):
    """Owner A with directories B, C and D nested in B."""
    docs = documents(
        directory("raw_data", "raw_data", "", "B"),
        directory("analysis_output", "analysis_output", "", "C"),
        directory("metadata", "", "B", "D"),
        directory("lost", "", "E", "F"),
        directory("loop", "", "G", "G"),
    )
    block = "struct<dirname:string,directory_role:string,num_entries:bigint>"
    return docs.withColumn("directory", F.try_variant_get("body", "$.directory", block)).cache()


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_named_directory_queries(tree):
    assert ids(d.directories_of(tree, "A")) == ["B", "C", "D", "F", "G"]
    assert ids(d.children_of(tree, "B")) == ["D"]
    assert ids(d.top_level_directories(tree, "A")) == ["B", "C"]
    assert ids(d.slot(tree, role="raw_data")) == ["B"]


def test_directory_paths(tree):
    rows = d.directory_tree(d.directory_edges(tree)).collect()
    assert sorted((r["id"], r["path"], r["depth"]) for r in rows) == [
        ("B", "raw_data", 0),
        ("C", "analysis_output", 0),
        ("D", "raw_data/metadata", 1),
    ]
    # a repeated id that stands below itself is placed once
    edges = d.directory_edges(tree).select("id", "dirname", "owner_id", "parent_id")
    again = edges.where("id = 'D'").withColumn("id", F.lit("B")).withColumn("parent_id", F.lit("D"))
    assert d.directory_tree(edges.unionByName(again)).count() == 3


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    deep = [(f"c{i}", f"n{i}", "o", f"c{i - 1}" if i else "") for i in range(700)]
    other = [("x", "x", "o", "y"), ("y", "y", "o", "x"), ("z", "z", "o", "y"), ("lost", "l", "o", "nowhere"), ("w", "w", "p", "c2")]
    rounds = []
    plain = d.cut_lineage
    monkeypatch.setattr(d, "cut_lineage", lambda df, purpose: rounds.append(purpose) or plain(df, purpose))
    edges = spark.createDataFrame(deep + other, "id string, dirname string, owner_id string, parent_id string")
    rows = {r["id"]: (r["owner_id"], r["path"], r["depth"]) for r in d.directory_tree(edges).collect()}
    assert rows.keys() == {i for i, *_ in deep} | {"w"}
    assert rows["c699"] == ("o", "/".join(f"n{i}" for i in range(700)), 699) and rows["w"] == ("p", "n0/n1/n2/w", 3)
    assert len(rounds) <= 12  # log2(700) and the first and last


def test_directories_of_an_open_corpus(tree):
    opened = d.directory_edges(tree.drop("directory")).collect()
    assert sorted(opened) == sorted(d.directory_edges(tree).collect()) and all(r["dirname"] for r in opened)


def test_walk_does_not_grow_with_its_steps(spark):
    docs = t.orders(spark, "/root/testdata/sf0.001")

    def joins(steps):
        return e.walk(docs, *[(docs, "customer_id")] * steps)._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    assert joins(2) == joins(5) <= 2


def test_csv_columns_go_by_name(spark):
    rows = spark.createDataFrame(
        [("1", "a,b\n1,x\n"), ("2", "b,a\ny,2"), ("3", "b,other\ny,2"), ("4", ""), ("5", None), ("6", "b\nz")], "id string, csv string"
    )
    from docquarry.operators.structure import explode_inline_csv

    got = sorted((tuple(r) for r in explode_inline_csv(rows, "csv", "a double, b string").collect()), key=str)
    assert got == [("1", 1.0, "x"), ("2", 2.0, "y"), ("6", None, "z")]


def test_promoted_column_answers_for_its_type_only(spark, documents, tmp_path):
    from docquarry.plans.query import Q, find

    docs = documents(*[wire("base", {"party": {"acctbal": v}}, id=f"{i:033d}") for i, v in enumerate([9000, "9000", 9000.5, True, None])])
    path = str(tmp_path / "promoted")
    write_corpus(docs, path, promote={"balance": ("party.acctbal", "double")})
    stored = spark.read.parquet(path)
    for query in (Q("party.acctbal", "greaterthan", 5000), Q("party.acctbal", "exact_string", "9000"), Q("party.acctbal", "hasfield")):
        assert sorted(r.id for r in find(stored, query).collect()) == sorted(r.id for r in find(docs, query).collect())
    plan = find(stored, Q("party.acctbal", "greaterthan", 5000))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(balance,5000.0)" in plan


def test_manifest_file_stems(spark, tmp_path):
    (tmp_path / "B.jsonl").write_text('{"filename": "a.tif", "size": 1, "checksum_sha256": "x"}\n{"filename": "b.tif", "size": 2}\n')
    (tmp_path / "D.json").write_text('{"filename": "c.json", "size": 3, "checksum_sha256": "y"}\n')
    rows = read_manifests(spark, str(tmp_path)).collect()
    assert sorted((r["directory_id"], r["filename"], r["size"]) for r in rows) == [
        ("B", "a.tif", 1), ("B", "b.tif", 2), ("D", "c.json", 3),
    ]


def test_read_documents_from_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(wire(id="x"), indent=1))
    assert ids(read_documents(spark, str(tmp_path), multi_line=True)) == ["x"]


def test_follow_with_repeated_roles(documents):
    dep = lambda *targets: [{"name": "to", "document_id": x} for x in targets]
    docs = documents(
        wire(id="a"), wire(id="b"), wire(id="c", depends_on=dep("b", "a")), wire(id="d", depends_on=dep("b")),
        wire(id="e", depends_on=dep("a", "a")), wire(id="f", depends_on=dep("zz")),
    )
    found = docs.where("id = 'a'")
    assert ids(e.follow(docs, "to", found)) == ["c", "e"]
    assert ids(e.dangling_dependencies(docs)) == ["f"]
    assert ids(e.dangling_dependencies(docs.where("id <> 'a'"), docs.where("id = 'a'"))) == ["f"]


def test_hot_target(spark):
    """One referenced id holds a third of all edges; results stay whole."""
    docs = spark.range(6000).select(
        F.col("id").cast("string").alias("id"),
        t.entries(
            to=F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") + 5000).cast("string"))
        ).alias("depends_on"),
    )
    missing = e.dangling_dependencies(docs)
    expected = sum(1 for i in range(6000) if i % 3 == 0 or i + 5000 >= 6000)
    assert missing.count() == expected
    assert e.follow(docs, "to", spark.createDataFrame([("hot",)], "id string")).count() == 2000
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


VALUES = [0.0, 1.0, 1.5, 2.0, 3.0, 7.0, 12.0, 30.0, 250.0, 0.1, 1e-5, 123456.789, -4.2, 1e20]


def test_every_unit_is_exact(spark):
    for dimension, main in CANONICAL_FIELD.items():
        units = [u for u in UNITS if u[0] == dimension] + [(dimension, "cubit", None, None, None)]
        rows = [(u[1], x) for u in units for x in VALUES]
        df = spark.createDataFrame(rows, "unit string, value double")
        amount = q.quantity(F.col("value"), F.col("unit"), dimension)
        got = df.select("unit", "value", amount.alias("a")).collect()
        factors = {u[1]: u for u in units}
        for row in got:
            _, _, exponent, multiplier, approximate = factors[row["unit"]]
            if exponent is None:
                assert row["a"][main] is None and row["a"]["approximate"] is None
                continue
            exact = float(Decimal(repr(row["value"])).scaleb(exponent)) * multiplier
            assert row["a"][main] == exact, row
            assert row["a"]["approximate"] is approximate


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64), min_size=20, max_size=40))
def test_decimal_shift(spark, values):
    """The decimal text of the value is what gets shifted, with one rounding."""
    # Only normal doubles: the text of a subnormal has too few digits to be exact.
    values = [v for v in values if v == 0 or 1e-290 < abs(v) < 1e290]
    df = spark.createDataFrame([(v,) for v in values] or [(0.0,)], "v double")
    for k in (-9, -2, 3, 9):
        for row in df.select(
                F.col("v").cast("string").alias("text"), q.shift_decimal(F.col("v"), F.lit(k)).alias("s")
            ).collect():
                assert row["s"] == float(Decimal(row["text"]).scaleb(k))


def test_special_values_and_worked_quantities(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double")
    assert str(df.select(q.shift_decimal(F.col("v"), F.lit(3)).alias("s")).collect()) == "[Row(s=nan), Row(s=inf)]"
    row = spark.range(1).select(
        q.duration(F.lit(2), F.lit("day")).alias("days"),
        q.volume(F.lit(1.5), F.lit("nanoliter")).alias("drop"),
        q.frequency(F.lit(30000), F.lit("hertz")).alias("rate"),
        q.convert(q.duration(F.lit(2), F.lit("day")), "duration", F.lit("hour")).alias("hours"),
    ).first()
    assert row["days"]["seconds"] == 172800.0 and row["drop"]["liters"] == 1.5e-9
    assert row["rate"]["hertz"] == 30000.0 and row["hours"] == 48.0
    assert q.to_canonical_literal(1.5, "nanoliter", "volume") == 1.5e-9


def test_scalars(spark):
    inf, nan = float("inf"), float("nan")
    cases = [(1.0, 4.0, 2.0), (0.0, 4.0, inf), (-inf, 4.0, -inf), (2.0, inf, inf), (0.0, 0.0, nan), (2.0, 0.0, -inf)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a double, b double")
    got = [r[0] for r in df.select(sc.bandwidth_octaves(F.col("a"), F.col("b"))).collect()]
    assert str(got) == str([c for _, _, c in cases])
    row = spark.range(1).select(
        sc.split_list(F.lit("a, b ,c")).alias("l"),
        sc.split_list(F.lit("")).alias("none"),
        tm.lower_prefix(F.lit("UBERON:Ab:c")).alias("p"),
        tm.curie_local(F.lit("x:y:z")).alias("local"),
        tm.normalise_prefix(F.lit("Allen CCF v3")).alias("n"),
    ).first()
    assert row["l"] == ["a", "b", "c"] and row["none"] == []
    assert (row["p"], row["local"], row["n"]) == ("uberon:Ab:c", "y:z", "allen_ccf_v3")


def test_lists_of_blank_texts(spark, tmp_path):
    """A blank text has no element, which failed the whole query."""
    import duckdb

    from docquarry.gallery import QUERIES, SQL

    texts = ["a, b ,c", "", "   ", None, ",", " , ", "a,", "x", "\t"]
    rows = [(i, text, "en", "src1", len(text or "")) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["split_list"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(SQL["split_list"]).fetchall())
    by_id = {r[0]: r[1:] for r in got}
    ids = [r["id"] for r in docs.select("doc_id", t.uid("text_doc:", F.col("doc_id")).alias("id")).orderBy("doc_id").collect()]
    assert [by_id[i] for i in ids] == [
        (3, "c"), (1, ""), (1, ""), (None, None), (2, ""), (2, ""), (2, ""), (1, "x"), (1, "\t"),
    ]


# -- plans ------------------------------------------------------------------------------------
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_isa_prunes_partitions_and_promoted_fields_reach_the_scan(spark, tmp_path):
    from docquarry.plans.query import Q, find

    docs = t.opened(t.customers(spark, "/root/testdata/sf0.001")).unionByName(
        t.opened(t.orders(spark, "/root/testdata/sf0.001"))
    )
    path = str(tmp_path / "corpus")
    write_corpus(docs, path, promote={"acctbal": ("party.acctbal", "double")})
    stored = spark.read.parquet(path)
    query = Q("", "isa", "party") & Q("acctbal", "greaterthan", 0)
    text = plan(find(stored, query, t.CATALOG, snapshot_checked=True).select("id"))
    assert "PartitionFilters: [class_name" in text
    assert "GreaterThan(acctbal,0.0)" in text
    assert "body" not in text.split("ReadSchema")[1]


def test_no_python_and_no_pairs_in_plans(spark):
    from __spark_entry__ import queries

    for name in ("flagship", "nested_iteration", "validation_summary", "dangling_dependencies", "migrate_treatment", "quantity_mass"):
        text = plan(queries()[name](spark, "/root/testdata/sf0.001"))
        assert "PythonUDF" not in text and "ArrowEval" not in text, name
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_row_stored_array_plan(spark):
    """The line filter is pushed to the scan and rows collapse before they are shuffled."""
    from __spark_entry__ import queries

    text = plan(queries()["flagship"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThan(l_quantity,49.0)" in text
    assert text.count("HashAggregate") >= 2
