"""Streams in several batches, with replays of the same ids."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.sources import keyed, tables as t
from docquarry.sources.keyed import KeyedTable
from docquarry.streaming import ingest

SCHEMA = "id string, datestamp timestamp, depends_on array<struct<name:string,document_id:string>>"


def _drop(spark, folder, name, rows):
    spark.createDataFrame(rows, "id string, stamp string, target string").coalesce(1).select(
        "id", F.to_timestamp("stamp").alias("datestamp"), t.entries(to=F.col("target")).alias("depends_on")
    ).write.parquet(f"{folder}/{name}")


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)


def _ids(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted(r["id"] for r in ingest.read_sink(spark, path, schema).collect())


def test_dedupe_and_collisions(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path)

    def go():
        ingest.stream_dedupe_ids(
            _stream(spark, source), f"{root}/sink", f"{root}/collisions", f"{root}/ledger", f"{root}/state", buckets=4
        ).awaitTermination()

    _drop(spark, source, "a", [("1", "2024-01-01 00:00:00", ""), ("1", "2024-01-01 00:00:00", ""), ("2", "2024-01-01 00:10:00", "")])
    go()
    assert _ids(spark, f"{root}/sink") == ["1", "2"]
    # the same document again: dropped; another one under a stored id: reported
    _drop(spark, source, "b", [("2", "2024-01-01 00:10:00", ""), ("3", "2024-01-05 00:00:00", "")])
    go()
    _drop(spark, source, "c", [("1", "2024-01-05 00:00:00", ""), ("4", "2024-01-05 01:00:00", "")])
    go()
    # an old document arrives late, and two different ones share a new id
    _drop(spark, source, "d", [("5", "2019-01-01 00:00:00", ""), ("6", "2024-01-01 00:00:00", "x"), ("6", "2024-01-01 00:00:00", "y"), (None, "2024-01-01 00:00:00", "")])
    go()
    sink, collisions = ([r["id"] for r in ingest.read_sink(spark, f"{root}/{x}", spark.createDataFrame([], SCHEMA).schema).collect()] for x in ("sink", "collisions"))
    assert sorted(sink, key=lambda i: (i is None, i)) == ["1", "2", "3", "4", "5", "6", None]
    assert sorted(collisions) == ["1", "6"]


def test_integrity_waits_for_the_parent(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path)
    stored = spark.createDataFrame([("old",)], "id string")

    def go():
        ingest.stream_integrity(
            _stream(spark, source), lambda: stored, f"{root}/sink", f"{root}/pending", f"{root}/state", buckets=4
        ).awaitTermination()

    now = "2024-01-01 00:00:00"
    _drop(spark, source, "a", [("1", now, "old"), ("2", now, "1"), ("3", now, "late"), ("4", now, "")])
    go()
    assert _ids(spark, f"{root}/sink") == ["1", "2", "4"]
    _drop(spark, source, "b", [("late", now, "")])
    go()
    assert _ids(spark, f"{root}/sink") == ["1", "2", "3", "4", "late"]


def _pending(spark, root):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted((r["id"] for r in ingest.read_pending(spark, f"{root}/pending", schema).collect()), key=lambda i: (i is None, i))


def _integrity(spark, tmp_path, batches, stored=("old",)):
    """Sink and pending ids after each batch of (id, target) pairs."""
    source, root, out = str(tmp_path / "in"), str(tmp_path), []
    known = spark.createDataFrame([(i,) for i in stored], "id string")
    for n, rows in enumerate(batches):
        _drop(spark, source, str(n), [(i, "2024-01-01 00:00:00", target) for i, target in rows])
        ingest.stream_integrity(
            _stream(spark, source), lambda: known, f"{root}/sink", f"{root}/pending", f"{root}/state", buckets=4
        ).awaitTermination()
        sink = [r["id"] for r in ingest.read_sink(spark, f"{root}/sink", spark.createDataFrame([], SCHEMA).schema).collect()]
        out.append((sorted(sink, key=lambda i: (i is None, i)), _pending(spark, root)))
    return out


def test_a_chain_waits_and_goes_in_as_a_whole(spark, tmp_path):
    steps = _integrity(spark, tmp_path, [
        [("a", "b"), ("b", "missing"), ("free", "old")],  # a refers to a batch-mate that itself waits
        [("c", "a"), ("x", "elsewhere")],
        [("missing", "deeper")],
        [("deeper", "")],
    ])
    assert steps[0] == (["free"], ["a", "b"])
    assert steps[1] == (["free"], ["a", "b", "c", "x"])
    assert steps[2] == (["free"], ["a", "b", "c", "missing", "x"])
    assert steps[3] == (["a", "b", "c", "deeper", "free", "missing"], ["x"])


def test_rings_null_ids_and_repeated_ids(spark, tmp_path):
    steps = _integrity(spark, tmp_path, [
        [("p", "q"), ("q", "p"), ("r", "s"), (None, "gone"), (None, "old"), ("twin", "gone"), ("twin", ""), ("child", "twin")],
        [("s", "r")],
        [("gone", "")],
    ])
    assert steps[0] == (["child", "p", "q", "twin", None], ["r", "twin", None])
    assert steps[1] == (["child", "p", "q", "r", "s", "twin", None], ["twin", None])
    assert steps[2] == (["child", "gone", "p", "q", "r", "s", "twin", "twin", None, None], [])


def test_acceptance_against_brute_force(spark):
    pick = random.Random(4)
    ids = [f"n{i}" for i in range(40)]
    nodes = [(f"r{i}", pick.choice(ids), pick.sample([*ids, "stored", "nowhere"], pick.choice([0, 1, 1, 2]))) for i in range(60)]
    blocked, before = set(), None
    while blocked != before:
        before = set(blocked)
        held = {i for r, i, _ in nodes if r not in blocked} | {"stored"}
        blocked |= {r for r, _, targets in nodes if not set(targets) <= held}
    frame = spark.createDataFrame(nodes, "row string, id string, targets array<string>")
    found = ingest.blocked_rows(frame, spark.createDataFrame([("stored",)], "id string"))
    assert sorted(r["row"] for r in found.collect()) == sorted(blocked) and blocked


def test_redelivery_from_another_file_is_dropped(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path)
    for name, rows in (("a", [("1", "2024-01-01 00:00:00", "")]), ("b", [("1", "2024-01-01 00:00:00", ""), ("2", "2024-01-01 00:00:00", "")])):
        _drop(spark, source, name, rows)
        stream = _stream(spark, source).withColumn("source_file", F.col("_metadata.file_path"))
        ingest.stream_dedupe_ids(stream, *(f"{root}/{x}" for x in ("sink", "collisions", "ledger", "state")), buckets=4).awaitTermination()
    assert _ids(spark, f"{root}/sink") == ["1", "2"] and _ids(spark, f"{root}/collisions") == []


@pytest.mark.parametrize("fan_out", [3, 16])
def test_keyed_table_against_plain_rows(spark, tmp_path, monkeypatch, fan_out):
    monkeypatch.setattr(keyed, "FAN_OUT", fan_out)
    table = KeyedTable(str(tmp_path / "t"), "k", "k string, n int", buckets=4)
    rows, pick = [], random.Random(fan_out)
    for batch in range(10):
        new = [(f"key{pick.randrange(60)}", batch * 100 + i) for i in range(20)] + [("hot", batch * 100 + i) for i in range(20, 60)] + [(None, batch)]
        frame = spark.createDataFrame(new, "k string, n int")
        if batch == 4:
            table.append(frame.limit(5), batch)  # a batch that failed half way and is replayed
        if batch != 7:  # a number that was left out
            table.append(frame, batch)
            rows += new
    keys = [f"key{i}" for i in range(0, 80, 3)] + ["hot", None, "never"]
    asked = spark.createDataFrame([(k,) for k in keys], "k string")
    order = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, table.lookup(asked, 10).collect()), key=order) == sorted((r for r in rows if r[0] and r[0] in keys), key=order)
    assert sorted(map(tuple, table.read(spark, 10).collect()), key=order) == sorted(rows, key=order)
    assert len(table.runs(spark, 10)) <= (10 if fan_out == 16 else 5)


def test_ledger_opens_only_files_that_may_hold_an_id(spark, tmp_path, monkeypatch):
    """What a batch of new ids reads doesn't grow with the ledger."""
    monkeypatch.setattr(keyed, "FAN_OUT", 4)
    table = KeyedTable(str(tmp_path / "t"), "id", "id string, content string", buckets=8)
    opened, kept = [], []
    for batch in range(18):
        new = spark.range(batch * 500, batch * 500 + 500).select(F.md5(F.col("id").cast("string")).alias("id"), F.lit("c").alias("content"))
        found = table.lookup(new.limit(20), batch)
        opened.append(len(found.inputFiles()) if batch else 0)
        assert found.count() == 0
        table.append(new, batch)
        kept.append(table.read(spark, batch + 1).count())
    assert kept[-1] == 18 * 500
    asked = spark.createDataFrame([(None,)], "id string").union(spark.range(3).select(F.md5(F.col("id").cast("string"))))
    assert table.lookup(asked, 18).count() == 3 and len(table.lookup(asked, 18).inputFiles()) <= 2 * 3
    assert sum(opened) < 18 * 3 and max(opened[10:]) <= max(opened[:6]) + 3


def test_short_ids_are_read_back(spark):
    usual = "4126919195e6b5af_40d651024919a2e4"
    ids = [usual, usual.upper(), usual + "\n", usual.replace("_", ""), "", "a", "\0", "é" * 8, "fifteen-letters", "x" * 16, None]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").select("id", ingest.short_id("id").alias("short"))
    got = rows.select("id", "short", ingest.full_id("short").alias("back")).collect()
    assert all(r["id"] == r["back"] for r in got)
    assert len({bytes(r["short"]) for r in got if r["id"] is not None}) == len(ids) - 1 and len(got[0]["short"]) == 16


def test_copies_and_collisions_of_documents_without_id(spark, tmp_path):
    source, root, now = str(tmp_path / "in"), str(tmp_path), "2024-01-01 00:00:00"
    _drop(spark, source, "a", [(None, now, "x"), ("", now, "x"), (None, now, "x"), ("k", now, "")] + [("k", now, "")] * 5)
    _drop(spark, source, "b", [("k", now, "other")])
    stream = _stream(spark, source)
    for _ in range(2):
        ingest.stream_dedupe_ids(stream, *(f"{root}/{x}" for x in ("sink", "collisions", "ledger", "state")), buckets=4).awaitTermination()
        _drop(spark, source, f"c{_}", [("k", now, ""), ("k", now, "other"), ("n", now, "")])
    read = lambda name: ingest.read_sink(spark, f"{root}/{name}", spark.createDataFrame([], SCHEMA).schema)
    assert sorted(r["id"] or "" for r in read("collisions").collect()) == ["", "k", "k"] and sorted(r["id"] or "" for r in read("sink").collect()) == ["", "k", "n"]
