"""References by target and integrity by changes, against scans and reports from scratch."""

import random
from collections import Counter

from docquarry.operators import edges as e
from docquarry.operators.references import IntegrityIndex, ReferenceIndex
from docquarry.sources import tables as t

SCHEMA = "id string, class_name string, lineage array<string>, depends_on array<struct<name:string,document_id:string>>"


def _document(pick, ids):
    kind = pick.choice(["order_doc", "order_doc", "customer", "supplier"])
    role = {"order_doc": "customer_id", "customer": "directory_id", "supplier": "other"}[kind]
    targets = [pick.choice([*ids, "nowhere", "", "hot", None]) for _ in range(pick.choice([0, 1, 1, 2]))]
    return (pick.choice([*ids, "hot", None]), kind, ["base", kind], [(role if n == 0 else "extra", x) for n, x in enumerate(targets)])


def _batches(seed, count=5):
    """(added, withdrawn) of each batch, and what is stored in the end."""
    pick, stored, out = random.Random(seed), [], []
    ids = [f"d{i}" for i in range(25)]
    for _ in range(count):
        gone = pick.sample(stored, min(len(stored), pick.randrange(0, 12)))
        new = [_document(pick, ids) for _ in range(pick.randrange(5, 25))]
        new += new[:2]  # the same document twice
        for d in gone:
            stored.remove(d)
        stored += new
        out.append((new, gone, list(stored)))
    return out


def test_incremental_report_equals_the_one_from_scratch(spark, tmp_path):
    index = IntegrityIndex(str(tmp_path / "index"), t.CATALOG, buckets=3)
    for batch, (new, gone, stored) in enumerate(_batches(3, count=3)):
        added, withdrawn = spark.createDataFrame(new, SCHEMA), spark.createDataFrame(gone, SCHEMA)
        if batch == 2:  # an attempt that failed and is made again
            index.update(added.limit(3), batch)
        index.update(added, batch, withdrawn)
        scratch = e.integrity_report(spark.createDataFrame(stored, SCHEMA), t.CATALOG)
        assert Counter(map(tuple, index.report(spark, batch + 1).collect())) == Counter(map(tuple, scratch.collect()))


def test_a_reference_to_a_hot_target_reads_no_other_reference(spark, tmp_path, monkeypatch):
    index = IntegrityIndex(str(tmp_path / "index"), t.CATALOG, buckets=4)
    hot = [("c", "customer", ["base", "customer"], [])]
    orders = [(f"o{i}", "order_doc", ["base", "order_doc"], [("customer_id", "c")]) for i in range(50)]
    index.update(spark.createDataFrame(hot + orders, SCHEMA), 0)
    read = []
    plain = ReferenceIndex.referring
    monkeypatch.setattr(ReferenceIndex, "referring", lambda self, ids, before, dep_name=None: read.append(plain(self, ids, before, dep_name).count()) or plain(self, ids, before, dep_name))
    index.update(spark.createDataFrame([("new", "order_doc", ["base", "order_doc"], [("customer_id", "c")])], SCHEMA), 1)
    index.update(spark.createDataFrame(hot, SCHEMA), 2)  # stored twice now, still a customer
    assert read == [0, 0]
    index.update(spark.createDataFrame([], SCHEMA), 3, withdrawn=spark.createDataFrame(hot * 2, SCHEMA))
    assert read == [0, 0, 51] and index.report(spark, 4).where("rule = 'dangling'").count() == 51


def test_reference_index_against_a_scan(spark, tmp_path):
    index, batches = ReferenceIndex(str(tmp_path / "index"), buckets=4), _batches(8)
    for batch, (new, gone, _) in enumerate(batches):
        index.update(spark.createDataFrame(new, SCHEMA), batch, spark.createDataFrame(gone, SCHEMA))
    stored, n = batches[-1][2], len(batches)
    corpus = spark.createDataFrame(stored, SCHEMA)
    for target in ("d3", "hot", "nowhere", "never", ""):
        want = {(i, c) for i, c, _, deps in stored for name, x in deps if name == "customer_id" and x == target and x}
        found = index.depends_on(spark, "customer_id", target, n)
        assert {tuple(r) for r in found.collect()} == want
        whole = ReferenceIndex.documents(corpus, found).select("id", "class_name").collect()
        assert {tuple(r) for r in whole} == {r for r in want if r[0] is not None}
    files = index.table.lookup(spark.createDataFrame([("hot",)], "target string"), n).inputFiles()
    assert len({f.split("bucket=")[1][0] for f in files if "bucket=" in f}) == 1
    some = spark.createDataFrame([("d1",), ("d2",), (None,)], "id string")
    want = {r["id"] for r in e.follow(corpus, "directory_id", some).collect()}
    assert {r["id"] for r in index.follow("directory_id", some, n).collect()} == want
