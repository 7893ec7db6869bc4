"""Substring search by trigrams, against scans; stored bodies of which a scan reads one path."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators.text_index import TextIndex, grams, literal_grams, required_literals
from docquarry.plans.query import Q, find
from docquarry.sources import tables as t
from docquarry.sources.documents import read_corpus, write_corpus

TEXTS = ["the quick brown fox", "quick", "a\nb\nc d", "é😀ß quick 😀ß", "", None, "ab", "ababab", "THE QUICK", "q.u.i.c.k", "brown [x] (y)", "axxxb quuick"]


def test_grams(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "text string")
    for r in df.select("text", grams(df.text).alias("g")).collect():
        assert r.g is None if r.text is None else set(r.g) == literal_grams(r.text) and len(r.g) == len(set(r.g))


@pytest.mark.parametrize("pattern, literals", [
    ("quick", ["quick"]), ("qu+ick", ["ick"]), ("^the.*fox$", ["the", "fox"]), ("colou?rs", ["colo"]), ("a{2,3}bcd", ["bcd"]),
    ("x[abc]quick", ["quick"]), ("q\\.u\\.i", ["q.u.i"]), ("\\d+abc", []), ("(abc)?def", []), ("abc|def", []), ("abc*?def", ["def"]), ("[\\]x]abc", []),
])
def test_required_literals(pattern, literals):
    assert required_literals(pattern) == literals
    for text in filter(None, TEXTS):
        assert not re.search(pattern, text) or all(x in text for x in literals)


def test_search_against_scans(spark, tmp_path):
    rows = [(f"d{i}" if i % 4 else None, x) for i, x in enumerate(TEXTS * 2)] + [("d1", "another quick text"), ("d1", "x")]
    docs = spark.createDataFrame(rows, "id string, text string").select("id", F.struct("text", F.array(F.struct(F.col("text").alias("t")), F.struct(F.lit("zzz").alias("t"))).alias("list")).alias("doc"))
    for path in ("doc.text", "doc.list[*].t"):
        index = TextIndex(str(tmp_path / ("list" if "list" in path else "plain")), path, buckets=3)
        index.update(docs.where("id > 'd3'"), 0)
        index.update(docs.where("id > 'd3'").limit(1), 1)  # tried, and again
        index.update(docs.where("id is null or id <= 'd3'"), 1)
        for leaf in [Q(path, "contains_string", x) for x in ("quick", "😀ß", "ab", "bab", "nowhere", "\nb\n", "zzz")] + [
            Q(path, "regexp", "qu+ick"), Q(path, "regexp", "^the|x$"), Q(path, "exact_string", "quick")
        ]:
            key = lambda df: sorted((r["id"] or "", r["doc"]["text"] or "") for r in df.collect())
            assert key(index.search(docs, leaf, 2)) == key(find(docs, leaf)), leaf
        held = index.candidates(docs, Q(path, "contains_string", "quick"), 2).count()
        assert 0 < held < docs.count() and index.candidates(docs, Q(path, "contains_string", "ab"), 2) is None


def test_a_scan_reads_one_path_of_stored_bodies(spark, tmp_path):
    import pyarrow.parquet as pq

    write_corpus(t.opened(t.customers(spark, "/root/testdata/sf0.01")), str(tmp_path / "c"))
    hits = find(read_corpus(spark, str(tmp_path / "c")), Q("party.acctbal", "lessthan", -500)).select("id")
    assert hits.count() == find(t.customers(spark, "/root/testdata/sf0.01"), Q("party.acctbal", "lessthan", -500)).count()
    assert "body:struct<0:variant,1:double>" in hits._jdf.queryExecution().executedPlan().toString()
    read = whole = 0
    for name in glob.glob(str(tmp_path / "c" / "*" / "*.parquet")):
        group = pq.ParquetFile(name).metadata.row_group(0)
        columns = [group.column(i) for i in range(group.num_columns)]
        whole += sum(c.total_compressed_size for c in columns)
        read += sum(c.total_compressed_size for c in columns if c.path_in_schema == "body.metadata" or "party.typed_value.acctbal" in c.path_in_schema)
    assert 0 < read < whole / 8


def test_postings_are_lists(spark, tmp_path):
    """A row a gram and task with the hashes of its ids, not a row a gram and document."""
    docs = spark.range(200).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.struct(F.lit("the quick fox").alias("text")).alias("doc"))
    index = TextIndex(str(tmp_path / "lists"), "doc.text", buckets=2)
    index.update(docs.coalesce(4), 0)
    rows = index.postings.read(spark, 1)
    assert rows.where("gram = 'qui'").count() <= 4
    assert rows.where("gram = 'qui'").select(F.explode("ids")).distinct().count() == 200
    assert index.search(docs, Q("doc.text", "contains_string", "quick"), 1).count() == 200
