import awkward
from conftest import SMALL

from awkward import none, odd  # noqa: F401
import corpus_pipeline as c
from docquarry.session import cut_lineage


def test_stages_on_shared_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first, sizes = docs, [docs.count()]
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, cut_lineage(stage(spark, docs, SMALL), "test")
        assert docs.dtypes == first.dtypes, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    packed = c.pack(spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_odd_and_no_rows(spark, odd, none):
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, odd, SMALL)
        assert out.dtypes == odd.dtypes, name
        out.count()
        assert stage(spark, none, SMALL).count() == 0
    exact = {r.text for r in c.drop_exact_copies(spark, odd, SMALL).collect()}
    assert len(exact) == len({"".join((t or "").split()) for _, t, *_ in awkward.rows()})
    near = c.drop_near_copies(spark, odd, SMALL)
    assert {7, 5, 6}.isdisjoint({r.doc_id for r in near.collect()}) and near.filter("doc_id = 4").count() == 1
    masked = c.mask_personal_data(spark, odd, SMALL).filter("doc_id = 15")
    assert {r.text for r in masked.collect()} == {"write to [email], or [phone]; [ip] and 300.1.1.1; [card]."}


def test_near_copies_under_null_and_repeated_ids(spark):
    base, other, third = (awkward.words(120, i) for i in (31, 32, 33))

    def near(text, i):
        return " ".join(text[:i] + ["changed"] + text[i + 1 :])

    rows = [
        (1, " ".join(base)),
        (None, near(base, 50)),  # goes; other texts without an id stay
        (None, "nobody's text " + " ".join(awkward.words(50, 34))),
        (5, near(base, 60)),  # goes; the other text of this id stays
        (5, "unlike " + " ".join(awkward.words(50, 35))),
        (7, near(other, 50)),  # one of two near copies with one id
        (7, near(other, 60)),
        (None, near(third, 50)),  # one of two without an id
        (None, near(third, 60)),
        (8, "twice the same " + " ".join(awkward.words(50, 36))),
        (8, "twice the same " + " ".join(awkward.words(50, 36))),
    ]
    out = [(r.doc_id, r.text) for r in c.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()]
    assert len(out) == len(set(out)) == 6 and set(out) <= set(rows)
    assert {rows[0], rows[2], rows[4], rows[9]} < set(out)
    assert len({rows[5], rows[6]} & set(out)) == len({rows[7], rows[8]} & set(out)) == 1
