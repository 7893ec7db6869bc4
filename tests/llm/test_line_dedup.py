"""Lines held by other documents, against a plain pass over all lines."""

import random

from awkward import none, odd, rows as odd_rows  # noqa: F401
from pyspark.sql import functions as F

from docquarry.llm import line_dedup
from docquarry.llm.line_dedup import drop_repeated_lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    def key(line):
        return line.strip(WHITE).translate(LOWER)

    last = (1, 0)
    order = lambda i: last if i is None else (0, i)
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), last), order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), order(i)) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(docs):
    return sorted((tuple(r) for r in drop_repeated_lines(docs).collect()), key=str)


SHARED = "A line that many documents hold, Été İ"


def texts():
    pick = random.Random(5)
    pool = [f"shared line number {i}" for i in range(20)] + ["short", "", "nine char", "ten chars!"]
    for i in range(60):
        lines = [pick.choice(pool) if pick.random() < 0.5 else f"own {i} {j} of {pick.random()}" for j in range(pick.randrange(1, 200))]
        if i % 3 == 0:
            lines.insert(pick.randrange(len(lines)), "  " + (SHARED.upper() if i % 2 else SHARED) + "\t\r")
        yield i, "\n".join(lines)
    yield 60, None
    yield 61, ""
    yield 62, "\n\n\n"
    yield 63, "\n".join(f"long {i % 70_000} line" for i in range(150_000))
    yield 64, "long 69999 line\nlong 1 line"
    yield 65, "long 69999 line\n" * 130 + "its own last line"
    yield 5, "shared line number 1\nanother text under one id"
    yield None, "shared line number 2\nnobody's own line"
    yield None, "shared line number 3\nnobody's own line"
    yield None, "shared line number 3\nnobody's own line"


def test_against_brute_force(spark):
    rows = list(texts())
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_frequent_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_HOT", 1)
    monkeypatch.setattr(line_dedup, "SHARE", 1)
    rows = [r for r in texts() if r[0] != 63]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lines = line_dedup._keys(docs, "doc_id", "text")
    assert line_dedup._frequent(lines).where("salts > 1").count() > 0
    assert run(docs) == brute(rows)


def test_awkward_rows(odd, none):
    assert run(odd) == brute([(r[0], r[1]) for r in odd_rows()])
    assert drop_repeated_lines(none).collect() == []


def test_keys_of_text(spark):
    docs = spark.createDataFrame([("b", SHARED), ("a", " " + SHARED[:-1].swapcase() + "İ ")], "doc_id string, text string")
    docs = docs.withColumn("mark", F.lit(1)).withColumn("Keep", F.lit("x"))
    assert sorted(r["n_dropped"] for r in drop_repeated_lines(docs).collect()) == [0, 0]
    docs = docs.withColumn("text", F.translate("text", "Ééİ", "xxx"))
    assert {r["doc_id"]: (r["n_dropped"], r["kept_text"]) for r in drop_repeated_lines(docs).collect()}["b"] == (1, "")


def test_plan_has_no_python(spark, odd):
    plan = drop_repeated_lines(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
