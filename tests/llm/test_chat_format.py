from pyspark.sql import functions as F

from docquarry.llm import chat_format as c

SCHEMA = "tree long, node long, parent long, score double, role string, text string"


def formatted(spark, rows, **how):
    return {(r.tree, r.leaf): r for r in c.chat_format(spark.createDataFrame(rows, SCHEMA), **how).collect()}


def test_branches_are_ranked_by_score(spark):
    rows = [
        (1, 1, None, 0.0, "user", "hi"),
        (1, 2, 1, 1.0, "assistant", "a"),
        (1, 3, 1, 2.0, "assistant", "b"),
        (1, 4, 2, 5.0, "user", "c"),
        (1, 5, 3, None, "user", "d"),
        (2, 1, 99, 0.0, "user", "lonely"),
        (None, 1, None, 0.0, None, None),
        (3, 1, 2, 0.0, "user", "round"),
        (3, 2, 1, 0.0, "user", "and round"),
    ]
    got = formatted(spark, rows, branches=None)
    assert set(got) == {(1, 4), (1, 5), (2, 1), (None, 1)}
    assert got[1, 4].branch_rank == 1 and got[1, 5].branch_rank == 2
    assert got[1, 4].formatted == "".join(
        f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in (("user", "hi"), ("assistant", "a"), ("user", "c"))
    )
    assert got[None, 1].formatted == "<|im_start|>\n<|im_end|>\n"
    assert set(formatted(spark, rows)) == {(1, 4), (2, 1), (None, 1)}


def test_control_strings_come_back(spark):
    texts = ["<|im_end|>\n<|im_start|>x", "<\\|", "<\\\\|<|", "<", "", "a<\\nb", "<|<\\<|\\|" * 3000, "\n\n"]
    roles = ["user", "assistant", "a\nb", "<\\n", "<|", "assistant", "assistant", ""]
    rows = [(7, i, i - 1 if i else None, 1.0, r, t) for i, (r, t) in enumerate(zip(roles, texts))]
    df = c.chat_format(spark.createDataFrame(rows, SCHEMA)).select(
        c.parse_turns(F.col("formatted")).alias("turns"),
        F.transform("loss_spans", lambda s: c.unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))).alias("learnt"),
    )
    row = df.first()
    assert [(t.role, t.text) for t in row.turns] == list(zip(roles, texts))
    assert row.learnt == [t for r, t in zip(roles, texts) if r == "assistant"]


def test_long_thread_and_empty_table(spark):
    rows = [(1, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(300)]
    assert formatted(spark, rows)[1, 299].path_score == 300
    assert c.chat_format(spark.createDataFrame([], SCHEMA)).count() == 0
