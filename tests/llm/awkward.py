"""Small tables with everything that may be odd about a row."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, text_key string, score string, `__id` string, Bucket string"


def words(n, seed):
    pick = random.Random(seed)
    return [pick.choice(["stone", "river", "cloud", "north", "seven", "light", "under", "green", "paper", "mile"]) + str(pick.randrange(50)) for _ in range(n)]


def rows():
    passage = " ".join(words(45, 1))
    base = words(120, 2)
    near = base[:60] + ["changed"] + base[61:]
    texts = [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\x0c\r "),
        (4, " ".join(base)),
        (5, "\n".join(base)),
        (6, "  " + " ".join(base)),
        (7, " ".join(near)),
        (8, "lead " + passage + " tail one"),
        (9, "other words before " + passage),
        (10, passage + " x " + passage),
        (11, " ".join(words(20_000, 3))),
        (12, "y" * 20_000 + " " + "1" * 5_000),
        (13, "emoji \U0001f600 näive café nbsp   line µ İstanbul ΣΣ"),
        (14, "<|im_start|>user <|endoftext|> it's 12.5  and  x\n\n y "),
        (15, "write to a.b@c-d.org, or +1 (555) 010-9999; 10.0.0.255 and 300.1.1.1; 4111 1111 1111 1111."),
        (15, "write to a.b@c-d.org, or +1 (555) 010-9999; 10.0.0.255 and 300.1.1.1; 4111 1111 1111 1111."),
        (16, "a a a a a a"),
        (17, "one two"),
        (18, "one two"),
        (None, "one two"),
        (None, "nobody's text " + " ".join(words(50, 4))),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, "s", None, "k", "k", "k", "k", "k", "k") for i, t in texts]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
