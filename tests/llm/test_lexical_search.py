"""Ranked search, against the formulas applied to every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from awkward import none, odd, rows as odd_rows  # noqa: F401

from docquarry.llm import lexical_search
from docquarry.llm.lexical_search import Block, length_norms, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, some in wanted.items():
        found = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m))
                for t in some if b[t]
            )
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0))
        out += [(item, r + 1, None if none_ else i, -s) for r, (s, none_, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def run(docs, items, k):
    return sorted((tuple(r) for r in ranked_search(docs, items, k).collect()), key=str)


def corpus(seed=1, n=900):
    pick = random.Random(seed)
    pool = [f"w{i}" for i in range(300)] + ["Été", "x1", "naïve"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    docs = [(i, pick.choice([" ", ", ", "\n"]).join(pick.choices(pool, weights, k=pick.randrange(0, 80)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(200)]  # ties
    docs += [(7, docs[5][1]), (None, "W1 w2 w250"), (None, "W1 w2 w250"), (n + 300, None), (n + 301, "- . -")]
    items = [(i, " ".join(pick.choices(pool, k=pick.randrange(1, 30)))) for i in range(25)]
    items += [(100, docs[3][1]), (100, "w299"), (101, None), (102, "--"), (None, "w1"), (103, "nowhere"), (104, "W0 w0 w1")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of documents and of items, many splits
        for name, value in (("BLOCK_DOCS", 100), ("BLOCK_TERMS", 120), ("BATCH", 3), ("LEAF", 0)):
            monkeypatch.setattr(lexical_search, name, value)
    docs, items = corpus()
    assert run(*frames(spark, docs, items), 50) == brute(docs, items, 50)


def test_awkward_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "stone1 river2 İSTANBUL one"), (2, "AT 010 passage")], "item_id long, text string")
    want = brute([(r[0], r[1]) for r in odd_rows()], [(1, "stone1 river2 İSTANBUL one"), (2, "AT 010 passage")], 5)
    assert run(odd, items, 5) == want
    assert ranked_search(none, items).collect() == []
    assert ranked_search(odd, items.where("false")).collect() == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [r["doc_id"] for r in ranked_search(docs, items).orderBy("rank").collect()] == ["a", "b", None]


@pytest.mark.parametrize("seed", range(6))
def test_block_prunes_and_stays_exact(seed):
    """Best-first search scores few documents where some stand out, and never misses one."""
    make = np.random.default_rng(seed)
    places = [np.sort(make.choice(20_000, size, replace=False)) for size in (15_000, 4_000, 900, 30, 1)]
    sizes = np.array([len(p) for p in places])
    impact = make.integers(0 if seed % 2 else 900, 1000, sizes.sum())
    for p in range(5):  # documents that hold several terms
        impact[np.flatnonzero(np.concatenate(places) == places[3][p])] *= 50
    block = Block(np.arange(5), sizes, np.concatenate(places), impact)
    total = np.zeros(20_000, np.int64)
    np.add.at(total, np.concatenate(places), impact)
    want = np.lexsort((np.arange(20_000), -total))[:10]
    at, scores = block.search(np.arange(5), 10)
    assert at.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    at, _ = block.search(np.arange(5), 10, floor=int(total[want[4]]))
    assert at[:5].tolist() == want[:5].tolist()


def test_norms_beyond_64_bits():
    lengths = np.array([1, 10**7], np.int64)
    assert length_norms(lengths, 10**13, 10**16).tolist() == [50 + 50 * 10**13 // 10**16, 50 + 50 * 10**20 // 10**16]
