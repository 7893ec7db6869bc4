import re
from collections import Counter

import awkward
import pytest

from awkward import none, odd  # noqa: F401
from docquarry.llm import jaccard_join as j


def expected(rows, similarity=0.8):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    linked = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b:
                same = (rows[a][1] or "") == (rows[b][1] or "")
                union = len(sets[a] | sets[b])
                linked[a][b] = same or (union > 0 and len(sets[a] & sets[b]) / union >= similarity)
    label = list(range(n))
    for _ in range(n):
        for a in range(n):
            label[a] = min([label[a]] + [label[b] for b in range(n) if linked[a][b]])
    out = Counter()
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if label[b] == label[a] and rows[b][0] is not None]
        copies = [rows[b][0] for b in range(n) if (rows[b][1] or "") == (rows[a][1] or "")]
        known = [i for i in copies if i is not None]
        out[rows[a][0], min(ids, default=None), min(known, default=None), len(copies), sum(linked[a])] += 1
    return out


def test_odd_rows(odd):
    assert Counter(map(tuple, j.near_duplicates(odd).collect())) == expected(awkward.rows())


@pytest.mark.parametrize("small", (2, 10_000))
def test_large_buckets_are_split_and_compared_in_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(j, "SMALL", small)
    monkeypatch.setattr(j, "BLOCK_ROWS", 7)
    passage = awkward.words(60, 5)
    rows = []
    for i in range(40):  # one class of near copies, and texts that share half of their words
        text = awkward.words(100, 6)
        text[i] = f"own{i}"
        rows.append((i, " ".join(text)))
        rows.append((100 + i, " ".join(awkward.words(60, 10 + i) + passage)))
    got = Counter(map(tuple, j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == expected(rows)


def test_repeated_rows_in_buckets_that_are_split(spark, monkeypatch):
    monkeypatch.setattr(j, "SMALL", 2)
    passage, rows = awkward.words(60, 5), []
    for i in range(12):  # pairs of near copies that share a passage with all
        own = awkward.words(60, 10 + i)
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join(own[:-1] + ["end"] + passage))]
    rows += rows
    got = Counter(map(tuple, j.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == expected(rows)
    sets = spark.createDataFrame([(b"a", list(range(30)))] * 2, "key binary, tokens array<long>")
    members = spark.createDataFrame([(1, b"a")], "bucket long, key binary")
    parts = j.split(members, sets, 10.0)
    assert parts.count() == parts.distinct().count() > 0


def test_empty_table_and_runs(none):
    assert j.near_duplicates(none).count() == 0
    assert j.runs_for(0.9999) > j.runs_for(0.99) > 4
