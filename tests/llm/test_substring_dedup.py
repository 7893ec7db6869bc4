import re
from collections import Counter

import awkward
import numpy as np
import pytest

from awkward import none, odd  # noqa: F401
from docquarry.llm import substring_dedup as s


def expected(rows, k):
    split = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[j : j + k]) for w in split for j in range(len(w) - k + 1))
    out = Counter()
    for (i, *_), w in zip(rows, split):
        gone = {x for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for x in range(j, j + k)}
        out[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


@pytest.mark.parametrize("hot", (2000, 0))
def test_against_brute_force(odd, hot, monkeypatch):
    monkeypatch.setattr(s, "LEAST_HOT", hot)  # 0: frequent anchors are dealt out
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in s.drop_repeats(odd).collect())
    assert got == expected(awkward.rows(), 35)


def test_shared_passages_when_all_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(s, "LEAST_HOT", 0)
    monkeypatch.setattr(s, "shuffle_parts", lambda spark: 10**9)
    rows = [(i, " ".join(awkward.words(i % 50, i) + awkward.words(50 + i % 3, 99) + ["the"] * (i % 60))) for i in range(60)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in s.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == expected(rows, 35)


def test_edges_that_share_one_hash_are_told_apart():
    edge = np.array([5, 5, 5, 1 << 60, 5], np.uint64)
    other = np.array([7, 8, 7, 7, 7], np.uint64)
    index, back, n = s.equal_edges(np.array([0, 0, 0, 0, 1]), edge, other)
    assert n[back].tolist() == [2, 1, 2, 1, 1] and sorted(index.tolist()) == [0, 1, 3, 4]


def test_windows_with_equal_low_bits_are_told_apart(monkeypatch):
    whole = s.window_hashes
    docs = s.pa.array([" ".join(awkward.words(40, 200 + i)) for i in range(4)])
    # The first hash of a window is made to lose what 48 bits would keep.
    monkeypatch.setattr(s, "window_hashes", lambda words, k: whole(words, k) & ~np.uint64((1 << 48) - 1) if k == 35 else whole(words, k))
    _, _, _, packed, _ = s.segments(docs, 35)
    edges = packed.view("<u8").reshape(-1, 2)
    assert not (edges & np.uint64((1 << 48) - 1)).any() and len(np.unique(edges, axis=0)) == len(edges) == 24


def test_twelve_bytes_an_edge_travel_and_tell_edges_apart():
    _, _, _, packed, offsets = s.segments(s.pa.array([" ".join(awkward.words(60, 300 + i)) for i in range(5)]), 35)
    sent, cuts = s.sent_edges(packed, offsets)
    whole = packed.view("<u8").reshape(-1, 2)
    edge, other = s.read_edges(sent)
    assert len(sent) == 12 * len(whole) and (cuts * 16 == offsets * 12).all()
    assert (edge == whole[:, 0]).all() and (other == whole[:, 1] & np.uint64(0xFFFFFFFF)).all()
    assert len(np.unique(other)) == len(other) == 5 * 26  # the second hash alone tells these apart


def test_segments_of_anchors_that_occur_once_are_not_shuffled(spark, monkeypatch):
    shared = awkward.words(60, 400)
    rows = [(i, " ".join(awkward.words(200, 401 + i))) for i in range(60)]
    rows += [(60 + i, " ".join(awkward.words(40, 500 + i) + shared)) for i in range(2)]
    docs, sent = spark.createDataFrame(rows, "doc_id long, text string"), []
    whole = type(docs).repartition

    def counted(df, *keys):
        if keys == ("anchor", "salt"):
            sent.append(df.count())
        return whole(df, *keys)

    monkeypatch.setattr(type(docs), "repartition", counted)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in s.drop_repeats(docs).collect())
    assert got == expected(rows, 35) and sum(n for _, _, n, _ in got) == 120
    anchors = s.segments(s.pa.array([t for _, t in rows]), 35)[1]
    single = sum(n == 1 for n in Counter(anchors.tolist()).values())
    assert single > 500 and len(sent) == 1 and sent[0] < len(anchors) - 0.8 * single


def test_filter_keeps_all_anchors_and_few_others(spark):
    numbers = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 300_000)
    known = spark.createDataFrame(s.pa.table({"anchor": numbers[:200_000]}))  # 2 pieces of the filter
    rows = spark.createDataFrame(s.pa.table({"anchor": np.append(numbers, numbers[:10]), "of": np.arange(300_010)}))
    kept = {r.of for r in s.maybe_among(rows, known, 200_000).collect()}
    assert kept >= {*range(200_000), *range(300_000, 300_010)} and len(kept) - 200_010 < 8_000
    assert s.maybe_among(rows, known.limit(0), 0).count() == 0


def test_a_full_filter_loses_nothing(odd, monkeypatch):
    monkeypatch.setattr(s, "PIECE_BITS", 6)
    monkeypatch.setattr(s, "MOST_PIECES", 2)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in s.drop_repeats(odd).collect())
    assert got == expected(awkward.rows(), 35)


def test_empty_table(none):
    assert s.drop_repeats(none).count() == 0


def test_sliding_argmin():
    v = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for w in (1, 2, 5, 28):
        assert s.sliding_argmin(v, w).tolist() == [i + int(v[i : i + w].argmin()) for i in range(200 - w + 1)]
