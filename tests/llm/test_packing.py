from collections import Counter, defaultdict

import awkward
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from awkward import none, odd  # noqa: F401
from docquarry.llm import packing as k

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_odd_rows(odd, none, library):
    rows = k.best_fit_pack(odd, PATH).collect()
    check_places(rows, 4096)
    want = Counter()
    for i, t, *_ in awkward.rows():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            want[i, n, at, np.array(ids[at : at + 4096], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.token_ids)) for r in rows) == want
    assert k.best_fit_pack(none, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n.,'!?_aTé1ßÀ \x1cΣİ"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(library, text):
    got = k.coder(PATH).encode_all([text])[0]
    assert np.frombuffer(got, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=25))
def test_plan_is_best_fit(histogram):
    plan, used = k.best_fit_plan(histogram, 40), defaultdict(list)
    for length in histogram:
        own = sorted(r for r in plan.tolist() if r[0] == length)
        assert own[0][1] == 0
        ends = [r[1] for r in own[1:]] + [histogram[length]]
        for (_, first, sequence, per, offset), end in zip(own, ends):
            for n in range(end - first):
                used[sequence + n // per].append((offset + n % per * length, length))
    bins = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [b for b in range(len(bins)) if bins[b] >= length]
            if fit:
                best = min(fit, key=lambda b: bins[b])
                bins[best] -= length
            else:
                bins.append(40 - length)
    assert len(used) == len(bins)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
