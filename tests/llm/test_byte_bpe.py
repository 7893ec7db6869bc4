import base64

import awkward
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from awkward import none, odd  # noqa: F401
from docquarry.llm import byte_bpe as b

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_odd_rows(odd, none, library):
    got = {(r.doc_id, r.decoded.decode()): r.token_ids for r in b.bpe_round_trip(odd, PATH, P.PATTERN).collect()}
    for i, t, *_ in awkward.rows():
        assert got[i, t or ""] == np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
    assert b.bpe_round_trip(none, PATH, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,ab1é \x1c　Ǆ"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(library, text):
    coder = b.coder(PATH, P.PATTERN)
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert coder.decode(ids).decode() == text


def test_perfect_hash():
    keys = [str(i).encode() for i in range(3000)]
    table = b.PerfectHash(keys, list(range(3000)))
    assert [table.find(k) for k in keys] == list(range(3000))
    assert len(table.keys) == 3000 and table.find(b"x") is None
    with pytest.raises(ValueError):
        b.PerfectHash([b"a", b"a"], [1, 2])
