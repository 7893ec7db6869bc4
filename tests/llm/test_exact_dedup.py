import hashlib
import re
from collections import Counter, defaultdict

import awkward
import pytest

from awkward import none, odd  # noqa: F401
from docquarry.llm import exact_dedup as x


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    out = Counter()
    for body, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for k, (_, _, i) in enumerate(members):
            out[i, members[0][2], len(members), k == 0, hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", (32, 1))
def test_groups_against_brute_force(odd, hot, monkeypatch):
    monkeypatch.setattr(x, "LEAST_HOT", hot)  # 1: nearly all groups are dealt out
    got = Counter(map(tuple, x.exact_dedup(odd).collect()))
    assert got == expected(awkward.rows())


def test_rows_that_stay(odd):
    kept = x.drop_copies(odd)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(
        (k[0] or -1) for k, n in expected(awkward.rows()).items() for _ in range(n) if k[3]
    )


def test_empty_table(none):
    assert x.exact_dedup(none).count() == 0
    assert x.drop_copies(none).columns == none.columns


def test_main_path_is_native(odd):
    plan = x.exact_dedup(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
