"""Exact dedup where ids are null or repeat: variants of a text in white space, against brute force."""

from collections import defaultdict

import pytest

from tallyloom.llm import exact_dedup
from tests.llm.fixtures import table


def doc(i, text):
    return (i, text, None, None, 1, "x", "y", "z", 1, False, "q")


@pytest.mark.parametrize("i", [None, 5])
def test_white_space_variants_of_one_id_leave_the_longest(spark, i):
    rows = [doc(i, t) for t in ("a b", "ab", " a b\n", "other", None, " ")] + [doc(7, "a\tb"), doc(i, "o ther"), doc(i, "o ther"), doc(8, "c"), doc(i, "c")]
    groups = defaultdict(list)
    for r in rows:
        groups["".join((r[1] or "").split())].append(r)
    want = []
    for same in groups.values():
        best = min(same, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        want.append((best[0], best[1]))
    got = [(r["doc_id"], r["text"]) for r in exact_dedup.drop_duplicates(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
