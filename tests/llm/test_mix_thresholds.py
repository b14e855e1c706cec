"""The mix's thresholds and closing documents against sorting, source by source."""

from collections import defaultdict

import pytest

from tallyloom.llm import source_mixing
from tests.llm.fixtures import table


@pytest.mark.parametrize(("weights", "budget"), [((3, 1, 2), 1.5), ((1,), 0.4), ((5, 1), 1.9)])
def test_thresholds_take_the_longest_run_of_hashes_that_fits(spark, weights, budget):
    rows = source_mixing._sized(table(spark), "doc_id", "text", "source", 7).drop("row").cache()
    plan = {r["s"]: r for r in source_mixing._plan(rows, weights, budget, 2.0).collect()}
    by_source = defaultdict(list)
    for r in rows.collect():
        by_source[r["source"]].append((r["h"], r["size"]))
    assert set(plan) == set(by_source)
    for source, held in by_source.items():
        p = plan[source]
        total = sum(n for _, n in held)
        whole = int(p["target"] / total + 1e-12) if total else 0
        assert (p["source_size"], p["whole"]) == (total, whole)
        rest = max(0.0, p["target"] - whole * total)
        if not rest:
            continue
        taken, sums = set(), 0
        for h in sorted({h for h, _ in held}):
            here = sum(n for x, n in held if x == h)
            if sums + here > rest:
                break
            taken, sums = taken | {h}, sums + here
        assert {h for h, n in held if n and h < p["threshold"]} == {h for h in taken if any(n for x, n in held if x == h)}
        missing, closing = rest - sums, []
        for n in range(source_mixing.CLOSING + 1):
            open_ = [(abs(missing - size), h) for h, size in held if h >= p["threshold"] and size and h not in closing and (missing >= size if n < source_mixing.CLOSING else abs(missing - size) < missing)]
            if open_:
                missing, h = min(open_)
                closing.append(h)
        assert list(p["closing"]) == closing
