"""A closure deeper than allowed is an error, not a shorter answer."""

import pytest

from tallyloom.operators import hierarchy


def test_nodes_beyond_the_depth_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 5)] + [(4, 1)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "root long")
    assert {(r["node"], r["depth"]) for r in hierarchy.closure(edges, roots, most_deep=4).collect()} == {(i + 1, i) for i in range(5)}
    with pytest.raises(ValueError, match="more than 3 steps"):
        hierarchy.closure(edges, roots, most_deep=3)
