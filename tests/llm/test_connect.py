"""Components of links: in one task while links are few, in steps over written tables beyond."""

import numpy as np
import pytest
from sextant.llm import simhash


def _edges(spark):
    """A long chain, a star, a loop, a repeated and a turned link, negative nodes, and their components' smallest nodes."""
    chain = [(k, k + 7) for k in range(1000, 1700, 7)]
    star = [(-5, k) for k in range(2000, 2040)]
    more = [(1, 1), (3, 2), (2, 3), (2, 3), (4, 3), (-(1 << 63), (1 << 63) - 1)]
    edges = chain + star + more
    node = np.unique(np.array([e for e in edges if e[0] != e[1]]))
    up = {int(n): int(n) for n in node}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    order = np.random.default_rng(4).permutation(len(edges))
    return spark.createDataFrame([edges[k] for k in order], "a long, b long").repartition(4), {n: top(n) for n in up}


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_components_are_the_same_in_one_task_and_in_steps(spark, monkeypatch, most):
    edges, expected = _edges(spark)
    monkeypatch.setattr(simhash, "LINKS", most, raising=False)
    rows = simhash.connect(edges).collect()
    assert len(rows) == len(expected) and {r["node"]: r["root"] for r in rows} == expected
    none = simhash.connect(edges.where("a < a"))
    assert none.columns == ["node", "root"] and none.count() == 0


def test_few_links_are_connected_without_a_query_for_each_step(spark):
    """Each query with many exchanges takes threads and memory of the driver."""
    edges, expected = _edges(spark)
    spark.sparkContext.setJobGroup("connect", "connect")
    try:
        assert len(simhash.connect(edges).collect()) == len(expected)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("connect")) <= 6
