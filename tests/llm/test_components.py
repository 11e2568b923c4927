"""Connected components against union-find."""

import random

import pytest

from pointset.llm.common import Scratch
from pointset.llm.components import components


def brute(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("links", [
    [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (95, 100)],
    [(5, k) for k in range(6, 60)] + [(60, 59), (-3, 60), (1 << 40, -(1 << 62))],
    [(7, 7), (None, 3), (4, None), (8, 9), (9, 8), (8, 9)],
    [(random.Random(k).randrange(300), random.Random(-k).randrange(300)) for k in range(180)],
    [],
])
def test_components(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    with Scratch(spark) as scratch:
        found = components(df, scratch).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == brute(links)


def test_scratch_tables_go(spark):
    with Scratch(spark) as scratch:
        table = scratch.written(spark.range(5), "five")
        assert table.count() == 5
        path = scratch.paths[0]
    jvm = spark._jvm.org.apache.hadoop.fs
    assert not jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.Path(path))
