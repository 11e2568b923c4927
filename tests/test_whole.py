"""Queries whose SQL covers a part of the rows only, or cannot cover all inputs, against brute force on small tables."""

import heapq
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from pointset.plans import catalog


def written(df, tmp_path, name):
    df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")


def found(spark, tmp_path, name, columns):
    rows = [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_ranges_of_all_orders(spark, tmp_path):
    """Every order takes part, whatever its id."""
    orders = [(k, k * 37 % 113, "FOP"[k % 3]) for k in range(1, 90)]
    part = [(k, f"B{k * 7 % 5}") for k in range(1, 100) if k % 6]
    written(spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string"), tmp_path, "orders")
    written(spark.createDataFrame(part, "p_partkey long, p_brand string"), tmp_path, "part")
    image = {(status, p) for _, at, status in orders for p, _ in part if at <= p <= at + 4}
    preimage = {(brand, o) for o, at, _ in orders for p, brand in part if at <= p <= at + 2}
    assert found(spark, tmp_path, "d5_image_range", ["color", "p_partkey"]) == image
    assert found(spark, tmp_path, "d10_preimage_range", ["color", "o_orderkey"]) == preimage


@pytest.mark.parametrize("apart", [3, 40_000])
def test_resample_covers_the_log(spark, tmp_path, apart):
    """The twenty buckets hold the whole of a short and of a long log."""
    began = datetime(2024, 3, 1)
    events = [(k, began + timedelta(seconds=k * apart), k * 5 % 11, "view") for k in range(100)]
    written(spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string"), tmp_path, "events")
    spans = [(user % 8, k * apart, k * apart + 1 + k * 7919 % 5000) for k, _, user, _ in events]
    width = -(-max(stop for *_, stop in spans) // 20)
    open_for = Counter()
    for proc, start, stop in spans:
        for bucket in range(20):
            open_for[proc, bucket] += max(0, min(stop, (bucket + 1) * width) - max(start, bucket * width))
    mean = {(proc, bucket): round(t / width, 6) for (proc, bucket), t in open_for.items() if t}
    rows = catalog.queries()["l5_resample"](spark, str(tmp_path)).collect()
    assert {(r["proc"], r["bucket"]): pytest.approx(r["mean"], abs=2e-6) for r in rows} == mean
    assert len(rows) == len(mean)
    assert sum(open_for.values()) == sum(stop - start for _, start, stop in spans)


def test_shortest_paths_over_many_edges(spark, tmp_path):
    """A path of 21 nodes from supplier 3, and a part of the graph that no source reaches."""
    pairs = [(3 + k, k) for k in range(10)] + [(4 + k, k) for k in range(10)] + [(900, 901), (902, 901)]
    written(spark.createDataFrame(pairs, "l_suppkey long, l_partkey long"), tmp_path, "lineitem")
    near = defaultdict(set)
    for s, p in pairs:
        near[s].add(p + 1000000)
        near[p + 1000000].add(s)
    least, heap = {}, [(0, 3)]
    while heap:
        far, at = heapq.heappop(heap)
        if at not in least:
            least[at] = far
            for to in near[at]:
                heapq.heappush(heap, (far + (at + to) % 7 + 1, to))
    assert found(spark, tmp_path, "g2_shortest_paths", ["id", "distance"]) == {(n, least.get(n)) for n in near}


def test_edges_are_made_once(spark):
    """Nodes and degrees are read from the dealt edges, without a second pass over lineitem."""
    catalog.checkpoints(spark)
    nodes, edges = catalog._trade(spark, "/root/testdata/sf0.001")
    assert edges.count() == edges.distinct().count() > 0
    for rows in (nodes, edges.groupBy("src").count()):
        assert "parquet" not in rows._jdf.queryExecution().executedPlan().toString()
