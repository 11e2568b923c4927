"""Small literal cases of partitions, reductions and scans with the volumes and sums that they must give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointset.functions import reductions as R
from pointset.functions import scalar as S
from pointset.operators import intervals as L
from pointset.operators import iterative as G
from pointset.operators import launch as U
from pointset.operators import partition as D
from pointset.operators import region as C
from pointset.operators import scan as W
from pointset.sources import tables as T

POINTS = [[(0, 0), (0, 0), (2, 1), (1, 2)], [(1, 1), (1, 1), (3, 1), (1, 3)], [(0, 1), (2, 0), (3, 0), (0, 0)], [(1, 0), (2, 0), (3, 2), (0, 1)]]
COLORS = [[(0, 1), (1, 0), (0, 1), (1, 0)], [(1, 1), (1, 0), (0, 1), (1, 1)], [(0, 0), (1, 1), (1, 1), (0, 0)], [(0, 0), (1, 1), (1, 1), (0, 0)]]
BOXES = {(0, 1): (0, 0, 3, 3), (2, 0): (1, 0, 2, 0), (3, 3): (1, 2, 3, 3)}
SQUARE = [(i, j) for i in range(4) for j in range(4)]


def volumes(partition):
    found = {tuple(r[c] for c in partition.color): r["volume"] for r in partition.volumes().collect()}
    return [found.get(c, 0) for c in [(0, 0), (0, 1), (1, 0), (1, 1)]]


@pytest.fixture(scope="module")
def square(spark):
    rows = [(i, j, *POINTS[i][j], *COLORS[i][j], *BOXES.get((i, j), (0, 0, -1, -1))) for i, j in SQUARE]
    return spark.createDataFrame(rows, "p0 long, p1 long, x long, y long, c0 long, c1 long, lo0 long, lo1 long, hi0 long, hi1 long")


@pytest.fixture(scope="module")
def tiles(spark, square):
    colors = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "color0 long, color1 long")
    return D.restriction(square, ["p0", "p1"], colors, [[2, 0], [0, 2]], ((0, 0), (1, 1)), ["color0", "color1"])


P = ["p0", "p1"]


def test_square_partitions(spark, square, tiles):
    assert volumes(tiles) == [4, 4, 4, 4]
    assert volumes(D.image(square, P, tiles, square, ["x", "y"])) == [2, 4, 3, 4]
    assert volumes(D.by_field(square, P, ["c0", "c1"])) == [4, 3, 3, 6]
    assert volumes(D.image_range(square, P, tiles, square, ["lo0", "lo1"], ["hi0", "hi1"], 2)) == [16, 0, 2, 6]
    assert volumes(D.preimage(tiles, square, P, ["x", "y"])) == [8, 2, 5, 1]
    assert volumes(D.preimage_range(tiles, square, P, ["lo0", "lo1"], ["hi0", "hi1"], 2)) == [2, 2, 2, 2]
    diagonal = D.restriction(square, P, spark.range(3).toDF("color"), [[1], [2]], ((-1, -1), (0, 0)))
    assert sorted((r["color"], r["volume"]) for r in diagonal.volumes().collect()) == [(0, 1), (1, 4), (2, 2)]


def test_equal_forms(spark):
    g = C.grid(spark, (0, 2), (0, 4))
    blocks = D.equal_blocks(g, P, [2, 2]).df
    assert blocks.agg(F.sum((1 + F.col("color0")) * (1 + F.col("color1")))).first()[0] == 28
    assert D.equal_blocks(g, P, [3, 1]).df.agg(F.sum((1 + F.col("color0")) * (1 + F.col("color0")))).first()[0] == 70
    p = D.equal(spark.range(15), "id", [2, 1, 3])
    total = p.df.agg(F.sum(F.col("id") + 100 * F.col("color0") + 1000 * F.col("color1") + 10000 * F.col("color2"))).first()[0]
    assert total == 151005
    sizes = {tuple(r[c] for c in p.color): r["volume"] for r in p.volumes().collect()}
    assert [sizes[x, 0, z] for z in range(3) for x in range(2)] == [2, 3, 2, 3, 2, 3]
    wide = D.equal(C.grid(spark, (0, 3), (0, 9)), P, 5).df
    assert wide.groupBy("color").agg(F.min("p1").alias("a"), F.max("p1").alias("b"), F.count("*").alias("n")).where("b - a = 1 and n = 8").count() == 5


def test_preimage_mirror_and_cross_of_four(spark):
    r = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 2)], "pt long, ptr long")
    target = D.by_points(spark.createDataFrame([(k,) for k in range(4)], "s long"), "s", spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "color long, s long"))
    found = D.preimage(target, r, ["pt"], "ptr").df
    assert found.agg(F.sum(F.col("color") + 2)).first()[0] == 3 + 2 + 3 + 4
    a = D.by_points(r, "pt", spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "color long, pt long"))
    b = D.by_points(r, "pt", spark.createDataFrame([(0, 0), (1, 1), (0, 2), (1, 3)], "color long, pt long"))
    assert [r["volume"] for r in a.cross(b).volumes().collect()] == [1, 1, 1, 1]
    assert a.cross(b).slice([(0, 1)]).df.collect()[0]["pt"] == 1
    assert sorted(map(tuple, a.cross_list(b).collect())) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert a.cross(b).invert().color == ["color2", "color"]


def test_colors_of_two_columns_interfere(spark):
    df = spark.createDataFrame([(0, 0, 7), (0, 1, 7), (1, 0, 8)], "color0 int, color1 int, pt int")
    found = D.Partition(df, ["color0", "color1"], ["pt"]).interfering().collect()
    assert [(tuple(r["color1"]), tuple(r["color2"])) for r in found] == [((0, 0), (0, 1))]


def test_cross_colorings_and_constraints(spark):
    r = spark.range(6).toDF("pt")
    p = D.by_field(r, ["pt"], F.floor(F.col("pt") / 3))
    own = p.cross_colorings({0: spark.createDataFrame([(7, 0), (8, 1), (8, 5)], "color2 int, pt long"), 1: spark.createDataFrame([(9, 4)], "color2 int, pt long")})
    assert sorted(map(tuple, own.df.select("color", "color2", "pt").collect())) == [(0, 7, 0), (0, 8, 1), (1, 9, 4)]
    assert D.constrained(r, D.subset(r.where("pt < 3"), r, ["pt"])).count() == 6
    with pytest.raises(Exception, match="constraint"):
        D.constrained(r, D.apart(r.where("pt < 3"), r, ["pt"])).collect()


def test_weights_cut_where_they_must(spark):
    sizes = D.by_weights(spark.range(10, 113), "id", spark.createDataFrame([(0, 1), (1, 0), (2, 5), (3, 3)], "color long, weight long")).df
    found = {r["color"]: (r["a"], r["b"]) for r in sizes.groupBy("color").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()}
    cuts = [10 + 103 * w // 9 for w in (0, 1, 1, 6, 9)]
    assert found == {0: (cuts[0], cuts[1] - 1), 2: (cuts[2], cuts[3] - 1), 3: (cuts[3], cuts[4] - 1)}
    assert "BroadcastNestedLoopJoin BuildLeft" not in sizes._jdf.queryExecution().executedPlan().toString()  # only one-row tables are


def test_covering(spark):
    points = [1, 2, 3, 10, 11, 40, 90, 91]
    found = sorted(map(tuple, D.covering(spark.createDataFrame([(k,) for k in points], "k long"), "k", 3).collect()))
    assert found == [(1, 11), (40, 40), (90, 91)]
    assert sorted(map(tuple, D.rects(spark.createDataFrame([(k,) for k in points], "k long"), "k").collect())) == [(1, 3), (10, 11), (40, 40), (90, 91)]
    cloud = spark.createDataFrame([(0, 0), (1, 1), (90, 95), (99, 99)], "x long, y long")
    boxes = D.covering_boxes(cloud, ["x", "y"], 2).collect()
    assert sorted((r["lo0"], r["hi0"], r["lo1"], r["hi1"], r["volume"]) for r in boxes) == [(0, 1, 0, 1, 2), (90, 99, 95, 99, 2)]
    assert D.covering_boxes(cloud, ["x", "y"], 2, max_overhead=1.0).count() == 0


def test_region_reduction_and_gather(spark, square):
    r = C.fill(C.fill(C.region(square.select(P), {"x": "double", "y": "int"}), "x", F.lit(1.25)), "y", F.lit(2))
    more = square.select(*P, F.lit(20.0).alias("value"))
    assert {row["x"] for row in U.task_reduction(r, P, [more], "x", "sum").collect()} == {21.25}
    got = C.gather_affine(square.select(P), P, [[0, 1], [1, 0]], [0, 1], square, P, {"x": "f"}).collect()
    assert {(g["p0"], g["p1"]): g["f"] for g in got} == {(i, j): POINTS[j][i + 1][0] if i < 3 else None for i, j in SQUARE}


# --- expressions that machine types decide --------------------------------------------------------------------------------


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_wide_integer_division(spark):
    big = 9007199254740993
    lit = lambda x: F.lit(x).cast("long")
    assert tuple(one(spark, *[S.int_div(lit(a), lit(b)) for a, b in ((big, 1), (-big, 2), (7, -2), (-7, 2), (5, 0))])) == (big, -(big // 2), -3, -3, None)
    values = spark.createDataFrame([(3,), (2,), (5,)], "v long")
    assert values.agg(R.reduce("div", F.col("v"), "long", F.lit(9 * big))).first()[0] == 9 * big // 30
    assert values.agg(R.reduce("div", F.col("v"), "long", F.lit(-91))).first()[0] == -3


def test_nan_never_wins(spark):
    nan = F.lit(float("nan"))
    x = F.lit(3.2)
    assert tuple(one(spark, S.max2(x, nan), S.max2(nan, x), S.min2(x, nan), S.min2(nan, x), R.combine("max", nan, x), R.combine("min", x, nan))) == (3.2,) * 6
    assert one(spark, *S.compare(x, nan).values()) == (False, False, False, False, False, True)
    dst = spark.createDataFrame([(1, float("nan")), (2, 5.0)], "k long, f double")
    src = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "k long, v double")
    assert {r["k"]: r["f"] for r in C.reduction_copy(dst, src, ["k"], "v", "f", "max").collect()} == {1: 1.0, 2: 5.0}


@pytest.mark.parametrize("x", [0.0, 1.0, -1.0, 0.1, 2.0**53 - 1, -(2.0**70), 3e-310, 5e-324, 1.7e308, float("inf")])
def test_frexp_and_copysign(spark, x):
    found = one(spark, S.COMPOSED["frexp"](F.lit(x)), S.COMPOSED["copysign"](F.lit(2.5), F.lit(-0.0)), S.COMPOSED["copysign"](F.lit(-2.5), F.lit(x)))
    mantissa, exponent = np.frexp(x)
    assert tuple(found[0]) == (mantissa, exponent if np.isfinite(x) else 0)
    assert found[1] == -2.5 and found[2] == np.copysign(2.5, x)


def test_special_functions(spark):
    """Against series that converge fast for these arguments."""
    import math

    def series(n, x):
        return sum((-1) ** k / (math.factorial(k) * math.factorial(k + n)) * (x / 2) ** (2 * k + n) for k in range(40))

    for x in (0.3, 1.0, 2.7, 5.5):
        v = F.lit(x)
        found = one(spark, *[S.special(f, v) for f in ("erf", "erfc", "lgamma", "tgamma", "j0", "j1")], S.bessel(3, v), S.nextafter(v, F.lit(9.0)))
        assert tuple(found) == pytest.approx((math.erf(x), math.erfc(x), math.lgamma(x), math.gamma(x), series(0, x), series(1, x), series(3, x), math.nextafter(x, 9)), rel=1e-9, abs=1e-12)
        y0, y1, y2 = one(spark, S.special("y0", v), S.special("y1", v), S.bessel(2, v, second=True))
        assert series(1, x) * y0 - series(0, x) * y1 == pytest.approx(2 / (math.pi * x), rel=1e-5)  # the Wronskian
        assert y2 == pytest.approx(2 / x * y1 - y0, rel=1e-4, abs=1e-5)  # the recurrence


# --- scans, graphs, records -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("op", ["sum", "prod", "min", "max"])
def test_scans_on_skewed_orders(spark, op, forward):
    """Orders that crowd at one end still make blocks; the scan is that of a loop."""
    places = sorted({k**5 for k in range(60)} | set(range(300)))
    rows = [(k, (k + 5) % 10 + 1.0) for k in places]
    want, total = {}, None
    for k, v in rows if forward else rows[::-1]:
        total = v if total is None else {"sum": total + v, "prod": total * v, "min": min(total, v), "max": max(total, v)}[op]
        want[k] = total
        if op == "prod" and total > 1e200:
            total = 1.0
    df = spark.createDataFrame(rows, "k long, v double")
    if op == "prod":
        df, want, total = df.withColumn("v", F.lit(1.01)), {}, 1.0
        for k, _ in rows if forward else rows[::-1]:
            want[k] = total = total * 1.01
    found = {r["k"]: r["s"] for r in W.prefix_scan(df, [], "k", "v", op, "s", forward).collect()}
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    blocks = W._blocked(df, "k", 16).groupBy("__block").count().collect()
    assert max(r["count"] for r in blocks) <= 3 * len(rows) / 16


def test_edges_from_offsets_with_gaps(spark):
    offsets = spark.createDataFrame([(1, 0), (4095, 2), (5000, 3), (9000, 5)], "src long, first long")
    targets = spark.createDataFrame([(k, 100 + k) for k in range(6)], "place long, dst long")
    assert sorted(map(tuple, T.edges_from_offsets(offsets, targets).collect())) == [(1, 100), (1, 101), (4095, 102), (5000, 103), (5000, 104), (9000, 105)]


def test_association(spark):
    a, b = spark.createDataFrame([(k,) for k in (5, 1, 9)], "a long"), spark.createDataFrame([(k,) for k in (20, 10)], "b long")
    assert sorted(map(tuple, D.association(a, "a", b, "b", "to").collect())) == [(1, 10), (5, 20), (9, None)]


def test_critical_path_with_queues_and_unknown_events(spark):
    nodes = spark.createDataFrame([(1, 5, 0, False, False), (2, 3, 0, False, False), (3, 1, 0, False, False), (4, 1, 0, True, False), (5, 0, 0, False, True), (6, 2, 0, False, False), (7, 1, 100, False, False)], "id long, duration long, created long, queue boolean, unknown boolean")
    edges = spark.createDataFrame([(1, 3), (2, 3), (1, 4), (2, 4), (5, 6), (3, 6), (3, 7)], "src long, dst long")
    found = {r["id"]: (r["finish"], r["critical"]) for r in L.critical_path(nodes, edges).collect()}
    assert found == {1: (5, 1), 2: (3, 2), 3: (6, 1), 4: (4, 2), 5: (None, 5), 6: (None, 5), 7: (101, 7)}
    with pytest.raises(ValueError, match="not still"):
        L.critical_path(nodes, edges.union(spark.createDataFrame([(3, 1)], "src long, dst long")), most=12)


def test_critical_path_of_long_chains(spark):
    """A chain of 60 events takes few steps; chains behind queues, late and unknown events end as one event after the other does."""
    rng = random.Random(8)
    n = 60
    nodes = {k: (rng.randrange(4), rng.choice([0, 0, 0, 30, 90]), False, k == 40) for k in range(n)} | {100 + k: (rng.randrange(5), 0, k % 9 == 0, k == 7) for k in range(n)}
    edges = [(k, k + 1) for k in range(n - 1)] + [(100 + k // 2, 100 + k) for k in range(1, n)] + [(100 + k - 3, 100 + k) for k in range(9, n, 9)] + [(999, 100)]
    finish, critical = {}, {}
    for k, (duration, created, queue, unknown) in sorted(nodes.items()):
        came = [a for a, b in edges if b == k and a in nodes]
        lost = [critical[a] for a in came if finish[a] is None]
        at, by = (min if queue else max)(((finish[a], a) for a in came if finish[a] is not None), default=(-1, None))
        waits = at > created
        finish[k] = None if unknown or lost else (at if waits else created) + duration
        critical[k] = k if unknown else max(lost) if lost else by if waits else k
    table = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "id long, duration long, created long, queue boolean, unknown boolean")
    found = {r["id"]: (r["finish"], r["critical"]) for r in L.critical_path(table, spark.createDataFrame(edges, "src long, dst long"), most=12).collect()}
    assert found == {k: (finish[k], critical[k]) for k in nodes}


def test_loops(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (8, 8), (9, 1), (10, 11)]
    found = {r["id"]: r["loop"] for r in L.loops(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert found == {1: 3, 2: 3, 3: 3, 5: 6, 6: 6, 8: 8}
    assert L.loops(spark.createDataFrame([(1, 2)], "src long, dst long")).collect() == []


def test_links_keep_strangers(spark):
    tasks = spark.createDataFrame([(1, "a"), (2, "b")], "key long, name string")
    waits = spark.createDataFrame([(1, 3, 8), (1, 10, 11), (5, 0, 4)], "key long, start long, stop long")
    found = {r["key"]: (r["known"], r["name"], r["n_wait"], r["total_wait"]) for r in L.link(tasks, "key", {"wait": waits}).collect()}
    assert found == {1: (True, "a", 2, 6), 2: (True, "b", 0, 0), 5: (False, None, 1, 4)}


def test_levels_are_the_lowest_free_ones(spark):
    import random

    rng = random.Random(3)
    rows = [(k, k % 3, s := rng.randrange(400), s + rng.randrange(1, 40)) for k in range(300)]
    found = {r["id"]: r["level"] for r in L.levels(spark.createDataFrame(rows, "id long, proc long, start long, stop long"), ["proc"], "id").collect()}
    assert len(found) == len(rows)
    for proc in range(3):
        own = sorted((r for r in rows if r[1] == proc), key=lambda r: (r[2], r[0]))
        for n, (k, _, start, _) in enumerate(own):
            taken = {found[j] for j, _, s, e in own[:n] if s <= start < e}
            assert found[k] == min(x for x in range(len(taken) + 1) if x not in taken)


def test_conjugate_gradient_and_cholesky(spark):
    from pointset.plans import catalog, workloads

    n = 12
    m = workloads.spd(n)
    matrix = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n)], "row long, col long, value double")
    b = spark.createDataFrame([(i, float(i + 1)) for i in range(n)], "col long, value double")
    x = {r["col"]: r["value"] for r in G.conjugate_gradient(matrix, b, 20, 1e-24).collect()}
    assert [x[i] for i in range(n)] == pytest.approx(np.linalg.solve(m, np.arange(1.0, n + 1)).tolist(), rel=1e-8)
    found = catalog.queries()["g9_cholesky"](spark, "").collect()
    want = np.linalg.cholesky(workloads.spd(48))
    assert len(found) == 48 * 49 // 2
    assert all(r["value"] == pytest.approx(want[r["row"], r["col"]], abs=1e-8) for r in found)


def test_user_reduction_and_pickled_values(spark):
    import pickle

    rows = spark.createDataFrame([("a", bytearray(pickle.dumps([1]))), ("a", bytearray(pickle.dumps([2, 3]))), ("b", bytearray(pickle.dumps([])))], "k string, v binary")
    found = {r["k"]: sorted(pickle.loads(bytes(r["value"]))) for r in U.reduce_pickled(rows, ["k"], "v", lambda a, b: a + b).collect()}
    assert found == {"a": [1, 2, 3], "b": []}


def test_states_of_a_key_over_many_batches(spark):
    rows = spark.range(4000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 7 != 3, F.col("id")).alias("v"), (F.col("id") % 3).alias("j")).repartition(9)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        total = lambda part: part.groupby(["k", "j"], as_index=False)["v"].sum()
        found = U.reduce_by_task(rows.fillna(0), ["k", "j"], total, total, "v long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for i in range(4000):
        want[i % 7, i % 3] = want.get((i % 7, i % 3), 0) + (i if i % 7 != 3 else 0)
    assert len(found) == 21 and {(r["k"], r["j"]): r["v"] for r in found} == want


def test_binary_files_in_ranges(spark, tmp_path):
    x = np.zeros(3000, [("k", "<i8"), ("v", "<f4")])
    x["k"], x["v"] = np.arange(3000), np.arange(3000) / 4
    for name in "ab":
        (tmp_path / name).write_bytes(x.tobytes())
    df = T.attach_records(spark, [str(tmp_path / "a"), str(tmp_path / "b")], x.dtype, "k long, v float")
    assert df.groupBy("file").agg(F.count("*").alias("n"), F.sum((F.col("record") == F.col("k")).cast("int")).alias("m"), F.sum("v").alias("s")).select("n", "m", "s").distinct().collect() == [(3000, 3000, float(x["v"].astype(float).sum()))]


def test_stream_drops_late_records(spark, tmp_path):
    from datetime import datetime, timedelta

    from pointset.streaming import records as ST

    began = datetime(2024, 1, 1)
    out, source = tmp_path / "out", tmp_path / "in"

    def arrive(name, minutes):
        spark.createDataFrame([(began + timedelta(minutes=m), "k", 1.0) for m in minutes], "ts timestamp, kind string, value double").coalesce(1).write.parquet(str(source / name))
        (source / name).rename(tmp_path / name)
        for part in (tmp_path / name).glob("*.parquet"):
            part.rename(source / f"{name}-{part.name}")

    def run():
        stream = ST.counts_by_window(ST.record_stream(spark, str(source), "ts timestamp, kind string, value double"), "ts", "kind")
        stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start().awaitTermination()
        return {r["w"].start: r["records"] for r in spark.read.parquet(str(out / "rows")).collect()}

    source.mkdir()
    arrive("a", [5, 20, 70, 200])
    assert run() == {began: 2, began + timedelta(hours=1): 1}
    arrive("b", [30, 185, 400])  # the first is too late for its window
    assert run() == {began: 2, began + timedelta(hours=1): 1, began + timedelta(hours=3): 2}
