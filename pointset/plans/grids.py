"""Queries on spaces and partitions of two dimensions, boxes, lists of partitions and associations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointset.functions import scalar as S
from pointset.operators import partition as D
from pointset.operators import region as C
from pointset.operators.rangejoin import ranges_overlap
from pointset.operators.scan import numbered
from pointset.plans.registry import query, table

#: A grid of 60 x 40 points with a pointer to a point and a box, as SQL and as a region.
GRID = "g AS (SELECT a AS p0, b AS p1, (a * 7 + b * 3) % 60 AS t0, (a + b * 5) % 40 AS t1, (a * 7 + b * 3) % 60 AS lo0, (a + b * 5) % 40 AS lo1, (a * 7 + b * 3) % 60 + a % 4 - 1 AS hi0, (a + b * 5) % 40 + b % 3 AS hi1 FROM range(60) t(a), range(40) u(b)) "
TILED = "WITH " + GRID + ", tiled AS (SELECT p0 // 20 AS color0, p1 // 10 AS color1, * FROM g) "


def grid(spark):
    a, b = F.col("p0"), F.col("p1")
    g = C.grid(spark, (0, 59), (0, 39)).withColumn("t0", (a * 7 + b * 3) % 60).withColumn("t1", (a + b * 5) % 40)
    return g.withColumn("lo0", F.col("t0")).withColumn("lo1", F.col("t1")).withColumn("hi0", F.col("t0") + a % 4 - 1).withColumn("hi1", F.col("t1") + b % 3)


def tiles(g):
    return D.blockify(g, ["p0", "p1"], [20, 10])


@query("d1_equal_2d", "SELECT ((a + 1) * 6 - 1) // 45 % 2 AS color0, 0::BIGINT AS color1, ((a + 1) * 6 - 1) // 45 // 2 AS color2, count(*) AS volume FROM range(45) t(a), range(10) u(b) GROUP BY ALL")
def d1_2d(spark, d):
    return D.equal(C.grid(spark, (0, 44), (0, 9)), ["p0", "p1"], [2, 1, 3]).volumes()


@query("d4_image_2d", TILED + "SELECT DISTINCT color0, color1, t0 AS p0, t1 AS p1 FROM tiled")
def d4_2d(spark, d):
    g = grid(spark)
    return D.image(g, ["p0", "p1"], tiles(g), g, ["t0", "t1"]).df


@query("d5_image_boxes", TILED + "SELECT DISTINCT color0, color1, x AS p0, y AS p1 FROM tiled JOIN (SELECT p0 AS x, p1 AS y FROM g) ON x BETWEEN lo0 AND hi0 AND y BETWEEN lo1 AND hi1")
def d5_boxes(spark, d):
    g = grid(spark)
    return D.image_range(g.select("p0", "p1"), ["p0", "p1"], tiles(g), g, ["lo0", "lo1"], ["hi0", "hi1"], [4, 4]).df


def _neighbours(rows):
    import pandas as pd

    return pd.concat([rows.assign(p0=rows["p0"] + i, p1=rows["p1"] + j) for i, j in ((0, 1), (1, 0), (-1, -1))])


@query("d8_image_by_task", TILED + "SELECT DISTINCT color0, color1, p0 + i AS p0, p1 + j AS p1 FROM tiled, (VALUES (0, 1), (1, 0), (-1, -1)) o(i, j) WHERE p0 + i BETWEEN 0 AND 59 AND p1 + j BETWEEN 0 AND 39")
def d8(spark, d):
    g = grid(spark)
    return D.image_by_task(g, ["p0", "p1"], tiles(g), g.select("p0", "p1"), _neighbours).df


@query("d9_preimage_2d", TILED + "SELECT t0 // 20 AS color0, t1 // 10 AS color1, p0, p1 FROM g")
def d9_2d(spark, d):
    g = grid(spark)
    return D.preimage(tiles(g), g, ["p0", "p1"], ["t0", "t1"]).df


@query("d10_preimage_boxes", TILED + "SELECT DISTINCT t.color0, t.color1, g.p0, g.p1 FROM g JOIN tiled t ON t.p0 BETWEEN g.lo0 AND g.hi0 AND t.p1 BETWEEN g.lo1 AND g.hi1")
def d10_boxes(spark, d):
    g = grid(spark)
    return D.preimage_range(tiles(g), g, ["p0", "p1"], ["lo0", "lo1"], ["hi0", "hi1"], [4, 4]).df


@query("d12_restriction_2d", "WITH " + GRID + "SELECT c AS color0, e AS color1, p0, p1 FROM g, range(6) t(c), range(4) u(e) WHERE p0 BETWEEN 10 * c - 1 AND 10 * c + 10 AND p1 BETWEEN 10 * e - 2 AND 10 * e + 9")
def d12_2d(spark, d):
    colors = C.grid(spark, (0, 5), (0, 3)).toDF("color0", "color1")
    return D.restriction(grid(spark), ["p0", "p1"], colors, [[10, 0], [0, 10]], ((-1, -2), (10, 9)), ["color0", "color1"]).df


@query("d12_diagonal", "WITH " + GRID + "SELECT c AS color, p0, p1 FROM g, range(12) t(c) WHERE p0 BETWEEN 5 * c - 2 AND 5 * c + 2 AND p1 BETWEEN 3 * c - 1 AND 3 * c + 1")
def d12_diagonal(spark, d):
    return D.restriction(grid(spark), ["p0", "p1"], spark.range(12).toDF("color"), [[5], [3]], ((-2, -1), (2, 1))).df


@query("d13_blockify_2d", "WITH " + GRID + "SELECT floor((p0 - 3) / 8.0)::BIGINT AS color0, floor((p1 - 1) / 16.0)::BIGINT AS color1, count(*) AS volume FROM g GROUP BY ALL")
def d13_2d(spark, d):
    return D.blockify(grid(spark), ["p0", "p1"], [8, 16], [3, 1]).volumes()


BOXES = [(0, 0, 0, 9, 9), (1, 5, 5, 30, 12), (1, 50, 30, 70, 50), (2, 9, 9, 3, 3)]


@query("d14_by_boxes", "WITH " + GRID + "SELECT DISTINCT color, p0, p1 FROM g JOIN (VALUES (0, 0, 0, 9, 9), (1, 5, 5, 30, 12), (1, 50, 30, 70, 50), (2, 9, 9, 3, 3)) t(color, x0, y0, x1, y1) ON p0 BETWEEN x0 AND x1 AND p1 BETWEEN y0 AND y1")
def d14_boxes(spark, d):
    boxes = spark.createDataFrame(BOXES, "color int, x0 long, y0 long, x1 long, y1 long")
    return D.by_ranges(grid(spark), ["p0", "p1"], boxes, [16, 16], "color", ["x0", "y0"], ["x1", "y1"]).df


@query("d15_point_coloring", "SELECT DISTINCT o_orderstatus AS color, c_custkey FROM customer JOIN orders ON c_custkey = (o_custkey * 3) % 2000")
def d15(spark, d):
    coloring = table(spark, d, "orders").select(F.col("o_orderstatus").alias("color"), (F.col("o_custkey") * 3 % 2000).alias("c_custkey"))
    return D.by_points(table(spark, d, "customer"), "c_custkey", coloring).df


def _customer_parts(spark, d):
    c = table(spark, d, "customer")
    return c, [D.by_field(c, ["c_custkey"], f) for f in ("c_nationkey", "c_mktsegment", F.col("c_acctbal") > 0)]


@query("d20_cross_three", "SELECT c_nationkey AS color, c_mktsegment AS color2, c_acctbal > 0 AS color3, count(*) AS volume FROM customer GROUP BY ALL")
def d20_three(spark, d):
    _, (a, b, c) = _customer_parts(spark, d)
    return a.cross(b, c).volumes()


@query("d21_cross_colorings", "SELECT c_mktsegment AS color, CASE c_mktsegment WHEN 'BUILDING' THEN c_custkey % 3 ELSE c_nationkey % 2 END::BIGINT AS color2, c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def d21(spark, d):
    c, (_, segments, _) = _customer_parts(spark, d)
    k = F.col("c_custkey")
    colorings = {"BUILDING": c.select((k % 3).alias("color2"), k), "MACHINERY": c.select((F.col("c_nationkey") % 2).cast("long").alias("color2"), k)}
    return segments.cross_colorings(colorings).df


@query("d22_lists", "SELECT c_mktsegment AS color2, c_nationkey AS left_color, count(*) AS volume FROM customer WHERE c_nationkey IN (2, 3, 5) GROUP BY ALL")
def d22_lists(spark, d):
    _, (a, b, _) = _customer_parts(spark, d)
    return a.slice([2, 3, 5]).duplicate("left_color").cross(b, names=["color2"]).invert().volumes()


@query("d22_colors_of", "SELECT DISTINCT c_nationkey AS color FROM customer WHERE c_acctbal < -900")
def d22_colors_of(spark, d):
    c, (a, _, _) = _customer_parts(spark, d)
    return a.colors_of(c.where("c_acctbal < -900"))


@query("d24_association", "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), o AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT c_custkey, s_suppkey AS partner FROM c LEFT JOIN o USING (k)")
def d24(spark, d):
    return D.association(table(spark, d, "customer"), "c_custkey", table(spark, d, "supplier"), "s_suppkey", "partner")


@query("d24_both_ways", "WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part) SELECT c_custkey, p_partkey AS partner, p_partkey, c_custkey AS back FROM c FULL JOIN o USING (k)")
def d24_both(spark, d):
    return D.association(table(spark, d, "customer"), "c_custkey", table(spark, d, "part"), "p_partkey", "partner", "back")


@query("d26_interfering_2d", "WITH " + GRID + ", h AS (SELECT c AS c0, e AS c1, p0, p1 FROM g, range(6) t(c), range(4) u(e) WHERE p0 BETWEEN 10 * c - 1 AND 10 * c + 10 AND p1 BETWEEN 10 * e - 2 AND 10 * e + 9) SELECT DISTINCT a.c0 AS a0, a.c1 AS a1, b.c0 AS b0, b.c1 AS b1 FROM h a JOIN h b ON a.p0 = b.p0 AND a.p1 = b.p1 WHERE (a.c0, a.c1) < (b.c0, b.c1)")
def d26_2d(spark, d):
    colors = C.grid(spark, (0, 5), (0, 3)).toDF("color0", "color1")
    halo = D.restriction(grid(spark), ["p0", "p1"], colors, [[10, 0], [0, 10]], ((-1, -2), (10, 9)), ["color0", "color1"])
    return halo.interfering().select(F.col("color1.color0").alias("a0"), F.col("color1.color1").alias("a1"), F.col("color2.color0").alias("b0"), F.col("color2.color1").alias("b1"))


@query("d27_multi_region_preimage", "SELECT DISTINCT r_name AS color, pt FROM (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) JOIN (SELECT 'c' || c_custkey AS pt, c_nationkey AS ptr FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey FROM supplier) ON ptr = n_nationkey")
def d27_pre(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    target = D.by_field(n, ["n_nationkey"], "r_name")
    sides = [table(spark, d, t).select(F.concat(F.lit(p), F.col(k)).alias("pt"), F.col(f).alias("ptr")) for t, p, k, f in (("customer", "c", "c_custkey", "c_nationkey"), ("supplier", "s", "s_suppkey", "s_nationkey"))]
    return D.of_regions([D.preimage(target, s, ["pt"], "ptr") for s in sides]).df


@query("j_overlap", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_partkey <= b.p_partkey + b.p_size // 8 AND b.p_partkey <= a.p_partkey + a.p_size // 8 AND a.p_partkey < b.p_partkey")
def j_overlap(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), S.int_div(F.col("p_size"), F.lit(8)).alias("w"))
    a, b = (p.select(F.col("k").alias(x), F.col("k").alias(f"{x}_lo"), (F.col("k") + F.col("w")).alias(f"{x}_hi")) for x in "ab")
    return ranges_overlap(a, b, "a_lo", "a_hi", "b_lo", "b_hi", 8).where("a < b").select("a", "b")


@query("j_overlap_boxes", "WITH " + GRID + "SELECT count(*) AS pairs FROM g a JOIN g b ON a.lo0 <= b.hi0 AND b.lo0 <= a.hi0 AND a.lo1 <= b.hi1 AND b.lo1 <= a.hi1 AND a.lo0 <= a.hi0 AND b.lo0 <= b.hi0")
def j_boxes(spark, d):
    g = grid(spark)
    a, b = (g.select(*[F.col(c).alias(f"{x}_{c}") for c in ("lo0", "lo1", "hi0", "hi1")]) for x in "ab")
    names = [[f"{x}_{c}{k}" for k in (0, 1)] for x in "ab" for c in ("lo", "hi")]
    return ranges_overlap(a, b, *names, [4, 4]).agg(F.count("*").alias("pairs"))


@query("p7_points", "WITH " + GRID + "SELECT p0, p1, p0 + t0 AS x, p1 * t1 AS y, greatest(p0, t0) AS mx, p0 <= t0 AND p1 <= t1 AS below, (p0 + t0 - 5 + 10) % 10 + 5 AS wx, (p1 + t1 - 2 + 7) % 7 + 2 AS wy, greatest(hi0 - lo0 + 1, 0) * greatest(hi1 - lo1 + 1, 0) AS volume FROM g")
def p7_points(spark, d):
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    p, t, lo, hi = point("p0", "p1"), point("t0", "t1"), point("lo0", "lo1"), point("hi0", "hi1")
    g = grid(spark)
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    total, wrapped = S.point_op(p, t, "+"), S.point_wrap(S.point_op(p, t, "+"), at(5, 2), at(14, 8))
    return g.select("p0", "p1", total["x"].alias("x"), S.point_op(p, t, "*")["y"].alias("y"), S.point_op(p, t, "max")["x"].alias("mx"), S.point_op(p, t, "<=").alias("below"), wrapped["x"].alias("wx"), wrapped["y"].alias("wy"), S.rect_volume(lo, hi).alias("volume"))


@query("p16_tighten", "SELECT min(o_orderkey) AS lo0, max(o_orderkey) AS hi0, min(o_custkey) AS lo1, max(o_custkey) AS hi1, count(*) AS volume FROM orders WHERE o_orderstatus = 'P'")
def p16(spark, d):
    return D.tighten(table(spark, d, "orders").where("o_orderstatus = 'P'"), ["o_orderkey", "o_custkey"])


@query("p17_covering_boxes", "WITH p AS (SELECT DISTINCT o_orderkey AS x, o_custkey AS y FROM orders), b AS (SELECT min(x) AS x0, max(x) - min(x) + 1 AS dx, min(y) AS y0, max(y) - min(y) + 1 AS dy FROM p) SELECT min(x) AS lo0, max(x) AS hi0, min(y) AS lo1, max(y) AS hi1, count(*) AS volume FROM p, b GROUP BY (x - x0) * 4 // dx, (y - y0) * 4 // dy HAVING (SELECT count(DISTINCT ((x - x0) * 4 // dx, (y - y0) * 4 // dy)) FROM p, b) <= 16")
def p17_boxes(spark, d):
    return D.covering_boxes(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], 16)


@query("s2_space_of_rects", "SELECT DISTINCT x AS p0, y AS p1 FROM (VALUES (0, 0, 9, 9), (5, 5, 30, 12), (9, 9, 3, 3)) t(x0, y0, x1, y1), range(40) u(x), range(20) v(y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def s2_rects(spark, d):
    return C.space_of_rects(spark, [((0, 0), (9, 9)), ((5, 5), (30, 12)), ((9, 9), (3, 3))])


@query("s3_region", "SELECT a AS p0, b AS p1, CAST(NULL AS DOUBLE) AS x, 7::BIGINT AS y FROM range(30) t(a), range(20) u(b)")
def s3(spark, d):
    return C.fill(C.region(C.grid(spark, (0, 29), (0, 19)), {"x": "double", "y": "long"}), "y", F.lit(7).cast("long"))


@query("s12_rects", "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS run FROM orders WHERE o_orderstatus <> 'P') GROUP BY run")
def s12(spark, d):
    return D.rects(table(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderkey")


@query("u5_constraints", "SELECT o_orderkey, o_custkey FROM orders")
def u5(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    pointed = D.subset(o.select(F.col("o_custkey").alias("c_custkey")), c, ["c_custkey"])
    split = D.apart(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ["o_orderkey"])
    return D.constrained(o.select("o_orderkey", "o_custkey"), pointed, split)


@query("c6_affine_gather", "SELECT o.o_orderkey, c.c_acctbal AS f FROM orders o LEFT JOIN customer c ON c.c_custkey = 2 * o.o_orderkey + 3")
def c6(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return C.gather_affine(o, ["o_orderkey"], [[2]], [3], table(spark, d, "customer"), ["c_custkey"], {"c_acctbal": "f"})


@query("o1_sorted", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def o1(spark, d):
    return numbered(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "place").orderBy("place")


@query("o2_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("o3_many_spaces", """WITH a AS (SELECT c_custkey AS pt FROM customer WHERE c_nationkey < 15), b AS (SELECT c_custkey AS pt FROM customer WHERE c_acctbal > 0), c AS (SELECT o_custkey AS pt FROM orders)
SELECT pt, 'all' AS what FROM (SELECT pt FROM a INTERSECT SELECT pt FROM b INTERSECT SELECT pt FROM c) UNION ALL SELECT pt, 'any' FROM (SELECT pt FROM a UNION SELECT pt FROM b UNION SELECT pt FROM c) UNION ALL SELECT pt, 'less' FROM (SELECT pt FROM a EXCEPT SELECT pt FROM b EXCEPT SELECT pt FROM c)""")
def o3_many(spark, d):
    c = table(spark, d, "customer")
    spaces = [c.where("c_nationkey < 15").select(F.col("c_custkey").alias("pt")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("pt")), table(spark, d, "orders").select(F.col("o_custkey").alias("pt"))]
    found = {"all": C.intersection_of(spaces, ["pt"]), "any": C.union_of(spaces, ["pt"]), "less": C.subtraction_of(spaces[0], spaces[1:], ["pt"])}
    rows = [x.withColumn("what", F.lit(n)) for n, x in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("p15_contains_any", "SELECT (SELECT count(*) > 0 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT c_custkey FROM customer)) AS contains_any")
def p15_any(spark, d):
    return C.contains_any(table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("pt")), table(spark, d, "customer").select(F.col("c_custkey").alias("pt")), ["pt"])
