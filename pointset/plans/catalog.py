"""The queries of the engine on the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointset.functions import reductions as R
from pointset.functions import scalar as S
from pointset.operators import intervals as L
from pointset.operators import iterative as G
from pointset.operators import launch as U
from pointset.operators import partition as D
from pointset.operators import region as C
from pointset.operators import scan as W
from pointset.plans.registry import QUERIES, RECORDS, SQL, cents, checkpoints, query, table
from pointset.plans.registry import records as _records
from pointset.sources import tables as T


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


PRICE_SQL = "sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) / 10000.0"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    net = (F.sum(cents("l_extendedprice") * (100 - cents("l_discount"))) / 10000.0).alias("revenue")
    return rows.groupBy(F.col("l_returnflag").alias("color")).agg(net, F.count("*").alias("volume"))


query("a1_flagship", f"SELECT l_returnflag AS color, CAST({PRICE_SQL} AS DOUBLE) AS revenue, count(*) AS volume FROM lineitem GROUP BY 1")(flagship)


# index spaces, fills, sources
@query("s1_grid", "SELECT a AS p0, b AS p1 FROM range(-3, 40) t(a), range(0, 25) u(b)")
def s1(spark, d):
    return C.grid(spark, (-3, 39), (0, 24))


@query("s2_space_of_ranges", "SELECT DISTINCT unnest(range(lo, hi + 1)) AS pt FROM (VALUES (0, 99), (50, 149), (300, 320)) t(lo, hi)")
def s2(spark, d):
    return C.space_of_ranges(spark, [(0, 99), (50, 149), (300, 320), (9, 5)])


@query("s6_field_map", "SELECT o_orderkey AS pt, o_custkey AS owner FROM orders")
def s6(spark, d):
    return T.attach_table(spark, f"{d}/orders.parquet", {"o_orderkey": "pt", "o_custkey": "owner"})


@query("s9_fill", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def s9(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return C.fill(c, "c_acctbal", F.lit(0.0), ["c_custkey"], c.where("c_mktsegment = 'BUILDING'")).drop("c_mktsegment")


@query("s10_discard", "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS n_name FROM nation")
def s10(spark, d):
    return C.discard(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_name")


@query("s13_csr_edges", "SELECT c_custkey AS src, o_orderkey AS dst FROM customer JOIN orders ON c_custkey = o_custkey")
def s13(spark, d):
    customers, orders = table(spark, d, "customer").select(F.col("c_custkey").alias("src")), table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    degree = customers.join(orders.groupBy("src").agg(F.count("*").alias("n")), "src", "left").fillna(0)
    offsets = W.prefix_scan(degree, [], "src", "n", "sum", "upto").select("src", (F.col("upto") - F.col("n")).alias("first"))
    place = orders.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).join(offsets, "src")
    return T.edges_from_offsets(offsets, place.select((F.col("first") + F.col("k")).alias("place"), "dst"))


@query("s17_printed", "SELECT printf('%05d:%s', n_nationkey, n_name) AS line FROM nation")
def s17(spark, d):
    return table(spark, d, "nation").select(T.printed("%05d:%s", F.col("n_nationkey"), F.col("n_name")).alias("line"))


# projection, filters, scalar expressions
@query("p1_field_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def p1(spark, d):
    packed = table(spark, d, "orders").select("o_orderkey", F.struct("o_totalprice", "o_orderstatus").alias("r"))
    return packed.where("r.o_orderstatus = 'F'").select("o_orderkey", "r.o_totalprice")


@query("p2_arithmetic", "SELECT o_orderkey, o_custkey - 700 AS shifted, CAST(trunc((o_custkey - 700) / 7.0) AS BIGINT) AS quotient, (o_custkey - 700) % 7 AS remainder, -o_custkey AS negative, 3 * o_custkey + 1 AS sums FROM orders")
def p2(spark, d):
    x = F.col("o_custkey") - 700
    return table(spark, d, "orders").select("o_orderkey", x.alias("shifted"), S.int_div(x, F.lit(7)).alias("quotient"), (x % 7).alias("remainder"), (-F.col("o_custkey")).alias("negative"), (F.col("o_custkey") * 3 + 1).alias("sums"))


@query("p4_logic", "SELECT count(*) FILTER (o_orderstatus = 'F' AND NOT o_totalprice > 100000) AS a, count(*) FILTER (o_orderstatus = 'O' OR o_totalprice <= 5000) AS b, count(*) FILTER (o_totalprice <> 0) AS c FROM orders")
def p4(spark, d):
    f, p = F.col("o_orderstatus"), F.col("o_totalprice")
    n = lambda c: F.count(F.when(c, 1))
    return table(spark, d, "orders").agg(n((f == "F") & ~(p > 100000)).alias("a"), n((f == "O") | (p <= 5000)).alias("b"), n(p != 0).alias("c"))


@query("p5_bitwise", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 9 AS o, xor(p_partkey, 5) AS x, p_partkey << 3 AS l, p_partkey >> 2 AS r FROM part")
def p5(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", k.bitwiseAND(12).alias("a"), k.bitwiseOR(9).alias("o"), k.bitwiseXOR(5).alias("x"), F.shiftleft(k, 3).alias("l"), F.shiftright(k, 2).alias("r"))


@query("p6_max_min_nan", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE greatest(p_retailprice, 1200.0) END AS big, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE least(p_retailprice, 1200.0) END AS small FROM part")
def p6(spark, d):
    other = F.when(F.col("p_partkey") % 3 == 0, F.lit(float("nan"))).otherwise(1200.0)
    return table(spark, d, "part").select("p_partkey", S.max2(F.col("p_retailprice"), other).alias("big"), S.min2(other, F.col("p_retailprice")).alias("small"))


@query("p7_wrap", "SELECT c_custkey, (c_custkey + 3 - 10 + 50) % 50 + 10 AS wrapped, least(greatest(c_custkey, 10), 59) AS clamped FROM customer")
def p7(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", S.wrap(k + 3, F.lit(10), F.lit(59)).alias("wrapped"), F.least(F.greatest(k, F.lit(10)), F.lit(59)).alias("clamped"))


@query("p8_deref", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def p8(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey).select("o_orderkey", "c_mktsegment", "n_name")


@query("p10_dynamic_cast", "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN o_custkey END AS ptr FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def p10(spark, d):
    inside = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(spark, d, "orders").join(inside, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.when(F.col("c_custkey").isNotNull(), F.col("o_custkey")).alias("ptr"))


@query("p12_branches", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def p12(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(p > 200000, "high").when(p > 50000, "mid").otherwise("low").alias("band"))


@query("p13_predicated", "SELECT s_suppkey, CASE WHEN (SELECT count(*) > 10 FROM supplier WHERE s_acctbal < 0) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def p13(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return U.predicated(s, s.agg((F.count(F.when(F.col("s_acctbal") < 0, 1)) > 10).alias("many")), "many", "s_acctbal", F.lit(0.0))


@query("p14_filter", "SELECT e.event_id, e.user_id FROM events e WHERE event_type = 'click' AND value > 10")
def p14(spark, d):
    return table(spark, d, "events").where("event_type = 'click' and value > 10").select("event_id", "user_id")


@query("p15_bounds", "SELECT count(*) AS volume, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) = max(o_orderkey) - min(o_orderkey) + 1 AS dense, bool_or(o_orderkey = 17) AS has_17 FROM orders WHERE o_orderstatus <> 'P'")
def p15(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where("o_orderstatus <> 'P'").agg(F.count("*").alias("volume"), F.min(k).alias("lo"), F.max(k).alias("hi"), (F.count("*") == F.max(k) - F.min(k) + 1).alias("dense"), F.bool_or(k == 17).alias("has_17"))


@query("p17_covering", """
WITH g AS (SELECT o_orderkey AS hi, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS lo FROM orders WHERE o_orderstatus = 'P'),
cut AS (SELECT hi, lo FROM g WHERE lo - hi > 1 ORDER BY lo - hi DESC, hi LIMIT 9),
los AS (SELECT lo, row_number() OVER (ORDER BY lo) AS k FROM (SELECT lo FROM cut UNION ALL SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')),
his AS (SELECT hi, row_number() OVER (ORDER BY hi) AS k FROM (SELECT hi FROM cut UNION ALL SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'P'))
SELECT lo, hi FROM los JOIN his USING (k)""")
def p17(spark, d):
    return D.covering(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", 10)


@query("p18_affine", "SELECT a, b, 2 * a - b + 5 AS y0, a + 3 * b AS y1 FROM range(30) t(a), range(20) u(b)")
def p18(spark, d):
    g = C.grid(spark, (0, 29), (0, 19)).withColumnsRenamed({"p0": "a", "p1": "b"})
    y = S.affine([F.col("a"), F.col("b")], [[2, -1], [1, 3]], [5, 0])
    return g.select("a", "b", y[0].alias("y0"), y[1].alias("y1"))


@query("p19_rects", "SELECT p_partkey, greatest(p_partkey, 100) AS lo, least(p_partkey + p_size, 140) AS hi, least(p_partkey, 100) AS hull_lo, greatest(p_partkey + p_size, 140) AS hull_hi FROM part WHERE greatest(p_partkey, 100) <= least(p_partkey + p_size, 140)")
def p19(spark, d):
    a, b = F.col("p_partkey"), F.col("p_partkey") + F.col("p_size")
    lo, hi = S.rect_overlap(a, b, F.lit(100), F.lit(140))
    hull = S.rect_hull(a, b, F.lit(100), F.lit(140))
    return table(spark, d, "part").select("p_partkey", lo.alias("lo"), hi.alias("hi"), hull[0].alias("hull_lo"), hull[1].alias("hull_hi")).where("lo <= hi")


@query("p20_projection_functor", "SELECT i, count(*) AS volume FROM range(25) t(i) JOIN customer ON c_nationkey = (7 * i + 3) % 25 GROUP BY i")
def p20(spark, d):
    launch = spark.range(25).select(F.col("id").alias("i"), ((F.col("id") * 7 + 3) % 25).alias("color"))
    p = D.by_field(table(spark, d, "customer"), ["c_custkey"], "c_nationkey")
    return launch.join(p.df, "color").groupBy("i").agg(F.count("*").alias("volume"))


@query("p_math", "SELECT p_partkey, round(sin(p_retailprice), 6) AS a, round(exp(p_size / 50.0), 6) AS b, round(atan2(p_size, p_retailprice), 8) AS c, round(cbrt(p_retailprice), 6) AS d, floor(log2(p_size))::INTEGER AS e, round(power(p_size, -0.5), 8) AS f, round(p_retailprice * p_size + 1.5, 4) AS g, greatest(p_size - 20.5, 0.0) AS h FROM part")
def p_math(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(F.sin(p), 6).alias("a"), F.round(F.exp(s / 50.0), 6).alias("b"), F.round(F.atan2(s, p), 8).alias("c"), F.round(F.cbrt(p), 6).alias("d"), S.COMPOSED["ilogb"](s).alias("e"), F.round(S.COMPOSED["rsqrt"](s), 8).alias("f"), F.round(S.COMPOSED["fma"](p, s, F.lit(1.5)), 4).alias("g"), S.COMPOSED["fdim"](s.cast("double"), F.lit(20.5)).alias("h"))


@query("p_special", "SELECT p_partkey, round(lgamma(p_size), 6) AS lg, round(gamma(p_size / 10.0), 5) AS tg FROM part")
def p_special(spark, d):
    s = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", F.round(S.special("lgamma", s), 6).alias("lg"), F.round(S.special("tgamma", s / 10), 5).alias("tg"))


# partitions
def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")


@query("d1_equal", "SELECT floor(((c_custkey - lo + 1) * 7 - 1) / t)::BIGINT AS color, count(*) AS volume FROM customer, (SELECT min(c_custkey) lo, max(c_custkey) - min(c_custkey) + 1 AS t FROM customer) GROUP BY 1")
def d1(spark, d):
    return D.equal(table(spark, d, "customer"), "c_custkey", 7).volumes()


@query("d1_equal_sparse", "SELECT floor((r * 4 - 1) / t)::BIGINT AS color, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS t FROM orders WHERE o_orderstatus = 'P')")
def d1s(spark, d):
    return D.equal_sparse(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", 4).df


@query("d1b_equal_blocks", "SELECT floor(a / 12.0)::BIGINT AS color0, floor(b / 4.0)::BIGINT AS color1, count(*) AS volume FROM range(45) t(a), range(10) u(b) GROUP BY ALL")
def d1b(spark, d):
    return D.equal_blocks(C.grid(spark, (0, 44), (0, 9)), ["p0", "p1"], [4, 3]).volumes()


@query("d2_weights", "SELECT CASE WHEN o_orderkey < floor(t * 1 / 8) THEN 0 WHEN o_orderkey < floor(t * 3 / 8) THEN 1 ELSE 2 END::BIGINT AS color, count(*) AS volume FROM orders, (SELECT max(o_orderkey) + 1 AS t FROM orders) GROUP BY 1")
def d2(spark, d):
    return D.by_weights(table(spark, d, "orders"), "o_orderkey", spark.createDataFrame([(0, 1), (1, 2), (2, 5)], "color long, weight long")).volumes()


@query("d3_by_field", "SELECT c_nationkey AS color, count(*) AS volume FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1")
def d3(spark, d):
    return D.by_field(_customers(spark, d), ["c_custkey"], "c_nationkey", table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("color"))).volumes()


@query("d3b_by_function", "SELECT c_nationkey % 4 AS color, c_custkey FROM customer")
def d3b(spark, d):
    return D.by_field(_customers(spark, d), ["c_custkey"], F.col("c_nationkey") % 4).df


def _orders_by_status(spark, d):
    return D.by_field(table(spark, d, "orders"), ["o_orderkey"], "o_orderstatus")


@query("d4_image", "SELECT DISTINCT o_orderstatus AS color, o_custkey AS c_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def d4(spark, d):
    return D.image(_customers(spark, d), "c_custkey", _orders_by_status(spark, d), table(spark, d, "orders"), "o_custkey").df


@query("d5_image_range", "SELECT DISTINCT o_orderstatus AS color, p_partkey FROM orders JOIN part ON p_partkey BETWEEN o_custkey AND o_custkey + 4")
def d5(spark, d):
    return D.image_range(table(spark, d, "part"), "p_partkey", _orders_by_status(spark, d), table(spark, d, "orders"), "o_custkey", F.col("o_custkey") + 4, 8).df


@query("d6_structured_image", "SELECT DISTINCT o_orderstatus AS color, (o_orderkey * 2 + 1) AS o_orderkey FROM orders WHERE o_orderkey * 2 + 1 IN (SELECT o_orderkey FROM orders)")
def d6(spark, d):
    o = table(spark, d, "orders")
    moved = D.image(o.select(F.col("o_orderkey").alias("__to")), "__to", _orders_by_status(spark, d), o, F.col("o_orderkey") * 2 + 1)
    return moved.df.withColumnRenamed("__to", "o_orderkey")


@query("d7_image_difference", "SELECT DISTINCT o_orderstatus AS color, o_custkey AS c_custkey FROM orders EXCEPT SELECT 'F', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def d7(spark, d):
    c = _customers(spark, d)
    without = D.Partition(c.where("c_mktsegment = 'BUILDING'").select(F.lit("F").alias("color"), "c_custkey"), ["color"], ["c_custkey"])
    return D.image_with_difference(c, "c_custkey", _orders_by_status(spark, d), table(spark, d, "orders"), "o_custkey", without).df


@query("d9_preimage", "SELECT c_mktsegment AS color, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey")
def d9(spark, d):
    return D.preimage(D.by_field(_customers(spark, d), ["c_custkey"], "c_mktsegment"), table(spark, d, "orders"), ["o_orderkey"], "o_custkey").df


@query("d10_preimage_range", "SELECT DISTINCT p_brand AS color, o_orderkey FROM orders JOIN part ON p_partkey BETWEEN o_custkey AND o_custkey + 2")
def d10(spark, d):
    target = D.by_field(table(spark, d, "part"), ["p_partkey"], "p_brand")
    return D.preimage_range(target, table(spark, d, "orders"), ["o_orderkey"], "o_custkey", F.col("o_custkey") + 2, 4).df


@query("d11_structured_preimage", "SELECT c_mktsegment AS color, o_orderkey FROM orders JOIN customer ON (o_orderkey * 3) % 1000 = c_custkey")
def d11(spark, d):
    return D.preimage(D.by_field(_customers(spark, d), ["c_custkey"], "c_mktsegment"), table(spark, d, "orders"), ["o_orderkey"], F.col("o_orderkey") * 3 % 1000).df


@query("d12_restriction", "SELECT c AS color, p_partkey FROM range(40) t(c) JOIN part ON p_partkey BETWEEN c * 50 - 2 AND c * 50 + 51")
def d12(spark, d):
    return D.restriction(table(spark, d, "part"), "p_partkey", spark.range(40).toDF("color"), 50, (-2, 51)).df


@query("d13_blockify", "SELECT floor((o_orderkey - 5) / 1000.0)::BIGINT AS color, count(*) AS volume FROM orders GROUP BY 1")
def d13(spark, d):
    return D.blockify(table(spark, d, "orders"), "o_orderkey", 1000, 5).volumes()


@query("d14_by_domain", "SELECT DISTINCT color, p_partkey FROM (VALUES (0, 0, 99), (1, 50, 149), (1, 400, 450), (2, 9, 3)) t(color, lo, hi) JOIN part ON p_partkey BETWEEN lo AND hi")
def d14(spark, d):
    return D.by_ranges(table(spark, d, "part"), "p_partkey", spark.createDataFrame([(0, 0, 99), (1, 50, 149), (1, 400, 450), (2, 9, 3)], "color int, lo long, hi long"), 64).df


def _two(spark, d):
    """Two partitions of all customers with colors of one scale, by nation and by balance."""
    c = table(spark, d, "customer")
    return D.by_field(c, ["c_custkey"], F.col("c_nationkey").cast("long")), D.by_field(c, ["c_custkey"], F.pmod(F.floor(F.col("c_acctbal") / 400), F.lit(25)))


TWO = "WITH a AS (SELECT c_nationkey::BIGINT AS color, c_custkey FROM customer), b AS (SELECT ((floor(c_acctbal / 400)::BIGINT % 25) + 25) % 25 AS color, c_custkey FROM customer) "


@query("d16_union", TWO + "SELECT * FROM a UNION SELECT * FROM b")
def d16(spark, d):
    a, b = _two(spark, d)
    return a.union(b).df


@query("d17_intersection", TWO + "SELECT * FROM a INTERSECT SELECT * FROM b")
def d17(spark, d):
    a, b = _two(spark, d)
    return a.intersect(b).df


@query("d18_difference", TWO + "SELECT * FROM a EXCEPT SELECT * FROM b")
def d18(spark, d):
    a, b = _two(spark, d)
    return a.minus(b).df


@query("d19_mirror", "SELECT c_nationkey::BIGINT AS color, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def d19(spark, d):
    return _two(spark, d)[0].mirror(_customers(spark, d).where("c_mktsegment = 'BUILDING'")).df


@query("d20_cross", "SELECT c_nationkey AS color, c_mktsegment AS color2, count(*) AS volume FROM customer GROUP BY ALL")
def d20(spark, d):
    c = _customers(spark, d)
    return D.by_field(c, ["c_custkey"], "c_nationkey").cross(D.by_field(c, ["c_custkey"], "c_mktsegment")).volumes()


@query("d22_cross_list", "SELECT DISTINCT c_nationkey AS color, c_mktsegment AS color2 FROM customer WHERE c_nationkey IN (1, 4, 9)")
def d22(spark, d):
    c = _customers(spark, d)
    return D.by_field(c, ["c_custkey"], "c_nationkey").slice([1, 4, 9]).cross(D.by_field(c, ["c_custkey"], "c_mktsegment")).colors()


@query("d23_pending", "SELECT 0 AS color, c_custkey FROM customer WHERE c_nationkey = 1 OR c_mktsegment = 'BUILDING' UNION ALL SELECT 1, c_custkey FROM customer WHERE c_nationkey = 1 AND c_mktsegment = 'BUILDING' UNION ALL SELECT 2, c_custkey FROM customer WHERE c_nationkey = 1 AND c_mktsegment <> 'BUILDING'")
def d23(spark, d):
    c = _customers(spark, d)
    a, b = c.where("c_nationkey = 1").select("c_custkey"), c.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return D.pending({0: a.union(b), 1: a.intersect(b), 2: a.subtract(b)}, ["c_custkey"]).df


@query("d25_kinds", "SELECT false AS disjoint, (SELECT count(*) = 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS complete")
def d25(spark, d):
    c = _customers(spark, d)
    return D.image(c, "c_custkey", _orders_by_status(spark, d), table(spark, d, "orders"), "o_custkey").kinds(c)


@query("d26_interfering", "SELECT DISTINCT a.o_orderstatus AS color1, b.o_orderstatus AS color2 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus < b.o_orderstatus")
def d26(spark, d):
    return D.image(_customers(spark, d), "c_custkey", _orders_by_status(spark, d), table(spark, d, "orders"), "o_custkey").interfering()


@query("d27_multi_region_image", "SELECT DISTINCT s AS color, k AS n_nationkey FROM (SELECT 'c' AS s, c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 's', s_nationkey FROM supplier WHERE s_acctbal < 0)")
def d27(spark, d):
    both = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("pt"), F.lit("c").alias("s"), F.col("c_nationkey").alias("ptr")).unionByName(table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("pt"), F.lit("s").alias("s"), F.col("s_nationkey").alias("ptr")))
    return D.image(table(spark, d, "nation"), "n_nationkey", D.by_field(both, ["pt"], "s"), both, "ptr").df


# copies
@query("c1_copy", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey ELSE -1 END AS f FROM customer")
def c1(spark, d):
    c = table(spark, d, "customer")
    return C.copy(c.select("c_custkey", F.lit(-1).alias("f")), c.where("c_mktsegment = 'BUILDING'"), ["c_custkey"], {"c_nationkey": "f"})


@query("c2_gather", "SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def c2(spark, d):
    return C.gather(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer"), "c_custkey", {"c_acctbal": "c_acctbal"}).drop("o_custkey")


@query("c3_scatter", "SELECT c_custkey, k AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def c3(spark, d):
    return C.scatter(table(spark, d, "customer").select("c_custkey", F.lit(None).cast("long").alias("last_order")), "c_custkey", table(spark, d, "orders"), "o_custkey", "o_orderkey", "last_order", "o_orderkey")


@query("c4_gather_scatter", "SELECT n_nationkey, m AS best FROM nation LEFT JOIN (SELECT c_nationkey, max(o_orderkey) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) ON n_nationkey = c_nationkey")
def c4(spark, d):
    o = C.gather(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, d, "customer"), "c_custkey", {"c_nationkey": "to"})
    return C.scatter(table(spark, d, "nation").select("n_nationkey", F.lit(None).cast("long").alias("best")), "n_nationkey", o, "to", "o_orderkey", "best", "o_orderkey")


@query("c5_range_gather", "SELECT o_orderkey, sum(p_size)::BIGINT AS total FROM orders JOIN part ON p_partkey BETWEEN o_custkey AND o_custkey + 3 GROUP BY 1")
def c5(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + 3).alias("hi"))
    return C.gather_ranges(r, "lo", "hi", table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").groupBy("o_orderkey").agg(F.sum("p_size").alias("total"))


@query("c7_reduction_copy", "SELECT o_orderkey, 5 + coalesce(q, 0) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def c7(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).cast("long").alias("one"))
    return C.reduction_copy(table(spark, d, "orders").select("o_orderkey", F.lit(5).cast("long").alias("n")), li, ["o_orderkey"], "one", "n", "sum", "long")


@query("c8_scatter_reduce", "SELECT o_orderkey, coalesce(q, 0) AS q FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_linenumber)::BIGINT AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def c8(spark, d):
    return C.scatter_reduce(table(spark, d, "orders").select("o_orderkey", F.lit(0).cast("long").alias("q")), "o_orderkey", table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "q", "sum", "long")


@query("c9_index_copy", "SELECT c_nationkey AS color, c_custkey, c_acctbal AS f FROM customer")
def c9(spark, d):
    c = table(spark, d, "customer")
    p = D.by_field(c, ["c_custkey"], "c_nationkey")
    return C.copy(p.df, p.of(c.select("c_custkey", "c_acctbal")), ["color", "c_custkey"], {"c_acctbal": "f"})


@query("c10_transpose", "SELECT b AS p0, a AS p1, a * 10 + b AS v FROM range(20) t(a), range(10) u(b)")
def c10(spark, d):
    return C.transpose(C.grid(spark, (0, 19), (0, 9)).withColumn("v", F.col("p0") * 10 + F.col("p1")), "p0", "p1")


# reductions
@query("a1_to_a9_long", """SELECT c_nationkey AS color, sum(c_custkey)::BIGINT AS s, (1000 - sum(c_custkey))::BIGINT AS df, max(c_custkey) AS mx, min(c_custkey) AS mn, bit_or(c_custkey) AS o, bit_and(c_custkey) AS a, bit_xor(c_custkey) AS x, count(*) AS n FROM customer GROUP BY 1""")
def a_long(spark, d):
    k = F.col("c_custkey")
    r = lambda op, name, **m: R.reduce(op, k, "long", **m).alias(name)
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("color")).agg(r("sum", "s"), r("diff", "df", initial=F.lit(1000)), r("max", "mx"), r("min", "mn"), r("or", "o"), r("and", "a"), r("xor", "x"), F.count("*").alias("n"))


@query("a3_prod", "SELECT l_orderkey AS color, product(l_linenumber)::BIGINT AS p FROM lineitem GROUP BY 1")
def a3(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("color"), F.col("l_linenumber").cast("long").alias("p"))
    product = lambda part: part.groupby("color", as_index=False)["p"].prod()
    return U.reduce_by_task(rows, ["color"], product, product, "p long")


@query("a3_prod_double", "SELECT o_custkey AS color, round(product(1 + o_orderkey % 7 / 10.0), 6)::DOUBLE AS p FROM orders GROUP BY 1")
def a3d(spark, d):
    x = 1 + F.col("o_orderkey") % 7 / 10.0
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("color")).agg(F.round(R.reduce("prod", x), 6).alias("p"))


@query("a4_div", "SELECT o_custkey AS color, trunc(1000000000000 / product(o_orderkey % 3 + 1)::DOUBLE)::BIGINT AS whole, round(1000.0 / product(1 + o_orderkey % 5 / 100.0), 6)::DOUBLE AS part FROM orders GROUP BY 1")
def a4(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("color")).agg(R.reduce("div", k % 3 + 1, "long", F.lit(1_000_000_000_000)).alias("whole"), F.round(R.reduce("div", 1 + k % 5 / 100.0, "double", F.lit(1000.0)), 6).alias("part"))


@query("a5_nan", "SELECT c_nationkey AS color, max(c_acctbal) AS mx, min(c_acctbal) AS mn FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def a5(spark, d):
    x = F.when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("color")).agg(R.reduce("max", x).alias("mx"), R.reduce("min", x).alias("mn"))


@query("a7_boolean", "SELECT c_nationkey AS color, bool_or(c_acctbal > 9900) AS o, bool_and(c_acctbal > -900) AS a, sum((c_acctbal > 0)::INT) % 2 = 1 AS x FROM customer GROUP BY 1")
def a7(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("color")).agg(R.reduce("or", b > 9900, "boolean").alias("o"), R.reduce("and", b > -900, "boolean").alias("a"), R.reduce("xor", b > 0, "boolean").alias("x"))


def _energy(part):
    part = part.assign(energy=part["energy"] if "energy" in part else part["x"] ** 2, top=part["top"] if "top" in part else part["x"])
    return part.groupby("color", as_index=False).agg(energy=("energy", "sum"), top=("top", "max"))


@query("a10_user_reduction", "SELECT l_suppkey AS color, sum(l_linenumber * l_linenumber)::BIGINT AS energy, max(l_linenumber)::BIGINT AS top FROM lineitem GROUP BY 1")
def a10(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("color"), F.col("l_linenumber").cast("long").alias("x"))
    return U.reduce_by_task(rows, ["color"], _energy, _energy, "energy long, top long")


@query("a12_reduce_futures", "SELECT max(n) AS value FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def a12(spark, d):
    fm = U.index_launch(D.by_field(table(spark, d, "orders"), ["o_orderkey"], "o_custkey"), table(spark, d, "orders").select("o_orderkey"), F.count("*").alias("n"))
    return U.reduce_futures(fm, "n", "max", "long")


@query("a12_ordered", "SELECT string_agg(r_name, '' ORDER BY r_regionkey) AS value FROM region")
def a12o(spark, d):
    return U.ordered_concat(table(spark, d, "region"), "r_name", "r_regionkey")


@query("a15_all_reduce", "SELECT s_suppkey, (SELECT max(s_acctbal) FROM supplier) AS top FROM supplier")
def a15(spark, d):
    return U.all_reduce(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "max", "top").drop("s_acctbal")


# scans and stencils
for _op in ("sum", "min", "max"):
    for _forward in (True, False):

        def _scan(spark, d, op=_op, forward=_forward):
            e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 1001).alias("v"))
            return W.prefix_scan(e, ["user_id"], "event_id", "v", op, "s", forward).drop("v")

        _sql = f"SELECT user_id, event_id, CAST({_op}(v) OVER (PARTITION BY user_id ORDER BY event_id {'' if _forward else 'DESC'} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM (SELECT user_id, event_id, event_id * 7919 % 1001 AS v FROM events)"
        query(f"w1_scan_{_op}_{'forward' if _forward else 'backward'}", _sql)(_scan)


@query("w1_scan_global", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM orders")
def w1g(spark, d):
    return W.prefix_scan(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [], "o_orderkey", "o_custkey", "sum", "s").drop("o_custkey")


@query("w2_stencil", "SELECT a.o_orderkey, CAST(p.o_custkey + 2 * a.o_custkey - n.o_custkey AS DOUBLE) AS s FROM orders a JOIN (SELECT count(*) AS t FROM orders) ON true JOIN orders p ON p.o_orderkey = (a.o_orderkey - 1 + t) % t JOIN orders n ON n.o_orderkey = (a.o_orderkey + 1) % t")
def w2(spark, d):
    return W.stencil_1d(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", {-1: 1, 0: 2, 1: -1}, "s", periodic=True).drop("o_custkey")


@query("w2_stencil_2d", """WITH g AS (SELECT a, b, (a * 31 + b * 17) % 101 AS v FROM range(60) t(a), range(40) u(b))
SELECT g.a AS p0, g.b AS p1, CAST(sum(n.v * w) AS DOUBLE) AS s FROM g, (VALUES (0, 1, 1), (0, -1, 1), (1, 0, 1), (-1, 0, 1), (0, 0, -4)) o(da, db, w), g n WHERE n.a = g.a + da AND n.b = g.b + db GROUP BY ALL""")
def w2d(spark, d):
    g = C.grid(spark, (0, 59), (0, 39)).withColumn("v", (F.col("p0") * 31 + F.col("p1") * 17) % 101)
    return W.stencil_nd(g, ["p0", "p1"], "v", [((0, 1), 1), ((0, -1), 1), ((1, 0), 1), ((-1, 0), 1), ((0, 0), -4)], "s").drop("v")


@query("o3_space_algebra", "SELECT c_custkey AS pt, 'i' AS what FROM customer WHERE c_nationkey < 5 AND c_acctbal > 0 UNION ALL SELECT c_custkey, 's' FROM customer WHERE c_nationkey < 5 AND c_acctbal <= 0 UNION ALL SELECT c_custkey, 'u' FROM customer WHERE c_nationkey < 5 OR c_acctbal > 0")
def o3(spark, d):
    a, b = (table(spark, d, "customer").where(w).select(F.col("c_custkey").alias("pt")) for w in ("c_nationkey < 5", "c_acctbal > 0"))
    return a.intersect(b).withColumn("what", F.lit("i")).unionByName(a.subtract(b).withColumn("what", F.lit("s"))).unionByName(a.union(b).distinct().withColumn("what", F.lit("u")))


@query("o4_contained", "SELECT (SELECT count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS contained")
def o4(spark, d):
    return C.contained(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), table(spark, d, "customer"), ["c_custkey"])


# launches
@query("u2_index_launch", "SELECT c_mktsegment AS color, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1")
def u2(spark, d):
    c = table(spark, d, "customer")
    return U.index_launch(D.by_field(c, ["c_custkey"], "c_mktsegment"), c.select("c_custkey", "c_acctbal"), F.count("*").alias("n"), F.max("c_acctbal").alias("top"))


def _median(part):
    return part.groupby("color", as_index=False).agg(mid=("c_acctbal", "median"))


@query("u2_index_task", "SELECT c_nationkey AS color, median(c_acctbal) AS mid FROM customer GROUP BY 1")
def u2t(spark, d):
    c = table(spark, d, "customer")
    return U.index_task(D.by_field(c, ["c_custkey"], "c_nationkey"), c.select("c_custkey", "c_acctbal"), _median, "color int, mid double")


@query("u6_output_region", "SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS pt, c_nationkey AS color, c_custkey FROM customer WHERE c_acctbal > 5000")
def u6(spark, d):
    rows = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("color"), "c_custkey")
    return U.output_region(rows, "color", "c_custkey")


@query("u7_future_map_transform", "SELECT (i % 6) * 4 + i // 6 AS color, n FROM (SELECT o_orderkey % 24 AS i, count(*) AS n FROM orders GROUP BY 1)")
def u7(spark, d):
    fm = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 24).alias("i")).agg(F.count("*").alias("n"))
    return fm.select((F.col("i") % 6 * 4 + F.floor(F.col("i") / 6)).alias("color"), "n")


@query("u8_arguments", "SELECT c_nationkey AS color, sum(c_custkey * n_regionkey)::BIGINT AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def u8(spark, d):
    p = D.by_field(table(spark, d, "customer"), ["c_custkey"], "c_nationkey")
    return U.with_arguments(p, table(spark, d, "nation").select(F.col("n_nationkey").alias("color"), "n_regionkey")).groupBy("color").agg(F.sum(F.col("c_custkey") * F.col("n_regionkey")).alias("v"))


# interval analytics
@query("l2_statistics", "WITH " + RECORDS + "SELECT kind, count(*) AS invocations, sum(stop - start)::BIGINT AS total, sum(stop - start - id % 2)::BIGINT AS running, min(stop - start - id % 2) AS least, max(stop - start - id % 2) AS most, round(avg(stop - start - id % 2), 4) AS mean, round(coalesce(stddev_samp(stop - start - id % 2), 0), 4) AS deviation FROM records GROUP BY 1")
def l2(spark, d):
    r = _records(spark, d)
    waits = r.select("id", F.col("start").alias("wait_start"), (F.col("start") + F.col("id") % 2).alias("wait_end"))
    return L.statistics(r, "kind", waits).withColumn("mean", F.round("mean", 4)).withColumn("deviation", F.round("deviation", 4))


STEP_SQL = "ends AS (SELECT proc, start AS t, 1 AS w FROM records UNION ALL SELECT proc, stop, -1 FROM records), sums AS (SELECT proc, t, sum(w) AS w FROM ends GROUP BY ALL), lev AS (SELECT proc, t, sum(w) OVER (PARTITION BY proc ORDER BY t) AS level FROM sums) "


@query("l3_steps", "WITH " + RECORDS + ", " + STEP_SQL + "SELECT proc, t, level::BIGINT AS level FROM lev")
def l3(spark, d):
    return L.steps(_records(spark, d), ["proc"])


@query("l3_utilization", "WITH " + RECORDS + ", " + STEP_SQL + """, edge AS (SELECT proc, t, CASE WHEN level > 0 THEN 1 ELSE -1 END AS w FROM (SELECT *, lag(level, 1, 0) OVER (PARTITION BY proc ORDER BY t) AS was FROM lev) WHERE (level > 0) <> (was > 0)),
per AS (SELECT proc % 2 AS node, t, sum(w) AS w FROM edge GROUP BY ALL)
SELECT node, t, sum(w) OVER (PARTITION BY node ORDER BY t) / 4.0 AS busy_share FROM per""")
def l3u(spark, d):
    checkpoints(spark)
    r = _records(spark, d).withColumn("node", F.col("proc") % 2)
    return L.utilization(r, ["node"], "proc", r.select("node", "proc").distinct().groupBy("node").agg(F.lit(4.0).alias("n_members")))


@query("l5_resample", "WITH " + RECORDS + """, b AS (SELECT min(start) AS lo, (max(stop) - min(start) + 19) // 20 AS width FROM records)
SELECT proc, bucket, round(sum(least(stop, lo + (bucket + 1) * width) - greatest(start, lo + bucket * width)) / max(width)::DOUBLE, 6) AS mean FROM records, b, range(20) t(bucket) WHERE start < lo + (bucket + 1) * width AND stop > lo + bucket * width GROUP BY ALL""")
def l5(spark, d):
    r = _records(spark, d)
    return L.resample(r, ["proc"], L.span(r), 20).withColumn("mean", F.round("mean", 6))


@query("l6_peak", "WITH " + RECORDS + ", " + STEP_SQL + "SELECT proc, max(level)::BIGINT AS max_levels FROM lev GROUP BY 1")
def l6(spark, d):
    return L.peak(_records(spark, d), ["proc"])


@query("l6_levels")
def l6l(spark, d):
    return L.levels(_records(spark, d), ["proc"], "id")


@query("l7_trim", "WITH " + RECORDS + ", b AS (SELECT min(start) + 100000 AS lo FROM records) SELECT id, greatest(start, lo) AS start, least(stop, lo + 400000) AS stop FROM records, b WHERE start < lo + 400000 AND stop > lo")
def l7(spark, d):
    r = _records(spark, d)
    window = L.span(r).select((F.col("first") + 100000).alias("first"), (F.col("first") + 500000).alias("last"))
    return L.trim(r, window).select("id", "start", "stop")


@query("l8_visible", "WITH " + RECORDS + "SELECT id, proc FROM records WHERE proc IN (1, 4)")
def l8(spark, d):
    return L.visible(_records(spark, d).select("id", "proc"), "proc", spark.createDataFrame([(1,), (4,)], "proc long")).drop("near")


@query("l9_latency", "SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS messages, round(avg(x), 4) AS mean, round(coalesce(var_samp(x), 0), 2) AS variance, round(avg((x > 40)::INT), 6) AS share_over FROM (SELECT *, o_orderkey * 31 % 97 - o_orderkey * 17 % 11 AS x FROM orders) GROUP BY ALL")
def l9(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), (F.col("o_orderkey") * 17 % 11).alias("s"), (F.col("o_orderkey") * 31 % 97).alias("r"))
    out = L.latency(m, "s", "r", ["a", "b"], 40)
    return out.select("a", "b", "messages", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), F.round("share_over", 6).alias("share_over"))


@query("l10_critical_path", """WITH RECURSIVE deps AS (SELECT n_nationkey AS src, n_nationkey * 2 + 1 AS dst FROM nation WHERE n_nationkey * 2 + 1 < 25 UNION ALL SELECT n_nationkey, n_nationkey * 2 + 2 FROM nation WHERE n_nationkey * 2 + 2 < 25 UNION ALL SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey + 1 < 25),
walk AS (SELECT n_nationkey AS id, n_nationkey % 5 + 1 AS finish FROM nation UNION SELECT dst, finish + dst % 5 + 1 FROM walk JOIN deps ON src = id),
best AS (SELECT id, max(finish) AS finish FROM walk GROUP BY 1)
SELECT id::BIGINT AS id, finish::BIGINT AS finish, coalesce((SELECT arg_max(b.id, b.finish * 1000 + b.id) FROM deps JOIN best b ON b.id = src WHERE dst = best.id), id)::BIGINT AS critical FROM best""")
def l10(spark, d):
    checkpoints(spark)
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") % 5 + 1).cast("long").alias("duration"))
    k = F.col("id")
    e = n.select(k.alias("src"), F.explode(F.array_distinct(F.array(k * 2 + 1, k * 2 + 2, k + 1))).alias("dst")).where("dst < 25")
    return L.critical_path(n, e)


@query("l10_order_chains", "SELECT o_orderkey AS id, sum(o_orderkey % 5 + 1) OVER w::BIGINT AS finish, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderkey) AS critical FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def l10o(spark, d):
    checkpoints(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_orderkey") % 5 + 1).alias("duration"))
    e = o.select(F.col("id").alias("src"), F.lead("id").over(Window.partitionBy("o_custkey").orderBy("id")).alias("dst")).where("dst is not null")
    return L.critical_path(o.drop("o_custkey"), e)


@query("l11_executing_at", "WITH " + RECORDS + ", q AS (SELECT min(start) + i * 100003 AS t FROM records, range(40) u(i) GROUP BY i) SELECT t, max_by(id, start * 10000000 + id) AS id FROM q JOIN records ON start <= t AND t < stop GROUP BY t")
def l11(spark, d):
    r = _records(spark, d)
    q = spark.range(40).crossJoin(F.broadcast(r.agg(F.min("start").alias("lo")))).select((F.col("lo") + F.col("id") * 100003).alias("t"))
    return L.executing_at(q, "t", r.select("id", "start", "stop"), 4096)


@query("l13_differences", "SELECT k, a AS left_value, b AS right_value FROM (SELECT o_custkey AS k, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT o_custkey AS k, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (k) WHERE a IS DISTINCT FROM b")
def l13(spark, d):
    a, b = (table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v")) for s in "FO")
    return L.differences(a, b, ["k"], "v")


@query("l14_leaks", "SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN -1 ELSE 0 END)::BIGINT AS open_refs FROM events GROUP BY 1 HAVING open_refs <> 0")
def l14(spark, d):
    v = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    return L.leaks(table(spark, d, "events").withColumn("v", v), ["user_id"], "v")


# iterative workloads
def _trade(spark, d):
    """Nodes, and edges both ways as a checkpoint dealt by src, from which the nodes are read."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    edges = G.dealt(li.unionAll(li.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "src", once=True)
    return edges.select(F.col("src").alias("id")).distinct(), edges


TRADE = "li AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), edges AS (SELECT * FROM li UNION SELECT dst, src FROM li), nodes AS (SELECT DISTINCT src AS id FROM edges), deg AS (SELECT src AS id, count(*) AS d FROM edges GROUP BY 1), cnt AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT id, 1.0::DOUBLE / n / d AS score, n, d FROM nodes JOIN deg USING (id), cnt)"


def _rank_sql(rounds):
    out = "WITH " + TRADE
    for k in range(rounds):
        out += f", r{k + 1} AS (SELECT a.id, (0.15::DOUBLE / a.n + 0.85::DOUBLE * coalesce(s, 0)) / a.d AS score, a.n, a.d FROM r{k} a LEFT JOIN (SELECT dst, sum(score) AS s FROM edges JOIN r{k} ON src = id GROUP BY 1) ON dst = a.id)"
    return out + f" SELECT id, round(score, 9) AS score FROM r{rounds}"


@query("g1_pagerank", _rank_sql(5))
def g1(spark, d):
    checkpoints(spark)
    return G.pagerank(*_trade(spark, d), rounds=5, are_dealt=True).withColumn("score", F.round("score", 9))


@query("g2_shortest_paths", "WITH " + TRADE + "," + ", ".join(f"b{k} AS (SELECT n.id, least(o.distance, m.m) AS distance FROM nodes n LEFT JOIN b{k - 1} o ON o.id = n.id LEFT JOIN (SELECT dst, min(distance + (src + dst) % 7 + 1) AS m FROM edges JOIN b{k - 1} ON src = id WHERE distance IS NOT NULL GROUP BY 1) m ON m.dst = n.id)" if k else "b0 AS (SELECT id, CASE WHEN id IN (0, 3) THEN 0 END AS distance FROM nodes)" for k in range(8)) + " SELECT id, distance::BIGINT AS distance FROM b7")
def g2(spark, d):
    checkpoints(spark)
    nodes, edges = _trade(spark, d)
    return G.shortest_paths(nodes, edges.withColumn("cost", (F.col("src") + F.col("dst")) % 7 + 1), nodes.where("id in (0, 3)"), are_dealt=True)


def _circuit_sql(rounds):
    out = "WITH li AS (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), wires AS (SELECT DISTINCT src, dst FROM li UNION SELECT DISTINCT dst, src FROM li WHERE dst < src), w AS (SELECT * FROM wires WHERE src < dst), v0 AS (SELECT id, (id % 13)::DOUBLE AS v FROM (SELECT src AS id FROM li UNION SELECT dst FROM li))"
    for k in range(rounds):
        out += f", i{k} AS (SELECT src, dst, (a.v - b.v) / 2.0 * 1e-3 AS q FROM w JOIN v{k} a ON src = a.id JOIN v{k} b ON dst = b.id), v{k + 1} AS (SELECT id, v + coalesce(s, 0) AS v FROM v{k} LEFT JOIN (SELECT id AS node, sum(q) AS s FROM (SELECT src AS id, -q AS q FROM i{k} UNION ALL SELECT dst, q FROM i{k}) GROUP BY 1) ON node = id)"
    return out + f" SELECT id, 1.0::DOUBLE AS capacity, round(v, 6) AS voltage FROM v{rounds}"


@query("g3_circuit", _circuit_sql(3))
def g3(spark, d):
    checkpoints(spark)
    nodes, edges = _trade(spark, d)
    n = nodes.select("id", F.lit(1.0).alias("capacity"), (F.col("id") % 13).cast("double").alias("voltage"))
    return G.circuit(n, edges.where("src < dst").withColumn("resistance", F.lit(2.0)), 3, are_dealt=True).withColumn("voltage", F.round("voltage", 6))


@query("g4_star_stencil", """WITH g AS (SELECT a, b FROM range(50) t(a), range(50) u(b)), s AS (SELECT unnest([-2, -1, 1, 2]) AS d),
n AS (SELECT a, b, sum((a + b + d + r) / (4.0 * d)) AS s FROM g, s, range(3) k(r) WHERE a + d BETWEEN 0 AND 49 GROUP BY ALL UNION ALL SELECT a, b, sum((a + b + d + r) / (4.0 * d)) FROM g, s, range(3) k(r) WHERE b + d BETWEEN 0 AND 49 GROUP BY ALL)
SELECT a AS p0, b AS p1, (a + b + 3)::DOUBLE AS input, round(sum(s), 8)::DOUBLE AS output FROM n GROUP BY ALL""")
def g4(spark, d):
    checkpoints(spark)
    g = C.grid(spark, (0, 49), (0, 49)).select("p0", "p1", (F.col("p0") + F.col("p1")).cast("double").alias("input"), F.lit(0.0).alias("output"))
    return G.star_stencil(g, 3, 2).withColumn("output", F.round("output", 8))


@query("g7_sparse_product", "SELECT l_orderkey AS row, CAST(sum(l_quantity * p_size) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def g7(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"))
    return G.sparse_product(m, table(spark, d, "part").select(F.col("p_partkey").alias("col"), F.col("p_size").alias("value")))


@query("g8_axpy", "SELECT c_custkey, 2.0 * c_acctbal + c_nationkey AS z FROM customer")
def g8(spark, d):
    return G.axpy(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), 2.0, "c_acctbal", "c_nationkey", "z").select("c_custkey", "z")


@query("g9_matrix_product", "WITH m AS (SELECT a AS r, b AS c, (a * 7 + b * 3) % 11 AS v FROM range(40) t(a), range(40) u(b)) SELECT x.r AS row, y.c AS col, sum(x.v * y.v)::BIGINT AS value FROM m x JOIN m y ON x.c = y.r GROUP BY ALL")
def g9(spark, d):
    m = C.grid(spark, (0, 39), (0, 39)).select(F.col("p0").alias("row"), F.col("p1").alias("col"), ((F.col("p0") * 7 + F.col("p1") * 3) % 11).alias("value"))
    return G.matrix_product(m, m)


@query("g10_deposit", "SELECT floor(o_custkey / 64.0)::BIGINT AS p0, floor(o_orderkey / 512.0)::BIGINT AS p1, sum(o_orderkey % 5)::DOUBLE AS charge FROM orders GROUP BY ALL")
def g10(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("px"), F.col("o_orderkey").alias("py"), (F.col("o_orderkey") % 5).cast("double").alias("charge"))
    return G.deposit(p.withColumn("py", F.col("py") / 8), 64.0, ("px", "py"))


from pointset.plans import files, grids, numbers, workloads  # noqa: E402, F401 - they add their queries
