"""Queries on scalar expressions, the mathematical functions and further reductions and launches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointset.functions import reductions as R
from pointset.functions import scalar as S
from pointset.operators import launch as U
from pointset.operators import partition as D
from pointset.operators import region as C
from pointset.operators import scan as W
from pointset.plans.registry import query, table


@query("p2_wide_division", "SELECT o_orderkey, (9007199254740993 + o_orderkey) // (o_orderkey % 5 + 1) AS q FROM orders")
def p2_wide(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.int_div(k + 9007199254740993, k % 5 + 1).alias("q"))


@query("p3_compare", "WITH v AS (SELECT c_custkey, c_acctbal AS a, CASE WHEN c_nationkey % 4 <> 0 THEN 3000.0 END AS b FROM customer) SELECT c_custkey, coalesce(a < b, false) AS lt, coalesce(a > b, false) AS gt, coalesce(a <= b, false) AS le, coalesce(a >= b, false) AS ge, coalesce(a = b, false) AS eq, coalesce(a <> b, true) AS ne FROM v")
def p3(spark, d):
    b = F.when(F.col("c_nationkey") % 4 == 0, F.lit(float("nan"))).otherwise(3000.0)
    found = S.compare(F.col("c_acctbal"), b)
    return table(spark, d, "customer").select("c_custkey", *[c.alias(n) for n, c in found.items()])


@query("p9_null_pointers", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS ptr, o_orderstatus <> 'F' AS is_null FROM orders")
def p9(spark, d):
    ptr = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(S.null_pointer())
    return table(spark, d, "orders").select("o_orderkey", ptr.alias("ptr"), S.is_null(ptr).alias("is_null"))


@query("p10_casts", "SELECT p_partkey, trunc(p_retailprice)::INTEGER AS whole, p_size::DOUBLE AS wide, p_partkey::VARCHAR AS text, p_size > 25 AS flag, (p_size > 25)::INTEGER AS bit FROM part")
def p10_casts(spark, d):
    big = F.col("p_size") > 25
    return table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("int").alias("whole"), F.col("p_size").cast("double").alias("wide"), F.col("p_partkey").cast("string").alias("text"), big.alias("flag"), big.cast("int").alias("bit"))


@query("p11_structs", "SELECT p_partkey, p_size * 2 AS w, p_retailprice AS price, p_brand AS brand FROM part")
def p11(spark, d):
    inner = F.struct((F.col("p_size") * 2).alias("w"), F.col("p_retailprice").alias("price"))
    packed = table(spark, d, "part").select("p_partkey", F.struct(inner.alias("dims"), F.col("p_brand").alias("brand")).alias("r"))
    return packed.select("p_partkey", "r.dims.*", "r.brand")


@query("p13_predicates", "SELECT (SELECT count(*) > 10 FROM supplier) AND NOT (SELECT bool_or(s_acctbal > 1e6) FROM supplier) AND ((SELECT count(*) > 10 FROM supplier) OR (SELECT bool_or(s_acctbal > 1e6) FROM supplier)) AS holds")
def p13_predicates(spark, d):
    s = table(spark, d, "supplier")
    many, rich = s.agg((F.count("*") > 10).alias("p")), s.agg(F.bool_or(F.col("s_acctbal") > 1e6).alias("p"))
    return U.predicate("and", many, U.predicate("not", rich), U.predicate("or", many, rich))


@query("p21_clock", "SELECT r_regionkey, true AS agree FROM region")
def p21(spark, d):
    us = S.clock("us")
    return table(spark, d, "region").select("r_regionkey", ((S.clock("s") == S.int_div(us, F.lit(1_000_000))) & (S.clock("ns") == us * 1000) & (us > 1_600_000_000_000_000)).alias("agree"))


#: name of the function -> (its argument from x in (0, 1], SQL over the same x)
ONE = {
    "acos": "acos(x)", "acosh": "acosh(x + 1)", "asin": "asin(x)", "asinh": "asinh(x)", "atan": "atan(x)", "atanh": "atanh(x / 2)", "cbrt": "cbrt(x)", "ceil": "ceil(x * 9)", "cos": "cos(x)", "cosh": "cosh(x)",
    "exp": "exp(x)", "expm1": "exp(x) - 1", "floor": "floor(x * 9)", "log": "ln(x)", "log10": "log10(x)", "log1p": "ln(1 + x)", "log2": "log2(x)", "sin": "sin(x)", "sinh": "sinh(x)", "sqrt": "sqrt(x)", "tan": "tan(x)", "tanh": "tanh(x)",
    "exp2": "pow(2, x)", "fabs": "abs(x - 0.5)", "trunc": "trunc(x * 9 - 4)", "rsqrt": "1 / sqrt(x)", "nearbyint": "round_even(x * 9, 0)", "rint": "round_even(x * 9, 0)", "round": "round(x * 9)", "logb": "floor(log2(x))",
}
ARGUMENT = {"acosh": "x + 1", "atanh": "x / 2", "ceil": "x * 9", "floor": "x * 9", "fabs": "x - 0.5", "trunc": "x * 9 - 4", "nearbyint": "x * 9", "rint": "x * 9", "round": "x * 9"}


@query("p_math_one", "WITH v AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part) SELECT p_partkey, " + ", ".join(f"round(({sql})::DOUBLE, 8) AS m_{n}" for n, sql in ONE.items()) + " FROM v")
def p_math_one(spark, d):
    v = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("x"))
    f = lambda n: S.COMPOSED[n] if n in S.COMPOSED else getattr(F, n)
    return v.select("p_partkey", *[F.round(f(n)(F.expr(ARGUMENT.get(n, "x"))).cast("double"), 8).alias(f"m_{n}") for n in ONE])


@query("p_math_two", "WITH v AS (SELECT p_partkey, p_size / 7.0::DOUBLE - 3 AS x, p_partkey % 5 + 1.5::DOUBLE AS y FROM part) SELECT p_partkey, round(atan2(x, y), 8) AS m_atan2, round(sqrt(x * x + y * y), 8) AS m_hypot, round(pow(y, x), 6) AS m_pow, round(greatest(x - y, 0), 8) AS m_fdim, round(x * y + 2, 8) AS m_fma, round(x % y, 8) AS m_fmod, greatest(x, y) AS m_fmax, least(x, y) AS m_fmin, CASE WHEN x < 0 THEN -y ELSE y END AS m_copysign, y * 8 AS m_ldexp, round(x - round_even(x / y, 0) * y, 8) AS m_remainder, round(x - trunc(x), 8) AS m_fraction, trunc(x) AS m_whole FROM v")
def p_math_two(spark, d):
    v = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 7.0 - 3).alias("x"), (F.col("p_partkey") % 5 + 1.5).alias("y"))
    x, y, c = F.col("x"), F.col("y"), S.COMPOSED
    rounded = {"atan2": F.atan2(x, y), "hypot": F.hypot(x, y), "fdim": c["fdim"](x, y), "fma": c["fma"](x, y, F.lit(2.0)), "fmod": c["fmod"](x, y), "remainder": c["remainder"](x, y), "fraction": c["modf"](x)["fraction"]}
    exact = {"fmax": c["fmax"](x, y), "fmin": c["fmin"](x, y), "copysign": c["copysign"](y, x), "ldexp": c["ldexp"](y, F.lit(3)), "whole": c["modf"](x)["whole"]}
    return v.select("p_partkey", F.round(F.pow(y, x), 6).alias("m_pow"), *[F.round(e, 8).alias(f"m_{n}") for n, e in rounded.items()], *[e.alias(f"m_{n}") for n, e in exact.items()])


@query("a1_complex", "SELECT c_nationkey AS color, sum(c_custkey)::BIGINT AS re, sum(c_custkey % 7)::BIGINT AS im FROM customer GROUP BY 1")
def a1_complex(spark, d):
    re, im = R.complex_sum(F.col("c_custkey"), F.col("c_custkey") % 7)
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("color")).agg(re.alias("re"), im.alias("im"))


@query("a3_complex_product", "SELECT o_custkey AS color, round(product(sqrt(x * x + y * y)) * cos(sum(atan2(y, x))), 5) AS re, round(product(sqrt(x * x + y * y)) * sin(sum(atan2(y, x))), 5) AS im FROM (SELECT o_custkey, (o_orderkey % 3 - 1) / 3.0::DOUBLE AS x, (o_orderkey % 5 + 1) / 7.0::DOUBLE AS y FROM orders) GROUP BY 1")
def a3_complex(spark, d):
    k = F.col("o_orderkey")
    total = R.complex_total((k % 3 - 1) / 3.0, (k % 5 + 1) / 7.0)
    out = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("color")).agg(total.alias("t"))
    return out.select("color", F.round("t.re", 5).alias("re"), F.round("t.im", 5).alias("im"))


@query("a11_task_reduction", "SELECT c_custkey, 100 + coalesce(a, 0) + coalesce(b, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY 1) x ON x.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, sum(2) AS b FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) y ON y.k = c_custkey")
def a11(spark, d):
    o = table(spark, d, "orders")
    one = o.select(F.col("o_custkey").alias("c_custkey"), F.lit(1).cast("long").alias("value"))
    two = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(2).cast("long").alias("value"))
    return U.task_reduction(table(spark, d, "customer").select("c_custkey", F.lit(100).cast("long").alias("n")), ["c_custkey"], [one, two], "n", "sum", "long")


@query("a13_launch_reduce", "SELECT max(n) AS value FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def a13(spark, d):
    c = table(spark, d, "customer")
    return U.launch_reduce(D.by_field(c, ["c_custkey"], "c_nationkey"), c.select("c_custkey", "c_acctbal"), F.count("*"), "max", "long")


@query("a14_collective", "SELECT o_orderkey // 4 AS generation, sum(o_custkey)::BIGINT AS value FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) >= 4")
def a14(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(S.int_div(F.col("o_orderkey"), F.lit(4)).alias("generation"), "o_custkey")
    return U.collective(o, "generation", "o_custkey", "sum", 4, "long")


@query("a18_fields", "SELECT c_nationkey AS color, sum(c_custkey)::BIGINT AS c_custkey, max(c_acctbal) AS c_acctbal, bool_or(c_acctbal < 0) AS owes FROM customer GROUP BY 1")
def a18(spark, d):
    c = table(spark, d, "customer").withColumn("owes", F.col("c_acctbal") < 0)
    return c.groupBy(F.col("c_nationkey").alias("color")).agg(*R.reduce_fields({"c_custkey": ("sum", "long"), "c_acctbal": ("max", "double"), "owes": ("or", "boolean")}))


@query("w1_scan_prod", "SELECT user_id, event_id, round(product(1 + event_id % 3 / 1000.0) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS s FROM events")
def w1_prod(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (1 + F.col("event_id") % 3 / 1000.0).alias("v"))
    return W.prefix_scan(e, ["user_id"], "event_id", "v", "prod", "s").withColumn("s", F.round("s", 6)).drop("v")


@query("w1_exclusive", "SELECT o_orderkey, coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM orders")
def w1_exclusive(spark, d):
    o = W.prefix_scan(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [], "o_orderkey", "o_custkey", "sum", "s")
    return o.select("o_orderkey", (F.col("s") - F.col("o_custkey")).alias("before"))


@query("u1_single_task", "SELECT count(*) AS value FROM orders")
def u1(spark, d):
    return U.single_task(spark, lambda s: table(s, d, "orders").agg(F.count("*")))


def _both(a, b):
    return {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}


@query("u14_pickled", "SELECT c_nationkey AS color, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def u14(spark, d):
    import pickle

    @F.pandas_udf("long")
    def total(v):
        return v.map(lambda raw: sum(pickle.loads(raw).values()))

    @F.pandas_udf("binary")
    def tally(v):
        return v.map(lambda x: pickle.dumps({x: 1}, protocol=4))

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("color"), tally("c_mktsegment").alias("v"))
    return U.reduce_pickled(c, ["color"], "v", _both).select("color", total("value").alias("n"))


@query("s11_inline", "SELECT n_nationkey, n_name FROM nation")
def s11(spark, d):
    held = C.inline(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    return spark.createDataFrame([(int(k), str(n)) for k, n in zip(held["n_nationkey"], held["n_name"], strict=True)], "n_nationkey int, n_name string")
