"""Queries on linked records, loops of events, meshes and linear algebra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pointset.operators import intervals as L
from pointset.operators import iterative as G
from pointset.operators import region as C
from pointset.plans.registry import RECORDS, checkpoints, query, records, table


@query("l1_link", "WITH " + RECORDS + """SELECT p_partkey AS key, p_partkey IS NOT NULL AND p_size IS NOT NULL AS known, coalesce(nv, 0) AS n_view, coalesce(tv, 0)::BIGINT AS total_view, coalesce(nc, 0) AS n_click, coalesce(tc, 0)::BIGINT AS total_click
FROM (SELECT k AS p_partkey, p_size, nv, tv, nc, tc FROM (SELECT p_partkey AS k FROM part UNION SELECT id % 2500 FROM records WHERE kind IN ('view', 'click')) LEFT JOIN part ON p_partkey = k
LEFT JOIN (SELECT id % 2500 AS k, count(*) AS nv, sum(stop - start) AS tv FROM records WHERE kind = 'view' GROUP BY 1) USING (k) LEFT JOIN (SELECT id % 2500 AS k, count(*) AS nc, sum(stop - start) AS tc FROM records WHERE kind = 'click' GROUP BY 1) USING (k))""")
def l1(spark, d):
    r = records(spark, d).withColumn("key", F.col("id") % 2500)
    kinds = {k: r.where(F.col("kind") == k).select("key", "start", "stop") for k in ("view", "click")}
    return L.link(table(spark, d, "part").select(F.col("p_partkey").alias("key")), "key", kinds)


EVENT_LOOPS = "WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey::BIGINT AS src, ((c_nationkey * 7 + 3) % 31)::BIGINT AS dst FROM customer UNION SELECT DISTINCT ((c_nationkey * 7 + 3) % 31)::BIGINT, ((c_nationkey * 7 + 3) % 31 * 5 % 29 + 10)::BIGINT FROM customer), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src) "


@query("l15_loops", EVENT_LOOPS + "SELECT a.src AS id, max(a.dst) AS loop FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1")
def l15(spark, d):
    checkpoints(spark)
    k = F.col("c_nationkey")
    c = table(spark, d, "customer")
    to = (k * 7 + 3) % 31
    e = c.select(k.cast("long").alias("src"), to.cast("long").alias("dst")).union(c.select(to.cast("long"), (to * 5 % 29 + 10).cast("long"))).distinct()
    return L.loops(e)


def _mesh(n: int):
    return f"z AS (SELECT i * {n} + j AS zone, i, j FROM range({n}) t(i), range({n}) u(j)), pts AS (SELECT i * {n + 1} + j AS pt, i::DOUBLE AS x, j::DOUBLE AS y FROM range({n + 1}) t(i), range({n + 1}) u(j)), sides AS (SELECT zone, (i + a) * {n + 1} + j + b AS p1, (i + c) * {n + 1} + j + e AS p2 FROM z, (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)) s(a, b, c, e))"


N = 24


@query("g5_hydro", f"""WITH {_mesh(N)}, zs AS (SELECT zone, 1.0::DOUBLE AS mass, CASE WHEN zone = 0 THEN 10.0 ELSE 0.5 + zone % 3 / 4.0 END::DOUBLE AS energy FROM z),
p AS (SELECT zone, mass, energy, 2.0 / 3 * mass / 1.0 * energy AS pressure FROM zs), dt AS (SELECT least(min(0.5 / sqrt(5.0 / 3 * pressure)), 0.01) AS dt FROM p),
f AS (SELECT s.*, pressure * (b.y - a.y) / 2 AS fx, -pressure * (b.x - a.x) / 2 AS fy FROM sides s JOIN p USING (zone) JOIN pts a ON a.pt = p1 JOIN pts b ON b.pt = p2),
force AS (SELECT pt, sum(fx) AS fx, sum(fy) AS fy FROM (SELECT p1 AS pt, fx, fy FROM f UNION ALL SELECT p2, fx, fy FROM f) GROUP BY 1),
moved AS (SELECT pt, x + dt * dt * fx AS x, y + dt * dt * fy AS y FROM pts JOIN force USING (pt), dt),
area AS (SELECT zone, sum(a.x * b.y - b.x * a.y) / 2 AS area FROM sides JOIN moved a ON a.pt = p1 JOIN moved b ON b.pt = p2 GROUP BY 1)
SELECT zone, round(energy - pressure * (area - 1.0) / mass, 9) AS energy, round(area, 9) AS area FROM p JOIN area USING (zone)""")
def g5(spark, d):
    checkpoints(spark)
    z = C.grid(spark, (0, N - 1), (0, N - 1)).select((F.col("p0") * N + F.col("p1")).alias("zone"), F.col("p0").alias("i"), F.col("p1").alias("j"))
    at = lambda i, j: i * (N + 1) + j
    i, j = F.col("i"), F.col("j")
    corners = [(at(i + a, j + b), at(i + c, j + e)) for a, b, c, e in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))]
    sides = z.select("zone", F.explode(F.array(*[F.struct(p.alias("p1"), q.alias("p2")) for p, q in corners])).alias("s")).select("zone", "s.p1", "s.p2")
    zones = z.select("zone", F.lit(1.0).alias("mass"), F.when(F.col("zone") == 0, 10.0).otherwise(0.5 + F.col("zone") % 3 / 4.0).alias("energy"))
    points = C.grid(spark, (0, N), (0, N)).select((F.col("p0") * (N + 1) + F.col("p1")).alias("pt"), F.lit(1.0).alias("mass"), F.col("p0").cast("double").alias("x"), F.col("p1").cast("double").alias("y"), F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    after, _ = G.hydro_step(zones, points, sides)
    return after.select("zone", F.round("energy", 9).alias("energy"), F.round("area", 9).alias("area"))


def _flux_sql(rounds):
    out = "WITH faces AS (SELECT DISTINCT l_suppkey AS l, l_partkey + 1000000 AS r FROM lineitem), v0 AS (SELECT id, (id % 17)::DOUBLE AS v FROM (SELECT l AS id FROM faces UNION SELECT r FROM faces))"
    for k in range(rounds):
        out += f", f{k} AS (SELECT l, r, (a.v - b.v) * 0.5 AS f FROM faces JOIN v{k} a ON l = a.id JOIN v{k} b ON r = b.id), v{k + 1} AS (SELECT id, v + 0.01 * s / (1 + id % 3) AS v FROM v{k} JOIN (SELECT id AS node, sum(f) AS s FROM (SELECT l AS id, -f AS f FROM f{k} UNION ALL SELECT r, f FROM f{k}) GROUP BY 1) ON node = id)"
    return out + f" SELECT id, round(v, 6) AS value FROM v{rounds}"


@query("g6_flux", _flux_sql(3))
def g6(spark, d):
    checkpoints(spark)
    faces = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("left"), (F.col("l_partkey") + 1000000).alias("right")).distinct().withColumn("area", F.lit(0.5))
    cells = faces.select(F.explode(F.array("left", "right")).alias("id")).distinct().select("id", (1 + F.col("id") % 3).cast("double").alias("volume"), (F.col("id") % 17).cast("double").alias("value"))
    return G.flux_rounds(cells, faces, 3, 0.01).select("id", F.round("value", 6).alias("value"))


def _cg_sql(rounds):
    out = "WITH m AS (SELECT a AS r, a AS c, 4.0::DOUBLE AS v FROM range(900) t(a) UNION ALL SELECT a, a + d, -1.0 FROM range(900) t(a), (VALUES (1), (-1), (30), (-30)) o(d) WHERE a + d BETWEEN 0 AND 899 AND NOT (d = 1 AND a % 30 = 29) AND NOT (d = -1 AND a % 30 = 0)), s0 AS (SELECT a AS i, 0.0::DOUBLE AS x, (a % 7 + 1)::DOUBLE AS r, (a % 7 + 1)::DOUBLE AS p FROM range(900) t(a))"
    for k in range(rounds):
        out += f", q{k} AS (SELECT m.r AS i, sum(v * p) AS ap FROM m JOIN s{k} ON c = i GROUP BY 1), a{k} AS (SELECT (SELECT sum(r * r) FROM s{k}) / sum(p * ap) AS alpha FROM s{k} JOIN q{k} USING (i)), t{k} AS (SELECT i, x + alpha * p AS x, s.r - alpha * ap AS r, s.r AS was, p FROM s{k} s JOIN q{k} USING (i), a{k}), s{k + 1} AS (SELECT i, x, r, r + beta * p AS p FROM t{k}, (SELECT sum(r * r) / sum(was * was) AS beta FROM t{k}))"
    return out + f" SELECT i AS col, round(x, 7) AS value FROM s{rounds}"


@query("g7_conjugate_gradient", _cg_sql(6))
def g7(spark, d):
    checkpoints(spark)
    n = spark.range(900).select(F.col("id").alias("row"))
    k = F.col("row")
    near = n.select("row", F.explode(F.array(*map(F.lit, (1, -1, 30, -30)))).alias("d")).where("row + d between 0 and 899 and not (d = 1 and row % 30 = 29) and not (d = -1 and row % 30 = 0)")
    matrix = n.select("row", k.alias("col"), F.lit(4.0).alias("value")).unionAll(near.select("row", (k + F.col("d")).alias("col"), F.lit(-1.0).alias("value")))
    return G.conjugate_gradient(matrix, n.select(k.alias("col"), (k % 7 + 1).cast("double").alias("value")), 6).withColumn("value", F.round("value", 7))


def spd(n: int) -> np.ndarray:
    """A symmetric positive definite matrix: 1 / (1 + |i - j|), and n on the diagonal."""
    i = np.arange(n)
    return 1.0 / (1 + np.abs(i[:, None] - i)) + n * np.eye(n)


@query("g9_cholesky")
def g9_cholesky(spark, d):
    checkpoints(spark)
    size, tile = 48, 12
    m = spd(size)
    rows = [(i, j, m[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile].ravel().tolist()) for i in range(size // tile) for j in range(i + 1)]
    factor = G.cholesky(spark.createDataFrame(rows, "bi int, bj int, tile array<double>"), size // tile)
    value = factor.select("bi", "bj", F.posexplode("tile").alias("k", "value"))
    return value.select((F.col("bi") * tile + F.floor(F.col("k") / tile)).alias("row"), (F.col("bj") * tile + F.col("k") % tile).alias("col"), F.round("value", 9).alias("value")).where("row >= col")


@query("g10_gather_field", "WITH p AS (SELECT o_orderkey, o_custkey AS px, o_orderkey / 8.0 AS py, (o_orderkey % 5)::DOUBLE AS charge FROM orders), g AS (SELECT floor(px / 64.0) AS a, floor(py / 64.0) AS b, sum(charge) AS total FROM p GROUP BY ALL) SELECT o_orderkey, total AS field FROM p JOIN g ON a = floor(px / 64.0) AND b = floor(py / 64.0)")
def g10_field(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("px"), (F.col("o_orderkey") / 8).alias("py"), (F.col("o_orderkey") % 5).cast("double").alias("charge"))
    grid = G.deposit(p, 64.0, ("px", "py")).withColumnRenamed("charge", "field")
    return G.gather_field(p, grid, 64.0, ("px", "py"), ["field"]).select("o_orderkey", "field")


@query("l4_groupings", "WITH " + RECORDS + """, g AS (SELECT 'kind' AS grouping, kind AS value, start, stop FROM records UNION ALL SELECT 'node', (proc % 2)::VARCHAR, start, stop FROM records),
ends AS (SELECT grouping, value, start AS t, 1 AS w FROM g UNION ALL SELECT grouping, value, stop, -1 FROM g), sums AS (SELECT grouping, value, t, sum(w) AS w FROM ends GROUP BY ALL)
SELECT grouping, value, t, (sum(w) OVER (PARTITION BY grouping, value ORDER BY t))::BIGINT AS level FROM sums""")
def l4(spark, d):
    return L.grouped_steps(records(spark, d), {"kind": F.col("kind"), "node": F.col("proc") % 2})


@query("l8_visible_near", "WITH " + RECORDS + "SELECT id, proc, proc <> 1 AS near FROM records WHERE proc IN (1, 3, 6)")
def l8_near(spark, d):
    r = records(spark, d)
    chosen = spark.createDataFrame([(1,)], "proc long")
    links = spark.createDataFrame([(1, 3), (6, 1), (3, 6), (4, 5)], "a long, b long")
    return L.visible(r.select("id", "proc"), "proc", chosen, links)
