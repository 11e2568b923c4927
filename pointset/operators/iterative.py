"""Iterative workloads on regions: loops of DataFrame steps with checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointset.operators.intervals import iterate
from pointset.operators.scan import stencil_nd


def dealt(edges: DataFrame, by: str, once: bool = False) -> DataFrame:
    """Edges made once, as a checkpoint that is dealt by one end and sorted by it.  Under adaptive execution the checkpoint does not tell how it is dealt, and a join deals it again.  ``once``: of edges that repeat one stays, which takes no further shuffle."""
    edges = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    return (edges.distinct() if once else edges).sortWithinPartitions(by).checkpoint()


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, alpha: float = 0.85, are_dealt: bool = False) -> DataFrame:
    """Pull PageRank; the score kept is already divided by the out-degree (at least one).  ``are_dealt``: the edges come from ``dealt`` by src."""
    edges = edges if are_dealt else dealt(edges, "src")
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    base = nodes.select("id").join(degree, "id", "left").select("id", F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1)).alias("degree"))
    total = F.broadcast(base.agg(F.count("*").alias("n")))  # one row
    start = base.crossJoin(total).select("id", "degree", "n", (F.lit(1.0) / F.col("n") / F.col("degree")).alias("score"))

    def step(s: DataFrame) -> DataFrame:
        got = edges.join(s.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("__in"))
        new = (F.lit(1 - alpha) / F.col("n") + alpha * F.coalesce("__in", F.lit(0.0))) / F.col("degree")
        return s.join(got, "id", "left").select("id", "degree", "n", new.alias("score"))

    return iterate(start, step, rounds).select("id", "score")


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, are_dealt: bool = False) -> DataFrame:
    """Bellman-Ford from several sources, until a round changes no distance (null: not reached).

    Costs are not negative on any cycle, or there is no least distance.  Each round is a checkpoint.
    ``are_dealt``: the edges come from ``dealt`` by src.
    """
    edges = edges if are_dealt else dealt(edges, "src")
    state = nodes.select("id").join(sources.select("id", F.lit(0).cast("long").alias("distance")), "id", "left").withColumn("__new", F.col("distance").isNotNull()).checkpoint()

    while not state.where("__new").isEmpty():
        near = state.where("__new").select(F.col("id").alias("src"), "distance")
        got = edges.join(near, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("cost")).alias("__d"))
        less = F.col("__d").isNotNull() & (F.col("distance").isNull() | (F.col("__d") < F.col("distance")))
        state = state.join(got, "id", "left").select("id", F.least("distance", "__d").alias("distance"), less.alias("__new")).checkpoint()
    return state.select("id", "distance")


def star_stencil(grid: DataFrame, rounds: int, radius: int = 1) -> DataFrame:
    """Rounds of output += star-shaped sum of input; input += 1 (columns p0, p1, input, output)."""
    reach = [((d, 0), 1.0 / (2 * radius * d)) for d in range(-radius, radius + 1) if d] + [((0, d), 1.0 / (2 * radius * d)) for d in range(-radius, radius + 1) if d]

    def step(g: DataFrame) -> DataFrame:
        return stencil_nd(g, ["p0", "p1"], "input", reach, "__s").select("p0", "p1", (F.col("input") + 1).alias("input"), (F.col("output") + F.coalesce("__s", F.lit(0.0))).alias("output"))

    return iterate(grid, step, rounds)


def circuit(nodes: DataFrame, wires: DataFrame, rounds: int, dt: float = 1e-3, are_dealt: bool = False) -> DataFrame:
    """Currents from voltages, charge scattered to both ends of each wire, voltages from charge.

    nodes: id, capacity, voltage; wires: src, dst, resistance.  ``are_dealt``: the wires come from ``dealt`` by src.
    """

    wires = wires if are_dealt else dealt(wires, "src")

    def step(s: DataFrame) -> DataFrame:
        a, b = s.select(F.col("id").alias("src"), F.col("voltage").alias("va")), s.select(F.col("id").alias("dst"), F.col("voltage").alias("vb"))
        current = wires.join(a, "src").join(b, "dst").select("src", "dst", ((F.col("va") - F.col("vb")) / F.col("resistance")).alias("i"))
        charge = current.select(F.col("src").alias("id"), (-F.col("i") * dt).alias("q")).unionAll(current.select("dst", F.col("i") * dt)).groupBy("id").agg(F.sum("q").alias("q"))
        return s.join(charge, "id", "left").select("id", "capacity", (F.col("voltage") + F.coalesce("q", F.lit(0.0)) / F.col("capacity")).alias("voltage"))

    return iterate(nodes, step, rounds)


def sparse_product(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(row, value): matrix (row, col, value) times vector (col, value)."""
    v = vector.select("col", F.col("value").alias("__v"))
    return matrix.join(v, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("__v")).alias("value"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, value) of two matrices in the same form."""
    right = b.select(F.col("row").alias("__k"), F.col("col").alias("__c"), F.col("value").alias("__v"))
    return a.join(right, a["col"] == F.col("__k")).groupBy("row", F.col("__c").alias("col")).agg(F.sum(F.col("value") * F.col("__v")).alias("value"))


def axpy(region: DataFrame, alpha: float, x: str, y: str, out: str) -> DataFrame:
    return region.withColumn(out, F.lit(alpha) * F.col(x) + F.col(y))


def dot(a: DataFrame, b: DataFrame, key: str = "col") -> DataFrame:
    """One row: the inner product of two vectors (key, value)."""
    return a.join(b.select(key, F.col("value").alias("__v")), key).agg(F.coalesce(F.sum(F.col("value") * F.col("__v")), F.lit(0.0)).alias("dot"))


def conjugate_gradient(matrix: DataFrame, b: DataFrame, rounds: int, enough: float = 0.0) -> DataFrame:
    """(col, value): the solution of matrix * x = b after so many rounds, or when the squared residual is at most ``enough``.

    matrix: (row, col, value), symmetric and positive definite; b: (col, value).  One row of x, r, p for each unknown is the
    state, a checkpoint each round; the two inner products of a round are single numbers.
    """
    matrix = dealt(matrix, "col")
    state = b.select("col", F.lit(0.0).alias("x"), F.col("value").cast("double").alias("r"), F.col("value").cast("double").alias("p")).checkpoint()
    norm = state.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
    for _ in range(rounds):
        if norm <= enough:
            break
        ap = sparse_product(matrix, state.select("col", F.col("p").alias("value"))).select(F.col("row").alias("col"), F.col("value").alias("ap"))
        s = state.join(ap, "col", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))).checkpoint()
        alpha = norm / s.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        s = s.select("col", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p").checkpoint()
        after = s.agg(F.sum(F.col("r") * F.col("r"))).first()[0]
        state, norm = s.withColumn("p", F.col("r") + after / norm * F.col("p")), after
    return state.select("col", F.col("x").alias("value"))


def cholesky(tiles: DataFrame, n: int) -> DataFrame:
    """The lower triangular factor of a symmetric positive definite matrix in n x n square tiles: rows (bi, bj, tile), tile an array in row order, bi >= bj.

    For each k: the diagonal tile is factored, the tiles below it are solved against it, and what they take from the tiles to
    the right is one join on the row and one on the column of tiles.  A task holds three tiles at a time.
    """
    import numpy as np
    import pandas as pd

    def square(x) -> np.ndarray:
        size = int(round(len(x) ** 0.5))
        return np.asarray(x, float).reshape(size, size)

    def rows(f):
        def run(batches):
            for batch in batches:
                yield pd.DataFrame({"bi": batch["bi"], "bj": batch["bj"], "tile": [f(*x).ravel() for x in zip(*(map(square, batch[c]) for c in batch.columns[2:]), strict=True)]})

        return run

    kind = "bi int, bj int, tile array<double>"
    a = tiles.where("bi >= bj").select(F.col("bi").cast("int").alias("bi"), F.col("bj").cast("int").alias("bj"), F.col("tile").cast("array<double>").alias("tile")).checkpoint()
    done = None
    for k in range(n):
        diagonal = a.where((F.col("bi") == k) & (F.col("bj") == k)).mapInPandas(rows(np.linalg.cholesky), kind)
        panel = a.where((F.col("bi") > k) & (F.col("bj") == k)).crossJoin(F.broadcast(diagonal.select(F.col("tile").alias("d"))))  # one tile
        panel = panel.mapInPandas(rows(lambda t, d: np.linalg.solve(d, t.T).T), kind)
        column = diagonal.unionByName(panel).checkpoint()
        done = column if done is None else done.unionByName(column)
        below = column.where(F.col("bi") > k)
        left, right = below.select("bi", F.col("tile").alias("l")), below.select(F.col("bi").alias("bj"), F.col("tile").alias("r"))
        rest = a.where((F.col("bj") > k)).join(left, "bi").join(right, "bj").select("bi", "bj", "tile", "l", "r")
        a = rest.mapInPandas(rows(lambda t, l, r: t - l @ r.T), kind).checkpoint()
    return done


def flux_rounds(cells: DataFrame, faces: DataFrame, rounds: int, dt: float) -> DataFrame:
    """An explicit finite-volume loop: a face's flux is its conductance times the difference of its cells, taken from the left and given to the right cell.

    cells: id, volume, value; faces: left, right, area.
    """
    faces = dealt(faces, "left")

    def step(s: DataFrame) -> DataFrame:
        a, b = s.select(F.col("id").alias("left"), F.col("value").alias("a")), s.select(F.col("id").alias("right"), F.col("value").alias("b"))
        flux = faces.join(a, "left").join(b, "right").select("left", "right", (F.col("area") * (F.col("a") - F.col("b"))).alias("f"))
        sums = flux.select(F.col("left").alias("id"), (-F.col("f")).alias("f")).unionAll(flux.select("right", "f")).groupBy("id").agg(F.sum("f").alias("f"))
        return s.join(sums, "id", "left").select("id", "volume", (F.col("value") + dt * F.coalesce("f", F.lit(0.0)) / F.col("volume")).alias("value"))

    return iterate(cells, step, rounds)


def hydro_step(zones: DataFrame, points: DataFrame, sides: DataFrame, gamma: float = 5 / 3, most_dt: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """One Lagrangian step of a mesh of polygons: zones and points after it.

    zones: zone, mass, energy (of a unit of mass); points: pt, mass, x, y, u, v; sides: zone, p1, p2 (an edge of the zone, counter-clockwise).
    A zone's area comes from its sides, its pressure from density and energy; each side pushes its two points outward; dt is
    the least over all zones of a length over the speed of sound, one number that every point gets; work is taken off the energy.
    """
    def ends(pts: DataFrame) -> DataFrame:
        a = pts.select(F.col("pt").alias("p1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        b = pts.select(F.col("pt").alias("p2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        return sides.join(a, "p1").join(b, "p2")

    area = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    long = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    edge = ends(points).checkpoint()
    size = edge.groupBy("zone").agg(area.alias("area"), F.min(long).alias("length"))
    state = zones.join(size, "zone").withColumn("pressure", (gamma - 1) * F.col("mass") / F.col("area") * F.col("energy")).checkpoint()
    sound = F.sqrt(gamma * F.col("pressure") * F.col("area") / F.col("mass"))
    dt = state.agg(F.least(F.min(F.lit(0.5) * F.col("length") / sound), F.lit(most_dt)).alias("dt"))
    push = edge.join(state.select("zone", "pressure"), "zone").select("p1", "p2", (F.col("pressure") * (F.col("y2") - F.col("y1")) / 2).alias("fx"), (-F.col("pressure") * (F.col("x2") - F.col("x1")) / 2).alias("fy"))
    force = push.select(F.col("p1").alias("pt"), "fx", "fy").unionAll(push.select("p2", "fx", "fy")).groupBy("pt").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    moved = points.join(force, "pt", "left").crossJoin(F.broadcast(dt))  # one row
    moved = moved.select("pt", "mass", "x", "y", (F.col("u") + F.col("dt") * F.col("fx") / F.col("mass")).alias("u"), (F.col("v") + F.col("dt") * F.col("fy") / F.col("mass")).alias("v"), "dt")
    moved = moved.select("pt", "mass", (F.col("x") + F.col("dt") * F.col("u")).alias("x"), (F.col("y") + F.col("dt") * F.col("v")).alias("y"), "u", "v").checkpoint()
    after = state.join(ends(moved).groupBy("zone").agg(area.alias("new_area")), "zone")
    after = after.select("zone", "mass", (F.col("energy") - F.col("pressure") * (F.col("new_area") - F.col("area")) / F.col("mass")).alias("energy"), F.col("new_area").alias("area"))
    return after, moved


def deposit(particles: DataFrame, size: float, dims: tuple[str, ...] = ("px", "py", "pz")) -> DataFrame:
    """Charge of the particles in each grid cell."""
    return particles.groupBy(*[F.floor(F.col(d) / size).alias(f"p{k}") for k, d in enumerate(dims)]).agg(F.sum("charge").alias("charge"))


def gather_field(particles: DataFrame, grid: DataFrame, size: float, dims: tuple[str, ...], fields: list[str]) -> DataFrame:
    """Each particle with the fields of its grid cell (p0, p1, ...)."""
    cells = [F.floor(F.col(d) / size).alias(f"p{k}") for k, d in enumerate(dims)]
    return particles.select("*", *cells).join(grid.select(*[f"p{k}" for k in range(len(dims))], *fields), [f"p{k}" for k in range(len(dims))], "left").drop(*[f"p{k}" for k in range(len(dims))])
