"""Force-directed layout of a weighted graph, as joins and sums over a pyramid of grid cells.

Stars repel through cells. At each level a cell feels the cells that are near its parent's cell but not near its own,
once for all its stars: the force at the middle of its mass, and how that changes around it. A star takes the forces of
its cells of all levels, changed by its distance from their middles, and those of the finest cells near its own, each
as one mass. So the work of a round goes with the number of occupied cells and with the stars, not with pairs. `reach`
says how many cells count as near: 1 is coarse, 3 has errors under two per cent. Edges attract.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import discard, ranked, stage
from .similarity import both_ways

SEED, ITERATIONS = 0x5EED, 300
REACH = 1  # cells on each side that count as near
DEPTH_ROUNDS = 10  # rounds after which the grid's depth is fitted anew
EVERYWHERE = 4_000_000  # up to so many stars or cells (some 50 bytes each) go to every task, so that no edge or pair moves
DAMPING, SOFTENING, LONGEST_STEP, LAST_HEAT = 0.9, 0.01, 10.0, 0.1


def nodes(edges: DataFrame) -> DataFrame:
    """(artist_id, degree, mass) of every artist with an edge."""
    return _ends(both_ways(edges))


def _ends(ways: DataFrame) -> DataFrame:
    return ways.groupBy("artist_id").agg(F.count(F.lit(1)).alias("degree"), F.sum(F.col("score").cast("double")).alias("mass"))


def spiral(nodes: DataFrame, seed: int = SEED) -> DataFrame:
    """Start positions: the i-th artist by id at radius sqrt(i), turned by the golden angle each."""
    rows = ranked(nodes, F.asc("artist_id"), name="index").withColumn("index", F.col("index") - 1)
    angle = F.col("index") * (math.pi * (3 - math.sqrt(5))) + math.radians(seed % 360)
    return rows.withColumns({"x": F.sqrt("index") * F.cos(angle), "y": F.sqrt("index") * F.sin(angle)})


#: Depths of the grid that are tried; at most MOST_DEPTH bits of a cell's number are in use.
LEAST_DEPTH, MOST_DEPTH = 2, 26


def _box(stars: DataFrame) -> DataFrame:
    return stars.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-6)).alias("span"))


def _placed(stars: DataFrame, depth: int) -> DataFrame:
    """Stars with their cell (cx, cy) of a depth, in the square around all."""
    cell = lambda c, c0: F.least(F.floor((F.col(c) - F.col(c0)) / F.col("span") * (1 << depth)).cast("bigint"), F.lit((1 << depth) - 1).cast("bigint"))
    return stars.join(F.broadcast(_box(stars))).withColumns({"cx": cell("x", "x0"), "cy": cell("y", "y0")}).drop("x0", "y0", "span")


def fitting_depth(stars: DataFrame) -> int:
    """The least depth at which there are half as many occupied cells as stars, by estimated counts. A star far away
    from all others makes the grid deeper, not coarser."""
    fine = _placed(stars, MOST_DEPTH)
    depths = range(LEAST_DEPTH, MOST_DEPTH + 1, 2)
    cell = lambda d: F.struct(F.shiftright("cx", MOST_DEPTH - d), F.shiftright("cy", MOST_DEPTH - d))
    found = fine.agg(F.count(F.lit(1)).alias("n"), *(F.approx_count_distinct(F.xxhash64(cell(d)), 0.02).alias(f"d{d}") for d in depths)).first()
    return next((d for d in depths if found[f"d{d}"] >= found.n / 2), MOST_DEPTH)


def _cells(stars: DataFrame, depth: int) -> DataFrame:
    """(level, cx, cy, m, mx, my): mass and its middle of the occupied cells of each level from 2."""
    fine = stars.groupBy("cx", "cy").agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("x")).alias("mx"), F.sum(F.col("mass") * F.col("y")).alias("my"))
    rows = fine.select("*", F.explode(F.sequence(F.lit(2), F.lit(depth))).alias("level"))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    sums = rows.groupBy("level", up("cx").alias("cx"), up("cy").alias("cy")).agg(*(F.sum(c).alias(c) for c in ("m", "mx", "my"))).where("m > 0")
    return sums.select("level", "cx", "cy", "m", (F.col("mx") / F.col("m")).alias("mx"), (F.col("my") / F.col("m")).alias("my"))


def _steps(columns: range, rows: range, but: int = -1) -> Column:
    """Array of steps (dx, dy), without those of at most `but` on both sides."""
    step = lambda i, j: F.struct(F.lit(i).cast("bigint").alias("dx"), F.lit(j).cast("bigint").alias("dy"))
    return F.array(*(step(i, j) for i in columns for j in rows if max(abs(i), abs(j)) > but))


def _far_steps(reach: int) -> Column:
    """Steps to the cells that are near the parent's cell and not near the own one; which these are follows from whether
    a cell is the first or the second of its parent on each side."""
    side = (range(-2 * reach, 2 * reach + 2), range(-2 * reach - 1, 2 * reach + 1))
    odd = lambda c: F.col(c).bitwiseAND(1) == 1
    at = lambda i: F.when(odd("cy"), _steps(side[i], side[1], reach)).otherwise(_steps(side[i], side[0], reach))
    return F.when(odd("cx"), at(1)).otherwise(at(0))


def _around(cells: DataFrame, steps: Column) -> DataFrame:
    """Each cell with each cell that the steps lead to (tx, ty)."""
    return cells.select("*", F.explode(steps).alias("d")).select("*", (F.col("cx") + F.col("d.dx")).alias("tx"), (F.col("cy") + F.col("d.dy")).alias("ty"))


def _felt(stars: DataFrame, cells: DataFrame, depth: int, reach: int, everywhere: bool) -> DataFrame:
    """(artist_id, fx, fy): repulsion by all others, of stars placed in cells of a depth; cells: _cells() of them.
    everywhere: give all cells to all tasks, so that each cell is met and summed up where it lies; else pairs are shuffled."""
    given = F.broadcast if everywhere else lambda df: df
    target = cells.select("level", F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("m").alias("tm"), F.col("mx").alias("ux"), F.col("my").alias("uy"))
    met = _around(cells, _far_steps(reach)).join(given(target), ["level", "tx", "ty"])
    dx, dy = F.col("ux") - F.col("mx"), F.col("uy") - F.col("my")
    d2 = dx * dx + dy * dy
    soft = F.greatest(d2, F.lit(SOFTENING))
    bend = lambda whole: F.when(d2 > SOFTENING, whole / (d2 * d2)).otherwise(0.0)
    sums = {"fx": -dx * F.col("tm") / soft, "fy": -dy * F.col("tm") / soft, "jxx": F.col("tm") * bend(dy * dy - dx * dx), "jxy": F.col("tm") * bend(-2 * dx * dy)}
    local = met.groupBy("level", "cx", "cy", "mx", "my").agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    # What the finest cells get from those above them, each changed by the way between their middles
    fine = cells.where(F.col("level") == depth).select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("mx").alias("px"), F.col("my").alias("py"))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
    chain = fine.select("*", F.explode(F.sequence(F.lit(2), F.lit(depth))).alias("level")).select("*", up("x").alias("cx"), up("y").alias("cy")).join(local, ["level", "cx", "cy"])
    sx, sy = F.col("px") - F.col("mx"), F.col("py") - F.col("my")
    moved = {"fx": F.col("fx") + F.col("jxx") * sx + F.col("jxy") * sy, "fy": F.col("fy") + F.col("jxy") * sx - F.col("jxx") * sy, "jxx": F.col("jxx"), "jxy": F.col("jxy")}
    above = chain.groupBy(F.col("x").alias("cx"), F.col("y").alias("cy")).agg(*(F.sum(v).alias(k) for k, v in moved.items()))
    # The finest cells near each other, at most (2 reach + 1) squared of them
    close = cells.where(F.col("level") == depth)
    own = (F.col("d.dx") == 0) & (F.col("d.dy") == 0)
    close = _around(close, _steps(range(-reach, reach + 1), range(-reach, reach + 1))).join(given(target.where(F.col("level") == depth)), ["level", "tx", "ty"]).select("cx", "cy", "mx", "my", F.struct("tm", "ux", "uy", own.alias("own")).alias("c"))
    close = close.groupBy("cx", "cy", "mx", "my").agg(F.collect_list("c").alias("near"))
    rows = stars.select("artist_id", "cx", "cy", "x", "y", "mass").join(close.join(above, ["cx", "cy"], "left"), ["cx", "cy"])

    def push(c: Column) -> Column:
        """struct<fx, fy> of one mass; a star's own cell counts without the star."""
        left = F.when(c["own"], c["tm"] - F.col("mass")).otherwise(c["tm"])
        at = lambda u, p: F.when(c["own"], (c["tm"] * c[u] - F.col("mass") * F.col(p)) / left).otherwise(c[u]) - F.col(p)
        vx, vy = at("ux", "x"), at("uy", "y")
        strength = left / F.greatest(vx * vx + vy * vy, F.lit(SOFTENING))
        return F.when(left > 1e-12, F.struct((-vx * strength).alias("fx"), (-vy * strength).alias("fy"))).otherwise(F.struct(F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy")))

    total = F.aggregate(F.transform("near", push), F.struct(F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy")), lambda s, p: F.struct((s["fx"] + p["fx"]).alias("fx"), (s["fy"] + p["fy"]).alias("fy")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ox, oy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    rows = rows.withColumn("n", total)
    return rows.select("artist_id", (F.col("n.fx") + zero("fx") + zero("jxx") * ox + zero("jxy") * oy).alias("fx"), (F.col("n.fy") + zero("fy") + zero("jxy") * ox - zero("jxx") * oy).alias("fy"))


def _pulled(stars: DataFrame, ways: DataFrame, everywhere: bool) -> DataFrame:
    """(artist_id, px, py): the weighted sum of the neighbours' places. `ways` lie sorted by artist, so that what a task
    passes on is about one sum for each of its artists. everywhere: give all places to all tasks; else ways are shuffled."""
    place = stars.select(F.col("artist_id").alias("other_id"), "x", "y")
    rows = ways.join(F.broadcast(place) if everywhere else place, "other_id")
    return rows.groupBy("artist_id").agg(F.sum(F.col("score") * F.col("x")).alias("px"), F.sum(F.col("score") * F.col("y")).alias("py"))


def run(edges: DataFrame, iterations: int = ITERATIONS, seed: int = SEED, reach: int = REACH, movement: list[float] | None = None) -> DataFrame:
    """(artist_id, x, y) after a fixed number of rounds. Each round's places are written to the shared folder, so that
    plans stay short and a lost executor costs one round; the round before is then deleted. movement: gets the sum of
    the stars' steps, round by round. Without edges the result is empty.

    The edges are read once: they are dealt by hash, as ranges would be sampled in a pass of their own, and the stars come
    from the ways as written; these are written before they are ranked, which samples them too."""
    ways = stage(both_ways(edges).withColumn("score", F.col("score").cast("double")).repartition("artist_id").sortWithinPartitions("artist_id"), "ways")
    zero = F.lit(0.0)
    stars = stage(spiral(stage(_ends(ways), "nodes"), seed).withColumns({"vx": zero, "vy": zero}), "stars")
    n = stars.count()
    for t in range(iterations if n else 0):
        heat = 1 - t / iterations * (1 - LAST_HEAT)
        depth = fitting_depth(stars) if t % DEPTH_ROUNDS == 0 else depth
        placed = _placed(stars, depth)
        cells = stage(_cells(placed, depth), "cells")
        felt = _felt(placed, cells, depth, reach, cells.count() <= EVERYWHERE)
        moved = placed.join(felt, "artist_id", "left").join(_pulled(stars, ways, n <= EVERYWHERE), "artist_id", "left")
        force = lambda f, p, at: (F.coalesce(f, zero) + F.coalesce(p, zero) - F.col("mass") * F.col(at)) / F.greatest(F.col("degree"), F.lit(1))
        speed = {v: (F.col(v) + force(f, p, at)) * (DAMPING * heat) for v, f, p, at in (("vx", "fx", "px", "x"), ("vy", "fy", "py", "y"))}
        moved = moved.withColumns(speed)
        slow = F.least(F.lit(1.0), LONGEST_STEP / F.greatest(F.hypot("vx", "vy"), F.lit(1e-12)))
        moved = moved.withColumn("slow", slow).withColumns({"vx": F.col("vx") * F.col("slow"), "vy": F.col("vy") * F.col("slow")})
        moved = moved.select("artist_id", "degree", "mass", "index", (F.col("x") + F.col("vx")).alias("x"), (F.col("y") + F.col("vy")).alias("y"), "vx", "vy")
        before, stars = stars, stage(moved, "stars")
        discard(before, cells)
        if movement is not None:
            movement.append(stars.agg(F.sum(F.hypot("vx", "vy")).alias("s")).first().s)
    return stars.select("artist_id", "x", "y")


def repulsion(stars: DataFrame, reach: int = REACH, depth: int | None = None, everywhere: int = EVERYWHERE) -> DataFrame:
    """(artist_id, fx, fy) of stars (artist_id, x, y, mass), for checks against the sum over all pairs."""
    depth = depth or fitting_depth(stars)
    placed = _placed(stars, depth)
    cells = stage(_cells(placed, depth), "cells")
    return _felt(placed, cells, depth, reach, cells.count() <= everywhere)


def pair_distance(edges: DataFrame, positions: DataFrame, distance: Column | None = None) -> DataFrame:
    """Edges with the distance of their ends."""
    a = positions.select(F.col("artist_id").alias("source_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = positions.select(F.col("artist_id").alias("target_id"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "source_id").join(b, "target_id").withColumn("distance", F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")))
