"""Repaired and clipped rings against even-odd coverage of the original ones."""

import math
import random

from pyspark.sql import functions as F

from canopygrid.functions import geometry as G
from canopygrid.operators import repair

RING = "array<struct<x:double,y:double>>"


def layer(spark, rings, extra=""):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r] if r is not None else None) for k, r in rings], f"fid long, ring {RING}")


def covered(rings, x, y):
    """Even-odd test over all rings of a feature."""
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ay <= y) != (by <= y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def crossing(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    eps = 1e-6
    return side(a, b, c) * side(a, b, d) < -eps and side(c, d, a) * side(c, d, b) < -eps


def closed(points):
    return [*points, points[0]]


STAR = closed([(10 + 9 * math.cos(2 * math.pi * 2 * k / 5 + 0.1), 10 + 9 * math.sin(2 * math.pi * 2 * k / 5 + 0.1)) for k in range(5)])


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.fid, []).append(([(p.x, p.y) for p in r.ring], r.repaired))
    return out


def shoelace(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2


def test_known_shapes(spark):
    shapes = [
        (1, closed([(0, 0), (4, 4), (4, 0), (0, 4)])),  # a bow tie: two triangles
        (2, closed([(0, 0), (6, 0), (6, 6), (0, 6)])),  # nothing to do
        (3, STAR),  # five points; the middle is covered twice
        (4, closed([(0, 0), (8, 0), (8, 8), (0, 8), (0, 0), (4, 0), (4, 4), (0, 4)])),  # a square goes out of a corner
        (5, closed([(0, 0), (8, 0), (8, 8), (0, 8)])), (5, closed([(2, 2), (4, 2), (4, 4), (2, 4)])),  # a hole, no meeting
        (6, closed([(0, 0), (8, 0), (8, 8), (0, 8)])), (6, closed([(4, 4), (12, 4), (12, 12), (4, 12)])),  # overlap is left out
        (7, None), (8, []), (9, closed([(0, 0), (5, 0)])),  # nothing there
        (10, closed([(0, 0), (4, 0), (4, 4), (0, 4)])), (10, closed([(0, 0), (4, 0), (4, 4), (0, 4)])),  # twice: covered evenly
        (11, closed([(0, 0), (10, 0), (10, 2), (5, 0), (0, 2)]))]  # a vertex touches an edge
    got = collected(repair.repair_rings(layer(spark, shapes), ["fid"]))
    areas = {k: sorted(round(shoelace(r), 6) for r, _ in v) for k, v in got.items()}
    assert areas[1] == [4, 4] and areas[4] == [48] and areas[6] == [48, 48] and areas[11] == [5, 5]
    assert areas[2] == [36] and not got[2][0][1] and {abs(x) for x in areas[5]} == {64, 4}
    assert len(areas[3]) == 5 and set(got) == {1, 2, 3, 4, 5, 6, 11}
    assert all(r[0] == r[-1] == min(r) for r, new in got[3] if new)


def test_random_rings_keep_their_pixels(spark):
    rnd = random.Random(11)
    shapes = {k: closed([(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(rnd.randint(3, 9))]) for k in range(40)}
    shapes |= {k: closed([(rnd.uniform(0, 30), rnd.uniform(0, 30)) for _ in range(rnd.randint(4, 8))]) for k in range(40, 70)}
    got = collected(repair.repair_rings(layer(spark, shapes.items()), ["fid"], cell=7.0))
    for k, ring in shapes.items():
        rings = [r for r, _ in got.get(k, [])]
        for i in range(31):
            for j in range(31):
                x, y = i + 0.4817, j + 0.5279
                assert covered([ring], x, y) == covered(rings, x, y)
        edges = [(a, b) for r in rings for a, b in zip(r, r[1:])]
        assert not any(crossing(*e, *f) for n, e in enumerate(edges) for f in edges[:n])
        if any(new for _, new in got.get(k, [])):
            grid = sum(covered([ring], (i + 0.5) / 4 + 0.003, (j + 0.5) / 4 + 0.002) for i in range(120) for j in range(120)) / 16
            assert abs(sum(map(shoelace, rings)) - grid) < 12  # left of each piece is area: signed areas add up


def test_clip(spark):
    rnd = random.Random(3)
    shapes = {k: closed([(rnd.randint(0, 20), rnd.randint(0, 20)) for _ in range(rnd.randint(3, 7))]) for k in range(40)}
    box = (4.0, 3.0, 15.0, 17.0)
    df = layer(spark, shapes.items()).withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), map(F.lit, box))))
    got = {r.fid: [(p.x, p.y) for p in r.ring] for r in repair.clip_rings(df).collect()}
    for k, ring in shapes.items():
        left = got.get(k, [])
        assert all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in left)
        for i in range(20):
            for j in range(20):
                x, y = i + 0.517, j + 0.483
                inside = box[0] < x < box[2] and box[1] < y < box[3]
                assert (inside and covered([ring], x, y)) == covered([left], x, y)
    comb = layer(spark, [(1, closed([(0, 0), (9, 0), (9, 9), (6, 9), (6, 2), (3, 2), (3, 9), (0, 9)]))])
    cut = comb.withColumn("ring", repair.clip_ring("ring", 0, 5, 9, 9))
    parts = collected(repair.repair_rings(cut, ["fid"]))[1]
    assert sorted(shoelace(r) for r, _ in parts) == [12, 12]  # the comb's two teeth
    assert repair.clip_rings(df.withColumn("xmin", F.lit(100.0)).withColumn("xmax", F.lit(110.0))).count() == 0
    assert comb.select(G.signed_area(repair.clip_ring("ring", -1, -1, 20, 20)).alias("a")).first().a == 81 - 21


def test_clip_is_made_once(spark):
    """The filter for usable rings and what is derived from a ring do not repeat the fold; boxes without area are not folded."""
    df = layer(spark, [(k, closed([(0, 0), (9, 0), (9, 9)])) for k in range(3)]).withColumns(
        {"xmin": F.lit(1.0) + F.col("fid"), "ymin": F.lit(0.0), "xmax": F.lit(3.0), "ymax": F.lit(8.0)})
    done = repair.clip_rings(df).select("fid", F.round(G.area("ring"), 6).alias("area"))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 3  # the fold, and two areas of its result
    assert {r.fid: r.area for r in done.collect()} == {0: 4.0, 1: 2.5}
