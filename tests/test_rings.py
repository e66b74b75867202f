"""Whole polygons against the cells they enclose, for several block sizes."""

import random

import pytest
from pyspark.sql import functions as F

from canopygrid.operators import rings


def plane(spark, cells):
    return spark.createDataFrame([(r, c, v) for (r, c), v in sorted(cells.items())], "row int, col int, lc int")


def features(df):
    return sorted((r.comp, r.lc, r.n_px, r.n_vertices, r.perimeter, [[(p.x, p.y) for p in ring] for ring in r.rings]) for r in df.collect())


def enclosed(ring, rows, cols):
    """Cells whose centre lies inside, by crossings of the row's centre line."""
    inside = set()
    for r in range(rows):
        xs = sorted(a[0] for a, b in zip(ring, ring[1:]) if min(a[1], b[1]) <= r < max(a[1], b[1]))
        for x0, x1 in zip(xs[::2], xs[1::2]):
            inside |= {(r, c) for c in range(int(x0), int(x1))}
    return inside


def corners(cells, region):
    """Right and left turns of a region's outline, cell by cell."""
    right = left = 0
    for r, c in region:
        for (fy, fx), (oy, ox) in zip(((0, 1), (1, 0), (0, -1), (-1, 0)), ((-1, 0), (0, 1), (1, 0), (0, -1))):
            if (r + oy, c + ox) not in region:
                ahead = (r + fy, c + fx) in region
                right += not ahead
                left += ahead and (r + fy + oy, c + fx + ox) in region
    return right, left


def test_polygons_are_whole(spark):
    rnd = random.Random(4)
    cells = {(r, c): rnd.choice([0, 3, 3, 4]) for r in range(26) for c in range(31)}
    got = {b: features(rings.city_polygons(plane(spark, cells), block=b)) for b in (4, 9, 64)}
    assert got[4] == got[9] == got[64]
    seen = set()
    for comp, lc, n_px, n_vertices, perimeter, (outer, *holes) in got[9]:
        region = enclosed(outer, 26, 31)
        for hole in holes:
            inner = enclosed(hole, 26, 31)
            assert inner <= region
            region -= inner
        assert len(region) == n_px and {cells[x] for x in region} == {lc} and min(r * rings.STRIDE + c for r, c in region) == comp
        assert not region & seen
        seen |= region
        right, left = corners(cells, region)
        assert n_vertices == right + left == sum(len(r) - 1 for r in [outer, *holes])
        assert len(holes) == 1 - (right - left) // 4
        assert perimeter == sum((r + i, c + j) not in region for r, c in region for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        for ring in [outer, *holes]:
            assert ring[0] == ring[-1] == min(ring, key=lambda p: (p[1], p[0]))
    assert seen == {x for x, v in cells.items() if v}


def test_long_ring_over_many_blocks(spark):
    """A snake crosses hundreds of block edges; its ring is one all the same."""
    cells = {(r, c): 5 for r in range(0, 24, 2) for c in range(40)} | {(r, 39 if r % 4 == 1 else 0): 5 for r in range(1, 23, 2)}
    (one,) = features(rings.city_polygons(plane(spark, cells), block=3))
    (two,) = features(rings.city_polygons(plane(spark, cells), block=100))
    assert one == two and one[2] == len(cells) and len(one[5]) == 1


def test_map_units_and_no_cells(spark):
    cells = {(r, c): 1 for r in range(5) for c in range(5) if (r, c) != (2, 2)}
    t = (0.5, 0.0, 100.0, 0.0, -0.5, 200.0)
    ((_, _, n_px, n_vertices, perimeter, (outer, hole)),) = features(rings.city_polygons(plane(spark, cells), block=2, transform=t))
    assert (n_px, n_vertices, perimeter) == (24, 8, 24)
    assert outer == [(100.0, 200.0), (102.5, 200.0), (102.5, 197.5), (100.0, 197.5), (100.0, 200.0)]
    assert sorted(set(hole)) == [(101.0, 198.5), (101.0, 199.0), (101.5, 198.5), (101.5, 199.0)]
    assert rings.city_polygons(plane(spark, cells).where("lc > 1")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 65])
def test_cycles(spark, n):
    ids = random.Random(n).sample(range(1000), 3 * n)
    cycles = [ids[:n], ids[n:]]
    links = spark.createDataFrame([(a, b) for c in cycles for a, b in zip(c, c[1:] + c[:1])], "head long, next long")
    got = {r.head: (r.ring, r.place) for r in rings.rank_cycles(links).collect()}
    assert got == {r.head: (r.ring, r.place) for r in rings.rank_cycles(links, part=0).collect()}  # a join per round
    for c in cycles:
        least = c.index(min(c))
        for i, x in enumerate(c):
            assert got[x] == (min(c), -((least - i) % len(c)))
    assert rings.rank_cycles(links.where(F.lit(False))).count() == 0
