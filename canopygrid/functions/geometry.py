"""Ring expressions. A ring is array<struct<x, y>> with the first vertex repeated last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def box_ring(xmin, ymin, xmax, ymax) -> Column:
    return F.array(point(xmin, ymin), point(xmax, ymin), point(xmax, ymax),
                   point(xmin, ymax), point(xmin, ymin))


def literal_ring(vertices) -> Column:
    """Ring literal from (x, y) pairs; closed when the caller left it open."""
    v = list(vertices)
    if v[0] != v[-1]:
        v.append(v[0])
    return F.array(*[point(F.lit(float(x)), F.lit(float(y))) for x, y in v])


def edges(ring) -> Column:
    """array<struct<a, b>> of consecutive vertices (empty for a degenerate ring)."""
    r = _col(ring)
    n = F.greatest(F.size(r) - 1, F.lit(0))
    return F.arrays_zip(F.slice(r, F.lit(1), n).alias("a"), F.slice(r, F.lit(2), n).alias("b"))


def signed_area(ring) -> Column:
    """Shoelace sum; positive for counter-clockwise rings with y upwards."""
    return F.aggregate(
        edges(ring), F.lit(0.0),
        lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"],
        lambda acc: acc / 2.0,
    )


def area(ring) -> Column:
    return F.abs(signed_area(ring))


def bounds(ring) -> dict[str, Column]:
    r = _col(ring)
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys),
            "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def is_usable(ring) -> Column:
    """At least four vertices, closed, non-zero area, no missing ordinate."""
    r = _col(ring)
    closed = (F.get(r, F.lit(0))["x"] == F.try_element_at(r, F.lit(-1))["x"]) & (
        F.get(r, F.lit(0))["y"] == F.try_element_at(r, F.lit(-1))["y"])
    complete = F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.coalesce(r.isNotNull() & (F.size(r) >= 4) & complete & closed & (area(r) > 0),
                      F.lit(False))


def contains(ring, x, y) -> Column:
    """Even-odd test for one point and one ring that already share a row."""
    px, py = _col(x), _col(y)

    def toggle(acc, e):
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        cut = ax + F.try_divide((py - ay) * (bx - ax), by - ay)
        return F.when(((ay <= py) != (by <= py)) & (px < cut), ~acc).otherwise(acc)

    return F.aggregate(edges(ring), F.lit(False), toggle)


def clip_box(xmin, ymin, xmax, ymax, box) -> dict[str, Column]:
    """Intersection of a feature box with a patch box (empty when min > max)."""
    return {
        "xmin": F.greatest(_col(xmin), box[0]), "ymin": F.greatest(_col(ymin), box[1]),
        "xmax": F.least(_col(xmax), box[2]), "ymax": F.least(_col(ymax), box[3]),
    }
