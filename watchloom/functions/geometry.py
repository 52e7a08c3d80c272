"""Plane geometry on columns: boxes, polygons, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def centre(box: Column) -> tuple[Column, Column]:
    """Centre of [x, y, width, height]."""
    return box[0] + box[2] / 2, box[1] + box[3] / 2


def corner_centre(box: Column) -> tuple[Column, Column]:
    """Centre of [x1, y1, x2, y2]."""
    at = lambda i: F.get(box, i)
    return (at(0) + at(2)) / 2, (at(1) + at(3)) / 2


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule over the polygon's edges; fewer than three corners hold nothing."""
    n = F.size(polygon)

    def crossed(i: Column) -> Column:
        a, b = polygon[i], polygon[F.when(i == 0, n - 1).otherwise(i - 1)]
        slope = (b[0] - a[0]) * (y - a[1]) / F.when(b[1] - a[1] == 0, 1e-12).otherwise(b[1] - a[1]) + a[0]
        return ((a[1] > y) != (b[1] > y)) & (x < slope)

    odd = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda acc, i: acc != crossed(i))
    return F.coalesce(F.when(n >= 3, odd), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two [x, y, width, height]."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a[2] * a[3] + b[2] * b[3] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def centroid_distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def parsed_boxes(text: Column) -> Column:
    """Boxes written as <x1><y1><x2><y2> in thousandths; inverted ones go."""
    found = F.regexp_extract_all(text, F.lit(r"<(\d+)><(\d+)><(\d+)><(\d+)>"), F.lit(0))
    boxes = F.transform(found, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda v: v.cast("double") / 1000))
    sound = F.filter(boxes, lambda b: (b[2] > b[0]) & (b[3] > b[1]))
    return F.transform(sound, lambda b: F.array(b[0], b[1], b[2] - b[0], b[3] - b[1]))
