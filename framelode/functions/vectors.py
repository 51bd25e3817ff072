"""Vector, set and box measures on columns. Each of the variants that differ only in their null rule has its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Of unit vectors; nothing is normalised."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing or zero, or lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 where a vector is missing."""
    return F.coalesce(1 - cosine(a, b), F.lit(0.0))


def normalize(a: Column) -> Column:
    """Null for zero and non-finite vectors."""
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n), F.transform(a, lambda x: x / n))


def is_valid(a: Column, dimension: int, tolerance: float = 0.001) -> Column:
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimension) & finite & (F.abs(norm(a) - 1) <= tolerance), F.lit(False))


def _sets(a: Column, b: Column) -> tuple[Column, Column]:
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Null if either is empty."""
    both, any_ = _sets(a, b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / any_)


def jaccard_distance(a: Column, b: Column) -> Column:
    """0 if both are empty."""
    both, any_ = _sets(a, b)
    return F.when(any_ > 0, 1 - both / any_).otherwise(0.0)


def jaccard_full(a: Column, b: Column) -> Column:
    """1 if both are empty."""
    both, any_ = _sets(a, b)
    return F.when(any_ > 0, both / any_).otherwise(1.0)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two grids."""
    return F.when(F.size(a) == F.size(b), _mean(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of two grids; 1 where one is flat."""
    x, y = (F.transform(v, lambda e: e.cast("double")) for v in (a, b))
    mx, my = _mean(x), _mean(y)
    cov = F.aggregate(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)), F.lit(0.0), lambda s, e: s + e)
    var = F.aggregate(x, F.lit(0.0), lambda s, e: s + (e - mx) * (e - mx)) * F.aggregate(y, F.lit(0.0), lambda s, e: s + (e - my) * (e - my))
    return F.when(var > 0, cov / F.sqrt(var)).otherwise(1.0)


def histogram_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def entropy(histogram: Column, bins: int = 32) -> Column:
    """Of a histogram, as a share of the most it can be."""
    total = F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x)
    part = lambda x: F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(0.0)
    return F.when(total > 0, F.aggregate(F.transform(histogram, part), F.lit(0.0), lambda s, x: s + x) / F.log2(F.lit(float(bins))))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normalized_value(c: Column, p10: Column, p90: Column) -> Column:
    """Where ``c`` lies between two percentiles, in 0 to 1; one half if they are equal."""
    return F.when(p90 > p10, clamp((c - p10) / (p90 - p10), 0.0, 1.0)).otherwise(0.5)


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """A box ``[x1, y1, x2, y2]`` in unit coordinates, from pixels if any value exceeds 1.5; null if it has no area."""
    pixels = F.exists(box, lambda v: v > 1.5)
    x = lambda i: clamp(F.when(pixels, box[i] / width).otherwise(box[i]), 0.0, 1.0)
    y = lambda i: clamp(F.when(pixels, box[i] / height).otherwise(box[i]), 0.0, 1.0)
    made = F.array(x(0), y(1), x(2), y(3))
    return F.when((F.size(box) == 4) & (made[2] > made[0]) & (made[3] > made[1]), made)


def box_area(b: Column) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def center_distance(b: Column) -> Column:
    dx, dy = (b[0] + b[2]) / 2 - 0.5, (b[1] + b[3]) / 2 - 0.5
    return F.sqrt(dx * dx + dy * dy)


def touches_edge(b: Column, margin: float = 0.02) -> Column:
    return (b[0] <= margin) | (b[1] <= margin) | (b[2] >= 1 - margin) | (b[3] >= 1 - margin)


def decode_box(cx: Column, cy: Column, distances: Column, stride: Column) -> Column:
    """A box from an anchor's centre and its distances to the four sides."""
    d = [distances[i] * stride for i in range(4)]
    return F.array(cx - d[0], cy - d[1], cx + d[2], cy + d[3])


def change_class(mad: Column, area: Column, edge: Column, histogram: Column) -> Column:
    """How much a frame differs from the one before it."""
    return (
        F.when((mad < 0.015) & (area < 0.04) & (histogram < 0.050), "near_duplicate")
        .when((mad < 0.040) & (area < 0.12) & (histogram < 0.120), "minor_motion")
        .when((mad < 0.105) & (area < 0.34) & (edge < 0.050), "normal_change")
        .otherwise("strong_change")
    )


def step_confidence(step: Column, overlap: Column) -> Column:
    """Confidence of a label carried over so many frames, with so many shared labels."""
    base = F.when(step == 1, 0.85).when(step == 2, 0.75).when(step == 3, 0.65).otherwise(F.greatest(F.lit(0.35), 0.85 - 0.10 * (step - 1)))
    return F.round(clamp(base + F.when(overlap <= 1, -0.05).when(overlap >= 3, 0.03).otherwise(0.0), 0.1, 0.95), 3)


def category_for(label: Column, families: dict[str, list[str]], weak: tuple[str, ...] = ()) -> Column:
    """Weak labels first; else the first family, in order, that holds the label or a part of it; else ``other``."""
    found = F.when(label.isin(*weak), "weak") if weak else F
    for name, terms in families.items():
        hit = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(label, t))
        found = found.when(hit, name)
    return found.otherwise("other")


def image_quality(luma: Column, std: Column, ent: Column, edge: Column, dark: Column, bright: Column) -> Column:
    usable = 1 - F.least(F.abs(luma - 0.5) / 0.5, F.lit(1.0))
    penalty = F.least(F.lit(0.8), dark * 0.55 + bright * 0.45)
    return 0.24 * usable + 0.24 * F.least(std / 0.28, F.lit(1.0)) + 0.30 * ent + 0.22 * F.least(edge / 0.24, F.lit(1.0)) - penalty


def change_score(mad: Column, area: Column, edge: Column, histogram: Column, luma: Column) -> Column:
    return mad * 2.2 + area * 0.9 + edge * 1.6 + histogram * 0.7 + luma * 0.9
