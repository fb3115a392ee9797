"""Pairs of points within a distance, by a grid: an equality join on cells in place of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(radius: float) -> list[Column]:
    return [F.floor(F.col(c) / radius).alias(f"c{c}") for c in "xyz"]


def within(left: DataFrame, right: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Rows of left and right with equal keys whose x, y, z lie within radius (inclusive), with their distance.

    Columns other than keys come out as left_* and right_*. Space is cut into
    cubes of edge radius; each left point looks into the 27 around its own, so
    that work follows the density of points and no pair further apart than two
    cubes is formed. Rows with a null place or key meet nothing.
    """
    named = lambda df, side: df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in keys], *_cells(radius))
    a = named(left, "left")
    for c in ("cx", "cy", "cz"):
        a = a.withColumn(c, F.explode(F.array(*[F.col(c) + k for k in (-1, 0, 1)])))
    b = named(right, "right")
    apart = F.sqrt(sum(((F.col(f"left_{c}") - F.col(f"right_{c}")) * (F.col(f"left_{c}") - F.col(f"right_{c}")) for c in "xyz"), F.lit(0.0)))
    met = a.join(b, [*keys, "cx", "cy", "cz"]).drop("cx", "cy", "cz")
    return met.withColumn("distance", apart).filter(F.col("distance") <= radius)


#: A cell itself and half of those around it: of two neighbouring cells one looks into the other.
HALF = [(0, 0, 0)] + [(dx, dy, dz) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) > (0, 0, 0)]


def pairs_within(points: DataFrame, radius: float, keys: list[str], order: str) -> DataFrame:
    """within(points, points) where left's order is below right's, each pair formed once: a point looks into 14 cells, not 27."""
    named = lambda side: points.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in points.columns if c not in keys], *_cells(radius))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz")) for dx, dy, dz in HALF]))
    a = named("left").withColumn("o", around)
    a = a.withColumns({"own": (F.col("o.dx") == 0) & (F.col("o.dy") == 0) & (F.col("o.dz") == 0), **{f"c{c}": F.col(f"c{c}") + F.col(f"o.d{c}") for c in "xyz"}}).drop("o")
    apart = F.sqrt(sum(((F.col(f"left_{c}") - F.col(f"right_{c}")) * (F.col(f"left_{c}") - F.col(f"right_{c}")) for c in "xyz"), F.lit(0.0)))
    met = a.join(named("right"), [*keys, "cx", "cy", "cz"]).withColumn("distance", apart).filter(F.col("distance") <= radius)
    first, second = F.col(f"left_{order}"), F.col(f"right_{order}")
    met = met.filter((first < second) | (~F.col("own") & (first > second)))
    turned = first > second
    others = [c for c in points.columns if c not in keys]
    pick = lambda c, a, b: F.when(turned, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{a}_{c}")
    return met.select(*keys, *[pick(c, "left", "right") for c in others], *[pick(c, "right", "left") for c in others], "distance")
