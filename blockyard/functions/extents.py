"""Inclusive cuboids as struct columns, and positions.

A cuboid is ``struct<minX,maxX,minY,maxY,minZ,maxZ>`` of longs; the empty one is
null.  +x is east, +y up and +z south.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import STEPS

SIDES = ("minX", "maxX", "minY", "maxY", "minZ", "maxZ")
TYPE = "struct<" + ",".join(f"{s}:bigint" for s in SIDES) + ">"


class Box(NamedTuple):
    """A cuboid known on the driver; empty if a maximum is below its minimum."""

    minX: int
    maxX: int
    minY: int
    maxY: int
    minZ: int
    maxZ: int

    @classmethod
    def at(cls, x: int, y: int, z: int, width: int, height: int, length: int) -> Box:
        """From the least corner and the size along x, y and z."""
        return cls(x, x + width - 1, y, y + height - 1, z, z + length - 1)

    @property
    def empty(self) -> bool:
        return self.maxX < self.minX or self.maxY < self.minY or self.maxZ < self.minZ

    @property
    def size(self) -> tuple[int, int, int]:
        """Width (x), height (y) and length (z); zeros if empty."""
        return (0, 0, 0) if self.empty else (self.maxX - self.minX + 1, self.maxY - self.minY + 1, self.maxZ - self.minZ + 1)

    def offset(self, dx: int, dy: int, dz: int) -> Box:
        return self if self.empty else Box(self.minX + dx, self.maxX + dx, self.minY + dy, self.maxY + dy, self.minZ + dz, self.maxZ + dz)

    def column(self) -> Column:
        return F.lit(None).cast(TYPE) if self.empty else box(*map(F.lit, self))

    def holds(self, x: Column, y: Column, z: Column) -> Column:
        """Whether a position lies inside; never for the empty cuboid.  Pushes down to scans."""
        if self.empty:
            return F.lit(False)
        return x.between(self.minX, self.maxX) & y.between(self.minY, self.maxY) & z.between(self.minZ, self.maxZ)


def box(min_x: Column, max_x: Column, min_y: Column, max_y: Column, min_z: Column, max_z: Column) -> Column:
    """Struct of the six bounds, or null if they hold nothing."""
    parts = [c.cast("long").alias(s) for s, c in zip(SIDES, (min_x, max_x, min_y, max_y, min_z, max_z))]
    return F.when((min_x <= max_x) & (min_y <= max_y) & (min_z <= max_z), F.struct(*parts))


def bounds(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Aggregate: the least cuboid round the rows' positions; null without rows."""
    return box(F.min(x), F.max(x), F.min(y), F.max(y), F.min(z), F.max(z))


def width(e: Column) -> Column:
    return F.coalesce(e["maxX"] - e["minX"] + 1, F.lit(0))


def height(e: Column) -> Column:
    return F.coalesce(e["maxY"] - e["minY"] + 1, F.lit(0))


def length(e: Column) -> Column:
    return F.coalesce(e["maxZ"] - e["minZ"] + 1, F.lit(0))


def contains(e: Column, x: Column, y: Column, z: Column) -> Column:
    """Position inside; false for the empty cuboid."""
    inside = x.between(e["minX"], e["maxX"]) & y.between(e["minY"], e["maxY"]) & z.between(e["minZ"], e["maxZ"])
    return F.coalesce(inside, F.lit(False))


def within(inner: Column, outer: Column) -> Column:
    """Whole cuboid inside another; an empty inner one is not."""
    out = (inner["minX"] >= outer["minX"]) & (inner["maxX"] <= outer["maxX"])
    out &= (inner["minY"] >= outer["minY"]) & (inner["maxY"] <= outer["maxY"])
    out &= (inner["minZ"] >= outer["minZ"]) & (inner["maxZ"] <= outer["maxZ"])
    return F.coalesce(out, F.lit(False))


def intersection(a: Column, b: Column) -> Column:
    """Common cuboid, null if there is none."""
    low = lambda s: F.greatest(a[s], b[s])
    high = lambda s: F.least(a[s], b[s])
    both = box(low("minX"), high("maxX"), low("minY"), high("maxY"), low("minZ"), high("maxZ"))
    return F.when(a.isNotNull() & b.isNotNull(), both)


def intersects(a: Column, b: Column) -> Column:
    return intersection(a, b).isNotNull()


def union(a: Column, b: Column) -> Column:
    """Least cuboid round both; the empty one changes nothing."""
    low = lambda s: F.least(a[s], b[s])
    high = lambda s: F.greatest(a[s], b[s])
    both = box(low("minX"), high("maxX"), low("minY"), high("maxY"), low("minZ"), high("maxZ"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def offset(e: Column, dx: Column, dy: Column, dz: Column) -> Column:
    return box(e["minX"] + dx, e["maxX"] + dx, e["minY"] + dy, e["maxY"] + dy, e["minZ"] + dz, e["maxZ"] + dz)


def minimum(e: Column) -> Column:
    return F.when(e.isNotNull(), F.struct(e["minX"].alias("x"), e["minY"].alias("y"), e["minZ"].alias("z")))


def maximum(e: Column) -> Column:
    return F.when(e.isNotNull(), F.struct(e["maxX"].alias("x"), e["maxY"].alias("y"), e["maxZ"].alias("z")))


def step(x: Column, y: Column, z: Column, way: str) -> tuple[Column, Column, Column]:
    """Position one step north, south, east, west, up or down."""
    dx, dy, dz = STEPS[way]
    return x + dx, y + dy, z + dz
