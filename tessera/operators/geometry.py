"""Geometry of footprints on integer tiles; right and bottom edges are exclusive. All are column expressions that stay in
generated code. A footprint is named by a prefix: x, y, r (right) and b (bottom) with that prefix are its columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.domain import ENTITY_TYPES, GROUND_TYPES, NEAR_TILES


class Box:
    """The columns of a footprint, from columns `<prefix>x ...` or from the fields of a struct."""

    def __init__(self, source: str | Column = "") -> None:
        get = (lambda c: F.col(f"{source}{c}")) if isinstance(source, str) else source.getField
        self.x, self.y, self.r, self.b = (get(c) for c in "xyrb")


def layer(kind: Column) -> Column:
    """0 for ground, 2 for entities, 1 for all else."""
    return F.when(kind.isin(*GROUND_TYPES), 0).when(kind.isin(*ENTITY_TYPES), 2).otherwise(1)


def overlaps(a: Box, b: Box) -> Column:
    """The two share a tile."""
    return (a.x < b.r) & (b.x < a.r) & (a.y < b.b) & (b.y < a.b)


def contains(outer: Box, inner: Box) -> Column:
    """All of inner's tiles are outer's."""
    return (outer.x <= inner.x) & (outer.y <= inner.y) & (inner.r <= outer.r) & (inner.b <= outer.b)


def same_bounds(a: Box, b: Box) -> Column:
    """Identical footprints."""
    return (a.x == b.x) & (a.y == b.y) & (a.r == b.r) & (a.b == b.b)


def distance(a: Box, b: Box) -> Column:
    """Steps, diagonal ones allowed, between the nearest tiles: 0 where they overlap, 1 where they touch."""
    return F.greatest(a.x - b.r + 1, b.x - a.r + 1, a.y - b.b + 1, b.y - a.b + 1, F.lit(0))


def shares_edge(a: Box, b: Box) -> Column:
    """Opposite edges coincide along at least one tile; touching corners and overlaps don't count."""
    beside = ((a.r == b.x) | (b.r == a.x)) & (F.greatest(a.y, b.y) < F.least(a.b, b.b))
    above = ((a.b == b.y) | (b.b == a.y)) & (F.greatest(a.x, b.x) < F.least(a.r, b.r))
    return beside | above


def touches_border(box: Box, width: Column, height: Column) -> Column:
    """Some side lies on the border of the map."""
    return (box.x == 0) | (box.y == 0) | (box.r == width) | (box.b == height)


def in_bounds(box: Box, width: Column, height: Column) -> Column:
    """The footprint ends within the map."""
    return (box.r <= width) & (box.b <= height)


def edge_valid(kind: Column, source: Box, target: Box) -> Column:
    """The geometry bears out a relation of the given type."""
    inside = contains(target, source) & ~same_bounds(target, source)
    return F.when(kind == "near", distance(source, target) <= NEAR_TILES).when(kind == "inside", inside).otherwise(shares_edge(source, target))
