"""Conditions, and the predicates on derived columns that they imply.

Catalyst does not infer a range of a derived column from a range of its source; the
builders here add it, so that a scan of a table sorted by cell or partitioned by day
skips row groups and directories.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraquery.functions import codes as C


def both(*conditions: Column | None) -> Column:
    """Conjunction of the conditions given; true if there are none."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


@dataclass(frozen=True)
class IdEquals:
    value: str


@dataclass(frozen=True)
class TypeEquals:
    value: str


@dataclass(frozen=True)
class TimeRange:
    """Closed range of epoch milliseconds."""

    start: int
    end: int

    def exact(self, col: str) -> Column:
        return F.col(col).between(F.lit(self.start), F.lit(self.end))

    def days(self) -> tuple[int, int]:
        day = lambda ms: int(datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y%m%d"))
        return day(self.start), day(self.end)

    def implied(self, col: str, month: str | None = None) -> Column:
        """The days, and the months by which stored facts are divided into folders."""
        a, b = self.days()
        inside = F.col(col).between(F.lit(a), F.lit(b))
        return inside if month is None else inside & F.col(month).between(F.lit(a // 100), F.lit(b // 100))


@dataclass(frozen=True)
class Box:
    """Closed box; touching counts."""

    x0: float
    y0: float
    z0: float
    x1: float
    y1: float
    z1: float

    def axis(self, i: int) -> tuple[float, float]:
        return ((self.x0, self.x1), (self.y0, self.y1), (self.z0, self.z1))[i]

    def contains(self, *xyz: str) -> Column:
        return both(*[F.col(c).between(*map(F.lit, self.axis(i))) for i, c in enumerate(xyz)])

    def intersects(self, *bounds: str) -> Column:
        """Overlap with the box of columns x_min, x_max, y_min, ...; a NaN bound overlaps nothing."""
        out = []
        for i in range(3):
            lo, hi = F.col(bounds[2 * i]), F.col(bounds[2 * i + 1])
            a, b = self.axis(i)
            out += [lo <= F.lit(b), hi >= F.lit(a), ~F.isnan(lo), ~F.isnan(hi)]
        return both(*out)


@dataclass(frozen=True)
class Range:
    """Closed range of one attribute; a reversed range holds nothing."""

    lo: float
    hi: float

    def exact(self, col: str) -> Column:
        return F.col(col).between(F.lit(self.lo), F.lit(self.hi))


def within_blocks(index: tuple[Column, Column, Column], size: tuple[int, int, int], lo: tuple[int, int, int], hi: tuple[int, int, int], max_cells: int | None = None) -> Column:
    """Indices in the blocks, ``size`` long, of a closed block box; with ``max_cells`` only the first ones, x slowest.

    The conditions are ranges of the bare index columns, which a scan can compare with the
    bounds of its row groups.  Block numbers are truncated towards zero.  The limit
    reproduces an enumeration that stops, in closed form.
    """
    inside = both(*[c.between(F.lit(C.block_from(a, n)), F.lit(C.block_to(b, n))) for c, n, a, b in zip(index, size, lo, hi)])
    if max_cells is None:
        return inside
    ny, nz = (b - a + 1 for a, b in list(zip(lo, hi))[1:])
    bx, by, bz = (C.block_of(c, n) for c, n in zip(index, size))
    place = ((bx - F.lit(lo[0])) * F.lit(ny) + (by - F.lit(lo[1]))) * F.lit(nz) + (bz - F.lit(lo[2]))
    return inside & (place < F.lit(max_cells))


def world_cells(ix: Column, iy: Column, iz: Column, lo: tuple[int, int, int], hi: tuple[int, int, int], level: int, max_cells: int | None = None) -> Column:
    """Membership of normalised indices in the cells of a level that touch an index box."""
    s = C.BITS - level
    return within_blocks((ix, iy, iz), (1 << s,) * 3, tuple(v >> s for v in lo), tuple(v >> s for v in hi), max_cells)


def code_cover(code: str, lo: tuple[int, int, int], hi: tuple[int, int, int], most: int = 16) -> Column:
    """The Morton codes of an index box as a few ranges, which may hold more but miss none.

    For facts sorted by code: the ranges skip what the index ranges of the three axes
    can't, as files far from the box span wide ranges of each axis.
    """
    from terraquery.plans.ranges import code_ranges

    hit = F.lit(False)
    for a, b in code_ranges(lo, hi, most):
        hit = hit | F.col(code).between(F.lit(a), F.lit(b))
    return hit


def selectivity(*conditions) -> float:
    """Product of fixed guesses (50 ids, 4 types, 30 days, share of the world box); for reports."""
    share = 1.0
    for c in conditions:
        if isinstance(c, IdEquals):
            share *= 1 / 50
        elif isinstance(c, TypeEquals):
            share *= 1 / 4
        elif isinstance(c, TimeRange):
            share *= min(1.0, max(0.0, (c.end - c.start) / (30 * 86_400_000)))
        elif isinstance(c, Box):
            for i, a in enumerate("xyz"):
                lo, hi = C.WORLD[a]
                p, q = c.axis(i)
                share *= max(0.0, min(1.0, (q - p) / (hi - lo)))
    return share
