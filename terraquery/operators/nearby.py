"""Points near other points, and the regions that contain a point.

Space is cut into vertical slabs of x and, inside each, into pieces of y, at sampled
quantiles, so that the tiles hold about equally many points wherever those gather.  A
tile is a task's share: it gets its points, those within reach of its border, and the
edges of the region borders that cross its slab.  One exchange of the points serves both
questions:

* regions: the edges of a slab are decomposed into trapezoids, and each point is located
  by a binary search for its strip and one among the strip's ordered edges;
* neighbours: a tile's positions are sorted by cell, and each looks up the cells around
  it by binary search.

Where ties or a hot spot make a tile too large, its points are spread over parts and
every pair of parts is a task of its own, so that no task gets more than two parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points aimed at in a tile, and sampled for each.
TILE_ROWS, TILE_SAMPLE = 20_000, 32
#: Tiles' worth of points up to which a hot tile stays whole, and that its parts hold; its points
#: are sent once for each part, so parts are large.
PART_TILES = 20
#: Rows of the sample at least; it goes to the driver, as the bounds of any range partition do.
LEAST_SAMPLE = 20_000
#: Pairs looked at, and trapezoids held, at once.
CHUNK, TRAPEZOIDS = 4_000_000, 2_000_000
#: Edges whose crossings are looked for at once.
EDGES = 2_000


def _known(cols: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return ok


# --- tiles


@dataclass(frozen=True)
class Tiles:
    """Slabs of x, the pieces of y in each, and how many parts each tile is spread over."""

    xs: np.ndarray
    ys: list[np.ndarray]
    parts: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, tile_rows: int) -> Tiles:
        """Tiles of about ``tile_rows`` of the rows, from a sample."""
        n = rows.count()
        tiles = max(1, -(-n // tile_rows))
        want = max(LEAST_SAMPLE, TILE_SAMPLE * tiles)
        seen = (rows.select("x", "y") if n <= want else rows.select("x", "y").sample(min(1.0, 1.1 * want / n), 7)).toPandas()
        return cls.cut(seen["x"].to_numpy("float64"), seen["y"].to_numpy("float64"), n, tile_rows)

    @classmethod
    def cut(cls, x: np.ndarray, y: np.ndarray, n: int, tile_rows: int) -> Tiles:
        scale = n / max(len(x), 1)
        slabs = int(np.ceil(np.sqrt(max(1, -(-n // tile_rows)))))
        xs = _cuts(x, slabs)
        at = np.searchsorted(xs, x, "right")
        ys, parts = [], []
        for s in range(len(xs) + 1):
            mine = y[at == s]
            ys.append(_cuts(mine, int(np.ceil(len(mine) * scale / tile_rows))))
            size = np.bincount(np.searchsorted(ys[-1], mine, "right"), minlength=len(ys[-1]) + 1) * scale
            parts.append(np.maximum(np.ceil(size / (PART_TILES * tile_rows)), 1))
        return cls(xs, ys, np.concatenate(parts).astype("int64"))

    @property
    def first(self) -> np.ndarray:
        """Number of each slab's first tile."""
        return np.cumsum([0, *[len(c) + 1 for c in self.ys]])

    @property
    def blocks(self) -> np.ndarray:
        """Number of each tile's first block; a tile of p parts has p(p+1)/2."""
        return np.cumsum(np.append(0, self.parts * (self.parts + 1) // 2))

    def bounds(self, tile: int) -> tuple[float, float, float, float]:
        """x from, x to, y from, y to; half-open."""
        slab = int(np.searchsorted(self.first, tile, "right")) - 1
        xs, ys = (np.concatenate([[-np.inf], c, [np.inf]]) for c in (self.xs, self.ys[slab]))
        piece = tile - self.first[slab]
        return xs[slab], xs[slab + 1], ys[piece], ys[piece + 1]

    def block(self, number: int) -> tuple[int, int, int]:
        """Tile and the two parts that meet in a block."""
        blocks = self.blocks
        tile = int(np.searchsorted(blocks, number, "right")) - 1
        i, left = 0, number - int(blocks[tile])
        while left >= self.parts[tile] - i:
            left -= int(self.parts[tile]) - i
            i += 1
        return tile, i, i + left

    def covering(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes and the tiles they touch, as two arrays."""
        box, slab = _spans(np.searchsorted(self.xs, x0, "right"), np.searchsorted(self.xs, x1, "right"))
        lo, hi = np.zeros(len(box), "int64"), np.zeros(len(box), "int64")
        order = np.argsort(slab, kind="stable")
        for s, at in zip(*_runs(slab[order])):
            rows = order[at]
            lo[rows], hi[rows] = (np.searchsorted(self.ys[s], v[box[rows]], "right") for v in (y0, y1))
        row, piece = _spans(lo, hi)
        return box[row], self.first[slab[row]] + piece

    def spread(self, tile: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of tiles to blocks: row, block and the row's part in its tile."""
        p = self.parts[tile]
        part = np.zeros(len(tile), "int64")
        if (split := np.flatnonzero(p > 1)).size:
            part[split] = (pd.util.hash_array(key[split], categorize=False) % p[split].astype("uint64")).astype("int64")
        row, other = _spans(np.zeros(len(p), "int64"), p - 1)
        i, j = np.minimum(part[row], other), np.maximum(part[row], other)
        return row, self.blocks[tile[row]] + i * p[row] - i * (i - 1) // 2 + (j - i), part[row]


def _cuts(v: np.ndarray, pieces: int) -> np.ndarray:
    """Different quantiles that cut v into so many pieces, or fewer where values are tied."""
    if pieces < 2 or not len(v):
        return np.zeros(0)
    return np.unique(np.quantile(v, np.arange(1, pieces) / pieces, method="lower"))


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of closed ranges with the place of its range."""
    n = np.maximum(hi - lo + 1, 0)
    at = np.repeat(np.arange(len(n)), n)
    return at, lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)


def _runs(v: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The values of a sorted array and where each stands."""
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, "int64")
    return v[at], [slice(a, b) for a, b in zip(at, np.append(at[1:], len(v)))]


# --- neighbours

# Cells around one, each pair of neighbours once.
_AROUND = [(0, 0, 0), *[(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]]
_AXIS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "uint64")


def _near(xyz: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different positions closer than ``radius``, each once.

    A cell is a little wider than the radius, so neighbours are in touching cells; cells
    are compared by a hash that is linear in their numbers, and distances are exact.
    """
    cell = np.clip(np.floor(xyz / (radius * 1.01)), -(2.0**62), 2.0**62).astype("int64").astype("uint64")
    with np.errstate(over="ignore"):
        at = (cell * _AXIS).sum(axis=1, dtype="uint64")
        order = np.argsort(at, kind="stable")
        at = at[order]
        for step in _AROUND:
            target = at + (np.array(step, "int64").astype("uint64") * _AXIS).sum(dtype="uint64")
            lo = np.searchsorted(at, target, "left") if any(step) else np.arange(len(at)) + 1
            n = np.maximum(np.searchsorted(at, target, "right") - lo, 0)
            for s in _pieces(n):
                i, j = _spans(lo[s], lo[s] + n[s] - 1)
                a, b = order[i + s.start], order[j]
                d = xyz[a] - xyz[b]
                hit = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2] < radius * radius
                yield a[hit], b[hit]


def _pieces(n: np.ndarray) -> list[slice]:
    """Slices of about CHUNK in sum, of at least one each."""
    if not len(n):
        return []
    at = np.flatnonzero(np.diff(np.cumsum(n) // CHUNK, prepend=0))
    return [slice(a, b) for a, b in zip(np.append(0, at), np.append(at, len(n))) if b > a]


@dataclass
class _Block:
    """The points of a block by position; each key counts once at a position."""

    xyz: np.ndarray
    offs: np.ndarray  # the members of position u are offs[u] to offs[u + 1]
    rank: np.ndarray  # order of each member's key
    part: np.ndarray
    keys: np.ndarray

    @classmethod
    def of(cls, pts: pd.DataFrame) -> _Block:
        keys, rank = np.unique(pts["k"].to_numpy(object), return_inverse=True)
        xyz, part = pts[["x", "y", "z"]].to_numpy("float64") + 0.0, pts["part"].to_numpy("int64")
        order = np.lexsort((rank, *xyz.T))
        xyz, rank, part = xyz[order], rank[order], part[order]
        moved = np.append(True, (xyz[1:] != xyz[:-1]).any(axis=1))
        new = moved | np.append(True, rank[1:] != rank[:-1])
        at = np.flatnonzero(moved[new])
        return cls(xyz[new][at], np.append(at, new.sum()), rank[new], part[new], keys)

    def inside(self, bounds: tuple[float, float, float, float], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x >= bounds[0]) & (x < bounds[1]) & (y >= bounds[2]) & (y < bounds[3])

    def pairs(self, radius: float, bounds: tuple[float, float, float, float], i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs of parts i and j whose componentwise maximum lies in the tile."""
        out = [np.zeros((2, 0), "int64")]
        size = np.diff(self.offs)
        alone = np.flatnonzero(size > 1)
        for u, v in [(alone, alone), *_near(self.xyz, radius)]:
            here = self.inside(bounds, np.maximum(self.xyz[u, 0], self.xyz[v, 0]), np.maximum(self.xyz[u, 1], self.xyz[v, 1]))
            u, v = u[here], v[here]
            # member by member of u, each against all of v
            row, a = _spans(self.offs[u], self.offs[u + 1] - 1)
            for s in _pieces(size[v[row]]):
                at, b = _spans(self.offs[v[row[s]]], self.offs[v[row[s]] + 1] - 1)
                p, q = a[s][at], b
                ok = (self.rank[p] != self.rank[q]) & (np.minimum(self.part[p], self.part[q]) == i) & (np.maximum(self.part[p], self.part[q]) == j)
                ok &= (u[row[s]] != v[row[s]])[at] | (self.rank[p] < self.rank[q])
                p, q = self.rank[p[ok]], self.rank[q[ok]]
                out.append(np.stack([np.minimum(p, q), np.maximum(p, q)]))
        both = np.unique(np.concatenate(out, axis=1), axis=1)
        return both[0], both[1]

    def counts(self, radius: float, bounds: tuple[float, float, float, float], i: int, j: int) -> pd.DataFrame:
        """Per member at home in the tile: least key at its position here, and near keys of the other part."""
        place = np.repeat(np.arange(len(self.xyz)), np.diff(self.offs))
        here = {p: np.bincount(place[self.part == p], minlength=len(self.xyz)) for p in {i, j}}
        near = {p: n.copy() for p, n in here.items()}
        for u, v in _near(self.xyz, radius):
            for p in near:
                near[p] += np.bincount(u, weights=here[p][v], minlength=len(self.xyz)).astype("int64") + np.bincount(v, weights=here[p][u], minlength=len(self.xyz)).astype("int64")
        home = self.inside(bounds, self.xyz[:, 0], self.xyz[:, 1])[place]
        n = np.where(self.part == i, near[j][place], near[i][place]) - (i == j)
        least = self.rank[self.offs[:-1]][place]
        return pd.DataFrame({"k": self.keys[self.rank[home]], "x": self.xyz[place[home], 0], "y": self.xyz[place[home], 1], "z": self.xyz[place[home], 2], "class_id": self.keys[least[home]], "n_near": n[home]})


# --- regions


def ring_edges(xs: Sequence[float] | None, ys: Sequence[float] | None) -> np.ndarray | None:
    """Edges ``x0, y0, x1, y1`` of a ring; None for less than three vertices."""
    if xs is None or ys is None:
        return None
    ring = [(float(p), float(q)) for p, q in zip(xs, ys) if p is not None and q is not None and np.isfinite(p) and np.isfinite(q)]
    if len(ring) > 1 and ring[0] == ring[-1]:
        ring.pop()
    if len(ring) < 3:
        return None
    a = np.array(ring)
    return np.concatenate([a, np.roll(a, -1, 0)], axis=1)


class Slabs:
    """Trapezoidal decomposition of region borders over a range of x.

    The range is cut into strips at every vertex and every crossing of two edges, so that
    inside a strip edges are totally ordered.  Between two neighbouring edges lies a
    trapezoid; it knows the regions that cover it.  A point is located by a binary search
    for its strip and one among the strip's edges.  Only the edges that cross the range
    are needed.
    """

    def __init__(self, regions: Sequence[tuple[str, np.ndarray, float, float]], eps: float, lo: float, hi: float):
        """``regions`` are name, edges, z from, z to; ``eps`` is how far a point may be off a border it is on."""
        self.regions, self.eps = regions, eps
        own = np.concatenate([np.full(len(e), r) for r, (_, e, _, _) in enumerate(regions)]) if regions else np.zeros(0, "int64")
        e = np.concatenate([r[1] for r in regions]) if regions else np.zeros((0, 4))
        up = e[:, 0] == e[:, 2]
        self.upright = np.stack([e[up, 0], own[up]], axis=1)
        self.upright = self.upright[np.argsort(self.upright[:, 0], kind="stable")]
        e, own = e[~up], own[~up]
        e = np.where((e[:, 0] < e[:, 2])[:, None], e, e[:, [2, 3, 0, 1]])
        self.edge = np.concatenate([e, own[:, None]], axis=1)
        # a point beside a vertex by eps in x is beside the edge by its slope times eps in y
        slope = np.abs((e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])).max() if len(e) else 0.0
        self.reach = eps * (2 + slope)
        self.lo, self.hi = lo - 4 * eps, hi + 4 * eps

    def locate(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and names of the regions that contain the points, borders included."""
        hits = [np.zeros((0, 2), "int64"), *self._located(self.edge, self.lo, self.hi, np.arange(len(x)), x, y)]
        # points within reach of an upright edge
        lo, hi = np.searchsorted(self.upright[:, 0], x - self.eps), np.searchsorted(self.upright[:, 0], x + self.eps, "right")
        rows, at = _spans(lo, hi - 1)
        hits.append(np.stack([rows, self.upright[at, 1].astype("int64")], axis=1))
        cand = np.unique(np.concatenate(hits), axis=0)
        keep, names = [np.zeros(0, "int64")], [np.zeros(0, object)]
        for r in np.unique(cand[:, 1]):
            name, edges, z_lo, z_hi = self.regions[r]
            rows = cand[cand[:, 1] == r, 0]
            rows = rows[(z[rows] >= z_lo) & (z[rows] <= z_hi)]
            for part in np.array_split(rows, max(1, len(rows) * len(edges) // CHUNK)):
                part = part[_in_ring(edges, x[part], y[part], self.eps)]
                keep.append(part)
                names.append(np.full(len(part), name, object))
        return np.concatenate(keep), np.concatenate(names)

    def _located(self, e: np.ndarray, lo: float, hi: float, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
        """Candidates (row, region); the range is halved until its decomposition is small."""
        e = e[(e[:, 2] >= lo) & (e[:, 0] <= hi)]
        if not len(e) or not len(rows):
            return
        ends = np.unique(e[:, [0, 2]])
        inner = ends[(ends > lo) & (ends < hi)]
        split = None
        if len(e) > EDGES and len(inner):
            split = inner[len(inner) // 2]
        else:
            cuts = np.unique(np.concatenate([[lo, hi], inner, _crossings(e, lo, hi)]))
            if (len(cuts) - 1) * len(e) > TRAPEZOIDS and len(cuts) > 2:
                split = cuts[len(cuts) // 2]
        if split is not None:
            left = x[rows] < split
            margin = 4 * self.eps
            # both halves reach over the cut by the tolerance; neither may stay as it was
            for a, b, mine in ((lo, split + margin, rows[left]), (split - margin, hi, rows[~left])):
                if b - a < hi - lo:
                    yield from self._located(e, a, b, mine, x, y)
                else:
                    yield from self._strips(e, np.unique([a, b]), mine, x, y)
        else:
            yield from self._strips(e, cuts, rows, x, y)

    def _strips(self, e: np.ndarray, cuts: np.ndarray, rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
        offs, flat, cover_offs, cover = [0], [], [0], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            here = e[(e[:, 0] <= lo) & (e[:, 2] >= hi)]
            mid = (lo + hi) / 2
            here = here[np.argsort(here[:, 1] + (mid - here[:, 0]) / (here[:, 2] - here[:, 0]) * (here[:, 3] - here[:, 1]), kind="stable")]
            flat.append(here)
            offs.append(offs[-1] + len(here))
            inside: set[int] = set()
            for r in [None, *here[:, 4].astype(int)]:  # the trapezoid below the first edge is outside of all
                if r is not None:
                    inside ^= {r}
                cover.extend(sorted(inside))
                cover_offs.append(len(cover))
        offs, cover_offs, cover = (np.array(v, "int64") for v in (offs, cover_offs, cover))
        edges = np.concatenate(flat) if flat else np.zeros((0, 5))
        region = edges[:, 4].astype("int64")
        px, py = x[rows], y[rows]
        for dx in (-self.eps, self.eps):
            below, above = (_trapezoids(cuts, offs, edges, px + dx, py + dy) for dy in (-self.reach, self.reach))
            at = np.flatnonzero(below >= 0)
            for t in (below[at], above[at]):
                row, c = _spans(cover_offs[t], cover_offs[t + 1] - 1)
                yield np.stack([rows[at[row]], cover[c]], axis=1)
            # the edges that pass within reach of the point: it may lie on one that bounds nothing
            strip = np.searchsorted(cuts, px[at] + dx, "right") - 1
            row, c = _spans(below[at] - strip, above[at] - strip - 1)
            yield np.stack([rows[at[row]], region[c]], axis=1)


def _trapezoids(cuts: np.ndarray, offs: np.ndarray, edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of each point's trapezoid, -1 outside of all strips."""
    strip = np.searchsorted(cuts, x, "right") - 1
    out = (strip < 0) | (strip >= len(cuts) - 1)
    strip = np.where(out, 0, strip)
    if len(offs) < 2:
        return np.full(len(x), -1)
    lo, hi = offs[strip].copy(), offs[strip + 1].copy()
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        a = edges[mid]
        above = a[:, 1] + (x - a[:, 0]) / (a[:, 2] - a[:, 0]) * (a[:, 3] - a[:, 1]) <= y
        lo = np.where(open_ & above, mid + 1, lo)
        hi = np.where(open_ & ~above, mid, hi)
    return np.where(out, -1, lo + strip)  # each strip has one trapezoid more than edges


def _crossings(e: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Where edges cross inside a range of x."""
    xs = [np.zeros(0)]
    for i in range(len(e)):
        x0, y0, x1, y1, _ = e[i]
        o = e[i + 1:]
        o = o[(o[:, 0] < x1) & (o[:, 2] > x0)]
        if len(o):
            s, t = (y1 - y0) / (x1 - x0), (o[:, 3] - o[:, 1]) / (o[:, 2] - o[:, 0])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = ((o[:, 1] - t * o[:, 0]) - (y0 - s * x0)) / (s - t)
            a, b = np.maximum(max(x0, lo), o[:, 0]), np.minimum(min(x1, hi), o[:, 2])
            xs.append(x[np.isfinite(x) & (x > a) & (x < b)])
    return np.concatenate(xs)


def _in_ring(edges: np.ndarray, x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """The exact closed test: on the border, or an odd number of edges above."""
    ax, ay, bx, by = edges.T
    px, py = x[:, None], y[:, None]
    dx, dy = bx - ax, by - ay
    cross = dx * (py - ay) - dy * (px - ax)
    straddle = (ax <= px) != (bx <= px)
    inside = (straddle & ((cross < 0) == (dx > 0))).sum(1) % 2 == 1
    on = (np.abs(cross) <= eps * np.hypot(dx, dy)) & (px >= np.minimum(ax, bx) - eps) & (px <= np.maximum(ax, bx) + eps) & (py >= np.minimum(ay, by) - eps) & (py <= np.maximum(ay, by) + eps)
    return inside | on.any(1)


# --- operators


def _rows(points: DataFrame, key: str, xyz: Sequence[str]) -> DataFrame:
    return points.where(F.col(key).isNotNull() & _known(xyz)).select(F.col(key).alias("k"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(n) for c, n in zip(xyz, "xyz")])


def _placed(rows: DataFrame, tiles: Tiles, below: float, above: float) -> DataFrame:
    """Points with the blocks they belong to; repeated rows of a batch go there once."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates(ignore_index=True)
            x, y = pdf["x"].to_numpy("float64"), pdf["y"].to_numpy("float64")
            row, tile = tiles.covering(x - below, x + above, y - below, y + above)
            at, block, part = tiles.spread(tile, pdf["k"].to_numpy(object)[row])
            out = pdf.iloc[row[at]].reset_index(drop=True)
            out["block"], out["part"] = block, part.astype("int32")
            out["k"] = out["k"].astype(object)
            yield out

    return rows.mapInPandas(place, T.StructType([*rows.schema.fields, T.StructField("block", T.LongType()), T.StructField("part", T.IntegerType())]))


_EDGES = "block long, region_id string, z_min double, z_max double, eps double, edges array<double>"


def _placed_regions(regions: DataFrame, tiles: Tiles) -> DataFrame:
    """Per region and block the edges that cross the block's slab."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, xs, ys, z_lo, z_hi in pdf[["region_id", "ring_x", "ring_y", "z_min", "z_max"]].itertuples(index=False, name=None):
                e = ring_edges(xs, ys)
                if e is None or name is None or pd.isna(z_lo) or pd.isna(z_hi):
                    continue
                eps = 4 * np.spacing(max(1.0, np.abs(e).max()))
                x, y = e[:, [0, 2]], e[:, [1, 3]]
                _, tile = tiles.covering(*(np.array([v]) for v in (x.min() - eps, x.max() + eps, y.min() - eps, y.max() + eps)))
                out = []
                for t in tile:
                    lo, hi, _, _ = tiles.bounds(t)
                    mine = e[(x.max(axis=1) >= lo - 8 * eps) & (x.min(axis=1) <= hi + 8 * eps)].ravel()
                    p, first = int(tiles.parts[t]), int(tiles.blocks[t])
                    out += [(first + i * p - i * (i - 1) // 2, name, z_lo, z_hi, eps, mine) for i in range(p)]
                yield pd.DataFrame(out, columns=["block", "region_id", "z_min", "z_max", "eps", "edges"])

    return regions.select("region_id", "ring_x", "ring_y", F.col("z_min").cast("double").alias("z_min"), F.col("z_max").cast("double").alias("z_max")).mapInPandas(place, _EDGES)


def _containing(block: _Block, bounds: tuple[float, float, float, float], regs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of keys at home in the tile and names of the regions around them."""
    home = np.flatnonzero(block.inside(bounds, block.xyz[:, 0], block.xyz[:, 1]))
    if not len(home) or not len(regs):
        return np.zeros(0, "int64"), np.zeros(0, object)
    x, y, z = block.xyz[home].T
    slabs = Slabs([(r.region_id, np.asarray(r.edges, "float64").reshape(-1, 4), r.z_min, r.z_max) for r in regs.itertuples()], regs["eps"].max(), x.min(), x.max())
    at, names = slabs.locate(x, y, z)
    row, member = _spans(block.offs[home[at]], block.offs[home[at] + 1] - 1)
    return block.rank[member], names[row]


def hits(points: DataFrame, regions: DataFrame, key: str, xyz: Sequence[str], radius: float | None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(hit_kind, key_a, key_b)``: near pairs of keys and regions that contain a key, in one pass.

    ``near``: different keys at a distance below ``radius`` (none: left out), each pair
    once, smaller key first; it comes from the tile of its componentwise maximum, which
    both points reach.  ``inside``: key and region (prism ``region_id, ring_x, ring_y,
    z_min, z_max``), border included; rings may run either way and repeat their first
    vertex, regions may overlap.  Keys are given as text.  Rows with a null, NaN or
    infinite coordinate or a null key, regions with a null or less than three vertices
    give no row; repeated rows count once.
    """
    rows = _rows(points, key, xyz)
    tiles = Tiles.of(rows, tile_rows)
    text = T.StructType([T.StructField(c, T.StringType()) for c in ("hit_kind", "key_a", "key_b")])

    def meet(pts: pd.DataFrame, regs: pd.DataFrame) -> pd.DataFrame:
        if pts.empty:
            return pd.DataFrame({"hit_kind": [], "key_a": [], "key_b": []}, dtype=object)
        tile, i, j = tiles.block(int(pts["block"].iloc[0]))
        block, bounds = _Block.of(pts), tiles.bounds(tile)
        a, b = block.pairs(radius, bounds, i, j) if radius is not None else (np.zeros(0, "int64"),) * 2
        c, names = _containing(block, bounds, regs)
        kinds = np.repeat(np.array(["near", "inside"], object), [len(a), len(c)])
        return pd.DataFrame({"hit_kind": kinds, "key_a": np.concatenate([block.keys[a], block.keys[c]]), "key_b": np.concatenate([block.keys[b], names])}, dtype=object)

    placed = _placed(rows.withColumn("k", F.col("k").cast("string")), tiles, 0.0, 0.0 if radius is None else radius * 1.001)
    # a key at several positions may be near the same other one twice
    return placed.groupBy("block").cogroup(_placed_regions(regions, tiles).groupBy("block")).applyInPandas(meet, text).distinct()


def near_pairs(points: DataFrame, key: str, xyz: Sequence[str], radius: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs ``(key_a, key_b)`` of different keys at a distance below ``radius``, each once; see ``hits``."""
    none = points.sparkSession.createDataFrame([], "region_id string, ring_x array<double>, ring_y array<double>, z_min double, z_max double")
    return hits(points, none, key, xyz, radius, tile_rows).select("key_a", "key_b")


def containing_regions(points: DataFrame, regions: DataFrame, key: str, xyz: Sequence[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(key, region_id)`` for each point and region that contains it, once; see ``hits``."""
    return hits(points, regions, key, xyz, None, tile_rows).select(F.col("key_a").cast(points.schema[key].dataType).alias(key), F.col("key_b").alias("region_id"))


def near_counts(points: DataFrame, key: str, xyz: Sequence[str], radius: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per key and position: ``class_id``, the least key there, and ``n_near``, other keys closer than ``radius``.

    Only positions meet each other, so copies of one are not compared pairwise.  Each
    point is counted in the tile it lies in, which holds all points within reach of it.
    """
    rows = _rows(points, key, xyz)
    tiles = Tiles.of(rows, tile_rows)
    reach = radius * 1.001
    schema = T.StructType([*rows.schema.fields, T.StructField("class_id", rows.schema["k"].dataType), T.StructField("n_near", T.LongType())])

    def count(pts: pd.DataFrame) -> pd.DataFrame:
        tile, i, j = tiles.block(int(pts["block"].iloc[0]))
        return _Block.of(pts).counts(radius, tiles.bounds(tile), i, j)

    found = _placed(rows, tiles, reach, reach).groupBy("block").applyInPandas(count, schema)
    if tiles.parts.max() > 1:  # what the blocks of a spread tile have found adds up
        found = found.groupBy("k", "x", "y", "z").agg(F.min("class_id").alias("class_id"), F.sum("n_near").alias("n_near"))
    return found.select(F.col("k").alias(key), "class_id", "n_near")
