"""How many points lie in each of many boxes, without listing the pairs.

Points and boxes meet in tiles of about equally many points, which are cut at sampled
quantiles; a box goes to every tile that it touches, and its counts are added up.  Tiles
that ties or a hot spot make too large are spread over parts.  A part's points are counted

* by a table of running sums over their different x, y and z, if that is not much larger
  than the points: eight look-ups a box;
* else by their ranks: the ranks of x that a box spans are cut into nodes of a power of two
  each, whose points are in order of y, and a wavelet matrix counts those of a range of y
  that are below a z.  Time and room grow as n log n log n at most, wherever the points lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraquery.operators.nearby import Tiles, _known

#: Points aimed at in a tile.
TILE_ROWS = 100_000
#: Points that a task packs at a time, and at most in a row.
CHUNK_ROWS, PACK_ROWS = 400_000, 256
#: Boxes that are counted at a time.
BOXES = 200_000
BOUNDS = ("x0", "y0", "z0", "x1", "y1", "z1")


def _by_sums(xyz: np.ndarray, most: int) -> Callable[[np.ndarray], np.ndarray] | None:
    """Counts by running sums over the different coordinates; None if there are more than ``most`` cells."""
    axes, at = zip(*[np.unique(v, return_inverse=True) for v in xyz.T])
    shape = tuple(len(a) for a in axes)
    if shape[0] * shape[1] * shape[2] > most:
        return None
    sums = np.zeros([n + 1 for n in shape], "int64")
    sums[1:, 1:, 1:] = np.bincount((at[0] * shape[1] + at[1]) * shape[2] + at[2], minlength=int(np.prod(shape))).reshape(shape)
    for i in range(3):
        np.cumsum(sums, axis=i, out=sums)

    def count(box: np.ndarray) -> np.ndarray:
        lo, hi = ([np.searchsorted(a, box[:, 3 * e + i], side) for i, a in enumerate(axes)] for e, side in enumerate(("left", "right")))
        out = np.zeros(len(box), "int64")
        for corner in range(8):
            up = [corner >> i & 1 for i in range(3)]
            out += (1 if sum(up) % 2 else -1) * sums[tuple(hi[i] if u else lo[i] for i, u in enumerate(up))]
        return out

    return count


def _below(seq: np.ndarray, bits: int, lo: np.ndarray, hi: np.ndarray, top: np.ndarray) -> np.ndarray:
    """How many of ``seq[lo:hi]`` are less than ``top``, by a wavelet matrix."""
    out = np.zeros(len(lo), "int64")
    for b in range(bits - 1, -1, -1):
        one = (seq >> b & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        left, right, up = zeros[lo], zeros[hi], (top >> b & 1).astype(bool)
        out += np.where(up, right - left, 0)
        lo, hi = np.where(up, zeros[-1] + lo - left, left), np.where(up, zeros[-1] + hi - right, right)
        seq = np.concatenate([seq[~one], seq[one]])
    return out


def _by_ranks(xyz: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Counts by nodes of ranks of x, in order of y, and a wavelet matrix of z."""
    n = len(xyz)
    bits = n.bit_length()
    sorted_ = np.sort(xyz, axis=0)
    order = np.argsort(xyz[:, 0], kind="stable")
    rank = np.empty((2, n), "int64")
    for i in (0, 1):
        rank[i, np.argsort(xyz[order, i + 1], kind="stable")] = np.arange(n)

    def count(box: np.ndarray) -> np.ndarray:
        lo, hi = ([np.searchsorted(sorted_[:, i], box[:, 3 * e + i], side) for i in range(3)] for e, side in enumerate(("left", "right")))
        out = np.zeros(len(box), "int64")
        for level in range(bits):
            key = (np.arange(n) >> level) * (n + 1) + rank[0]
            by = np.argsort(key, kind="stable")
            key, z = key[by], rank[1][by]
            for end, sign in ((hi[0], 1), (lo[0], -1)):
                # the node before the end, unless both ends have it
                have = np.flatnonzero((end >> level & 1).astype(bool) & (lo[0] >> level != hi[0] >> level))
                if have.size:
                    node = ((end[have] >> level) - 1) * (n + 1)
                    a, b = np.searchsorted(key, node + lo[1][have]), np.searchsorted(key, node + hi[1][have])
                    out[have] += sign * (_below(z, bits, a, b, hi[2][have]) - _below(z, bits, a, b, lo[2][have]))
        return out

    return count


def counter(xyz: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function from closed boxes, rows of BOUNDS that are not reversed, to their numbers of points."""
    return _by_sums(xyz, 4 * len(xyz) + 65_536) or _by_ranks(xyz)


def count_in_boxes(facts: DataFrame, boxes: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(box_id, points)`` of the boxes ``box_id, x0, y0, z0, x1, y1, z1`` that hold any of the points ``x, y, z``."""
    given = F.lit(True)
    for a in "xyz":
        given = given & F.col(a).isNotNull()
    points = facts.where(given).select(*[F.col(a).cast("double").alias(a) for a in "xyz"])
    tiles = Tiles.of(points.where(_known("xy")), tile_rows)
    first = np.cumsum(np.append(0, tiles.parts))
    known = F.lit(True)
    for a in "xyz":
        known = known & (F.col(f"{a}0") <= F.col(f"{a}1"))
    boxes = boxes.select("box_id", *[F.col(c).cast("double").alias(c) for c in BOUNDS]).where(known)
    id_ = T.StructField("box_id", boxes.schema["box_id"].dataType)
    bounds = [T.StructField(c, T.DoubleType()) for c in BOUNDS]
    packed = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("data", T.BinaryType())])
    placed = T.StructType([T.StructField("block", T.IntegerType()), id_, *bounds])
    counted = T.StructType([id_, T.StructField("points", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    packed_, placed_, counted_ = map(to_arrow_schema, (packed, placed, counted))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def packs() -> Iterator[pa.RecordBatch]:
            xyz = np.stack([np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(3)], axis=1)
            _, tile = tiles.covering(xyz[:, 0], xyz[:, 0], xyz[:, 1], xyz[:, 1])
            block = first[tile] + np.arange(len(tile)) % tiles.parts[tile]
            order = np.argsort(block, kind="stable")
            xyz, block = np.ascontiguousarray(xyz[order], "<f8"), block[order]
            new = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            size = np.diff(np.append(new, len(block)))
            starts = np.concatenate([np.arange(a, a + n, PACK_ROWS) for a, n in zip(new, size)])
            offs = (np.append(starts, len(block)) * 24).astype("int32")
            data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(xyz.tobytes())])
            yield from pa.table({"block": block[starts].astype("int32"), "data": data}).cast(packed_).to_batches(max_chunksize=4096)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK_ROWS:
                yield from packs()
                held, rows = [], 0
        if rows:
            yield from packs()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x0, y0, _, x1, y1, _ = (b.column(c).to_numpy(zero_copy_only=False) for c in BOUNDS)
            box, tile = tiles.covering(x0, x1, y0, y1)
            parts = tiles.parts[tile]
            row = np.repeat(np.arange(len(tile)), parts)
            block = first[tile[row]] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            table = pa.Table.from_batches([b]).take(pa.array(box[row]))
            yield from table.add_column(0, "block", pa.array(block.astype("int32"))).cast(placed_).combine_chunks().to_batches(max_chunksize=4096)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's points come before its boxes."""
        now, data, counts, held = -1, [], None, []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal counts, data
            if held and (data or counts):
                counts = counts or counter(np.frombuffer(b"".join(data), "<f8").reshape(-1, 3))
                data = []
                table = pa.concat_tables(held)
                n = counts(np.stack([table.column(c).to_numpy() for c in BOUNDS], axis=1))
                some = pa.table({"box_id": table.column("box_id"), "points": n}).cast(counted_).filter(pa.array(n > 0))
                yield from some.combine_chunks().to_batches(max_chunksize=10_000)

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            block, box = rows.column("block").to_numpy(), rows.column("box").to_numpy()
            starts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (box[1:] != box[:-1])))
            for lo, hi in zip(starts, np.append(starts[1:], len(block))):
                if block[lo] != now:
                    yield from answer()
                    now, data, counts, held = block[lo], [], None, []
                if box[lo]:
                    held.append(rows.slice(lo, hi - lo))
                    if sum(map(len, held)) >= BOXES:
                        yield from answer()
                        held = []
                else:
                    data += rows.column("data").slice(lo, hi - lo).to_pylist()
        yield from answer()

    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in (id_, *bounds)]
    rows = points.mapInArrow(pack, packed).select("block", F.lit(0).alias("box"), *none, "data")
    rows = rows.unionByName(boxes.mapInArrow(place, placed).select("block", F.lit(1).alias("box"), "box_id", *BOUNDS, F.lit(None).cast("binary").alias("data")))
    found = rows.repartition("block").sortWithinPartitions("block", "box").mapInArrow(count, counted)
    return found.groupBy("box_id").agg(F.sum("points").alias("points"))
