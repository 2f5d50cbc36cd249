"""Spatial codes, hashes, time and attribute buckets as column expressions.

All of them are built-in expressions, so they run inside generated code and can be
pushed into scans; null inputs give null unless a docstring says otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The world box, bit widths, default steps and block sizes.
BITS = 21
MAX_INDEX = (1 << BITS) - 1
WORLD = {"x": (110.0, 120.0), "y": (21.0, 25.0), "z": (0.0, 1000.0)}
SENSOR_LEVEL = POINT_LEVEL = 19
VOXEL_LEVEL = 4
BLOCK_SIZE = {4: (16, 16, 8), 5: (8, 8, 4), 6: (4, 4, 2), 7: (2, 2, 1), 8: (1, 1, 1)}
VOLUME_STEP = (0.00390625, 0.00390625, 7.8125)
BRICK = (16, 16, 8)
TEMP_WIDTH, TEMP_ORIGIN = 2.0, 0.0
POINT_VEL_STEP = (1e-4, 1e-4, 1e-3)
VOXEL_VEL_STEP = (5e-6, 5e-6, 5e-5)
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
CURVE_ORDER = (0, 1, 2, 7, 4, 5, 3, 6)
KIND = {"id": 1, "temp": 2, "vx": 3, "vy": 4, "vz": 5}
NODATA = -9999.0


def _num(c: Column | float | int) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


# --- normalised coordinates and Morton codes


def axis_index(v: Column | float, lo: float, hi: float) -> Column:
    """Index 0..2^21-1 of a coordinate: scaled, truncated, clamped; NaN gives 0."""
    s = (_num(v) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(MAX_INDEX))
    inside = F.least(F.greatest(s, F.lit(0.0)), F.lit(float(MAX_INDEX)))
    # least and greatest skip nulls and take NaN for the largest number
    return F.when(F.isnan(s), F.lit(0)).when(s.isNotNull(), inside).cast("bigint")


def axis_index_py(v: float, lo: float, hi: float) -> int:
    """``axis_index`` of one number, for the driver."""
    s = (v - lo) / (hi - lo) * MAX_INDEX
    return 0 if s != s else int(min(max(s, 0.0), float(MAX_INDEX)))


def world_index(lon: Column, lat: Column, alt: Column) -> tuple[Column, Column, Column]:
    return tuple(axis_index(v, *WORLD[a]) for v, a in zip((lon, lat, alt), "xyz"))


def _spread7(i: int) -> int:
    return sum((i >> b & 1) << 3 * b for b in range(7))


def spread(v: Column) -> Column:
    """Bit i of a 21-bit number moved to bit 3i, by a table for seven bits at a time.

    The table is a constant; the usual chain of shifts and masks would double the
    expression at each of its five steps.
    """
    table = F.array(*[F.lit(_spread7(i)).cast("bigint") for i in range(128)])
    part = lambda at: F.shiftleft(F.get(table, F.shiftright(v, 7 * at).bitwiseAND(F.lit(127)).cast("int")), 21 * at)
    return part(0).bitwiseOR(part(1)).bitwiseOR(part(2))


def morton(ix: Column, iy: Column, iz: Column) -> Column:
    """63-bit Morton code; x takes the lowest bit."""
    return spread(ix.cast("bigint")).bitwiseOR(F.shiftleft(spread(iy.cast("bigint")), 1)).bitwiseOR(F.shiftleft(spread(iz.cast("bigint")), 2))


def morton_py(ix: int, iy: int, iz: int) -> int:
    return sum(((ix >> i & 1) | (iy >> i & 1) << 1 | (iz >> i & 1) << 2) << 3 * i for i in range(BITS))


def block(index: Column, level: int) -> Column:
    """Number of the block along an axis at a level 0..21."""
    return F.shiftright(index, BITS - level)


def block_code(ix: Column, iy: Column, iz: Column, level: int) -> Column:
    """Morton code of the lower corner of the block at a level."""
    down = lambda c: F.shiftleft(block(c, level), BITS - level)
    return morton(down(ix), down(iy), down(iz))


def curve_code(ix: Column, iy: Column, iz: Column) -> Column:
    """Permuted Morton code: each level's octant (x4 + y2 + z) passes through a fixed table."""
    table = F.array(*[F.lit(v).cast("bigint") for v in CURVE_ORDER])

    def step(acc: Column, i: Column) -> Column:
        bit = lambda c: F.getbit(c, i).cast("bigint")
        octant = bit(ix) * 4 + bit(iy) * 2 + bit(iz)
        return F.shiftleft(acc, 3).bitwiseOR(F.element_at(table, (octant + 1).cast("int")))

    return F.aggregate(F.sequence(F.lit(BITS - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("bigint"), step)


def big_endian(v: Column) -> Column:
    """8 bytes of a number, highest first."""
    return F.unhex(F.lpad(F.hex(v), 16, "0"))


def from_big_endian(b: Column) -> Column:
    return F.conv(F.hex(b), 16, -10).cast("bigint")


@dataclass(frozen=True)
class Bounds:
    """Extent of a point set, mapped affinely to the world box."""

    x_min: float
    x_max: float
    y_min: float
    y_max: float
    z_min: float
    z_max: float

    def axis(self, a: str) -> tuple[float, float]:
        return getattr(self, f"{a}_min"), getattr(self, f"{a}_max")

    def index(self, v: Column, a: str) -> Column:
        """Normalised index of a coordinate; an extent of zero maps to 0."""
        lo, hi = self.axis(a)
        w_lo, w_hi = WORLD[a]
        if hi == lo:
            return F.when(v.isNotNull(), F.lit(0).cast("bigint"))
        inside = F.when(F.isnan(v), v).when(v.isNotNull(), F.least(F.greatest(v, F.lit(lo)), F.lit(hi)))
        return axis_index((inside - F.lit(lo)) / F.lit(hi - lo) * F.lit(w_hi - w_lo) + F.lit(w_lo), w_lo, w_hi)

    def index_py(self, v: float, a: str) -> int:
        lo, hi = self.axis(a)
        w_lo, w_hi = WORLD[a]
        if hi == lo:
            return 0
        return axis_index_py((min(max(v, lo), hi) - lo) / (hi - lo) * (w_hi - w_lo) + w_lo, w_lo, w_hi)


# --- hashes


def _fnv(s: Column) -> Column:
    def mix(a: Column, code: Column) -> Column:
        return (a.bitwiseXOR(code) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))

    start = F.lit(FNV_OFFSET).cast("bigint")
    plain = F.aggregate(F.split(s, ""), start, lambda a, c: mix(a, F.ascii(c).cast("bigint")))
    h = F.hex(F.encode(s, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(h) - 3, F.lit(4)), lambda i: F.conv(F.substr(h, i, F.lit(4)), 16, 10).cast("bigint"))
    return F.when(s == "", start).when(F.octet_length(s) == F.length(s), plain).otherwise(F.aggregate(units, start, mix))


def attr_hash(s: Column) -> Column:
    """FNV-1a over UTF-16 units, without the sign bit."""
    return _fnv(s).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def fnv1a32(s: Column) -> Column:
    """FNV-1a over UTF-16 units as a signed 32-bit number."""
    h = _fnv(s)
    return F.when(h >= F.lit(1 << 31), h - F.lit(1 << 32)).otherwise(h).cast("int")


# --- time


def day_bucket(millis: Column) -> Column:
    """UTC day as the number yyyyMMdd."""
    return F.date_format(F.timestamp_millis(millis), "yyyyMMdd").cast("int")


def time_of_day(millis: Column) -> Column:
    """Milliseconds since UTC midnight."""
    return F.pmod(millis, F.lit(86_400_000)).cast("int")


def days_between(first: Column, last: Column, swap: bool = False) -> Column:
    """All yyyyMMdd numbers of a closed range; reversed bounds are swapped or give an empty list."""
    a, b = (F.to_date(c.cast("string"), "yyyyMMdd") for c in (first, last))
    lo, hi = (F.least(a, b), F.greatest(a, b)) if swap else (a, b)
    days = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda d: F.date_format(d, "yyyyMMdd").cast("int"))
    return days if swap else F.when(a <= b, days).otherwise(F.array().cast("array<int>"))


def parse_instant(text: Column) -> Column:
    """Epoch milliseconds of an ISO instant ``...Z``; null where it is none."""
    ok = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?Z$")
    return F.unix_millis(F.when(ok, text).try_cast("timestamp"))


def format_instant(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_seconds(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")


# --- attribute buckets


def temp_bucket(t: Column | float, width: float = TEMP_WIDTH, origin: float = TEMP_ORIGIN) -> Column:
    """Bucket of a temperature; below the origin it is trunc((off - width + 1) / width)."""
    off = _num(t) - F.lit(origin)
    return F.when(off >= 0, off / F.lit(width)).otherwise((off - F.lit(width) + 1) / F.lit(width)).cast("int")


def temp_bucket_py(t: float, width: float = TEMP_WIDTH, origin: float = TEMP_ORIGIN) -> int:
    off = t - origin
    return int(off / width) if off >= 0 else int((off - width + 1) / width)


def vel_bucket(v: Column, step: float, origin: float = 0.0) -> Column:
    return F.floor((_num(v) - F.lit(origin)) / F.lit(step)).cast("int")


def vel_bucket_py(v: float, step: float, origin: float = 0.0) -> int:
    from math import floor

    return floor((v - origin) / step)


def flip_sign(b: Column) -> Column:
    """Order-preserving unsigned form of a signed bucket (its own inverse)."""
    return b.cast("int").bitwiseXOR(F.lit(-(1 << 31)).cast("int"))


# --- voxel and volume grids


def grid_index(v: Column | float, origin: float, step: float) -> Column:
    """Nearest grid index, halves upwards."""
    return F.floor((_num(v) - F.lit(origin)) / F.lit(step) + F.lit(0.5)).cast("bigint")


def grid_index_py(v: float, origin: float, step: float) -> int:
    from math import floor

    return floor((v - origin) / step + 0.5)


@dataclass(frozen=True)
class Grid:
    """Voxel grid: origin, step and the bias that makes every stored index non-negative.

    ``extent`` is the size of the largest voxel along each axis, if known.
    """

    origin: tuple[float, float, float]
    step: tuple[float, float, float]
    bias: tuple[int, int, int]
    extent: tuple[float, float, float] | None = None

    def index(self, v: Column, axis: int) -> Column:
        return grid_index(v, self.origin[axis], self.step[axis]) + F.lit(self.bias[axis])

    def index_py(self, v: float, axis: int) -> int:
        return grid_index_py(v, self.origin[axis], self.step[axis]) + self.bias[axis]


def block_of(index: Column, size: int) -> Column:
    """Block of a biased index; division truncates towards zero."""
    return F.when(index >= 0, F.floor(index / F.lit(size))).otherwise(F.ceil(index / F.lit(size))).cast("bigint")


def block_of_py(index: int, size: int) -> int:
    return index // size if index >= 0 else -(-index // size)


def block_from(block: int, size: int) -> int:
    """The least index of a block whose number is truncated towards zero."""
    return block * size if block > 0 else block * size - (size - 1)


def block_to(block: int, size: int) -> int:
    """The greatest index of such a block."""
    return block * size + (size - 1) if block >= 0 else block * size


def volume_brick(v: Column | float, axis: int) -> Column:
    """Brick number of a position on the fixed volume grid."""
    return F.floor(_num(v) / F.lit(VOLUME_STEP[axis] * BRICK[axis])).cast("bigint")


def volume_brick_py(v: float, axis: int) -> int:
    from math import floor

    return floor(v / (VOLUME_STEP[axis] * BRICK[axis]))


# --- composite key


def unified_key(kind: int, attr: Column, z_cell: Column, day: Column, tod: Column, data_key: Column) -> Column:
    """Sortable bytes: kind 1, attribute 4, cell 8, day 4, time 4, then ``_`` and the data key."""
    four = lambda c: F.lpad(F.hex(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    head = F.concat(F.lit(f"{kind:02X}"), four(attr), F.lpad(F.hex(z_cell.cast("bigint")), 16, "0"), four(day), four(tod))
    return F.concat(F.unhex(head), F.encode(F.concat(F.lit("_"), data_key), "UTF-8"))


def unified_key_parts(key: Column) -> Column:
    """The fields of ``unified_key``; positions are fixed, so bytes equal to ``_`` do no harm."""
    num = lambda at, n: F.conv(F.hex(F.substr(key, F.lit(at), F.lit(n))), 16, 10).cast("bigint")
    attr = num(2, 4)
    return F.struct(
        num(1, 1).cast("int").alias("kind"), F.when(attr >= F.lit(1 << 31), attr - F.lit(1 << 32)).otherwise(attr).cast("int").alias("attr"),
        num(6, 8).alias("z_cell"), num(14, 4).cast("int").alias("day_bucket"), num(18, 4).cast("int").alias("time_of_day"),
        F.decode(F.substr(key, F.lit(23), F.length(key)), "UTF-8").alias("dk"))
