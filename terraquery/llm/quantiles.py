"""Mergeable quantiles: dyadic Count-sketches.

A value is encoded by the leading ``bits`` bits of its order-preserving 64-bit form, so
every finite double has a code, without a range to be clipped to, and a cell is a fixed
share of its value wide.  For each binary resolution p the sketch counts how many values
share the first p bits of their code.  Resolutions with few cells are counted exactly;
each finer one is a signed Count-sketch of ``depth`` rows and ``width`` columns.  All
counters are sums of signed ones, so sketches of partitions, days or any other parts are
merged by addition, and a row of weight -1 deletes a value.  A rank is inverted by
descending the resolutions from the coarsest.

A sketch is a set of rows ``(keys..., part, data)``: ``part`` below zero holds the counters
of one resolution, any other part some codes with their counts.  A group keeps its codes
until they are ``sparse_limit``, at which they take as much room (12 bytes each) as its
compressed counters (76 KB).  Both forms are linear, add up in any mixture and order, and turn into counters as
soon as the limit is passed, inside the partition that reads the values already.

Error.  A value is off by at most ``value_error``, half the width of its cell.  A group in
codes has no rank error.  For a group in counters ``rank_error`` states three standard
deviations of the estimated rank as a share of the group's rows: a node of resolution p
is estimated with a variance of at most F2(p)/width, where F2(p) is the sum of squared
cell counts without the heaviest width/16 cells, which the median over the rows of a
sketch keeps out.  F2 is read off the sketch itself.

Where no rank error will do, ``exact`` reads the rows again and selects the code by its two
halves, from counts of at most 65,536 cells a group, however many rows and codes it has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraquery.session import written

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(1 << 63)
_REC = np.dtype([("code", "<u4"), ("n", "<i8")])

#: Rows that a task gathers before it turns them into sketches.
CHUNK_ROWS = 500_000
#: Codes in a row of a sketch; a group of more has several, so that several tasks add it up.
PART_CODES = 1024
#: Bytes of one open group that a task keeps before it adds them up.
OPEN_BYTES = 32 << 20
#: Rows of counters (some 30 groups), or bytes of codes, that a task adds up at a time.
DENSE_ROWS, CODE_BYTES = 1000, 12 << 20


@dataclass(frozen=True)
class SketchSpec:
    bits: int = 32
    width: int = 1024
    depth: int = 5
    sparse_limit: int = 8192

    @property
    def exact_bits(self) -> int:
        """Finest resolution that is counted exactly (no more cells than a sketch has)."""
        return (self.width * self.depth).bit_length() - 1

    def cells(self, level: int) -> int:
        return 1 << level if level <= self.exact_bits else self.width * self.depth

    def encode(self, value: np.ndarray) -> np.ndarray:
        """Codes of finite doubles; -0 is 0."""
        b = (np.asarray(value, "float64") + 0.0).view("uint64")
        return (np.where(b & _TOP, ~b, b | _TOP) >> np.uint64(64 - self.bits)).astype("uint32")

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest double of each code's cell."""
        shift = np.uint64(64 - self.bits)
        lo = np.asarray(code, "uint64") << shift
        return tuple(np.where(u & _TOP, u ^ _TOP, ~u).view("float64") for u in (lo, lo | np.uint64((1 << int(shift)) - 1)))

    def decode(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The middle of each code's cell and how far a value of it may be off."""
        lo, hi = self.edges(code)
        half = hi / 2 - lo / 2
        # the cell's far edge is the next code's near one but for one unit in the last place
        return np.where(lo >= 0, lo + _whole(half), hi - _whole(half)), _whole(half)


def _whole(half: np.ndarray) -> np.ndarray:
    """Half widths as the powers of two that they are but for the last place."""
    m, e = np.frexp(half)
    return np.where(half > 0, np.ldexp(1.0, e), half)


def _hash(level: int, row: int, cell: np.ndarray) -> np.ndarray:
    """A 64-bit mix of (level, row, cell): bucket from the low bits, sign from the top bit."""
    with np.errstate(over="ignore"):
        h = cell.astype("uint64") + np.uint64(1 + level * 131 + row * 65537) * _MIX
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def _place(spec: SketchSpec, level: int, row: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of cells in one row of a sketch."""
    h = _hash(level, row, cell)
    return (h % np.uint64(spec.width)).astype("int64") + row * spec.width, np.where(h >> np.uint64(63), 1.0, -1.0)


def counters(spec: SketchSpec, code: np.ndarray, n: np.ndarray) -> dict[int, np.ndarray]:
    """The counters of every resolution for codes with their counts."""
    out, w, code = {}, n.astype("float64"), code.astype("int64")
    for p in range(spec.bits + 1):
        cell = code >> (spec.bits - p)
        if p <= spec.exact_bits:
            out[p] = np.bincount(cell, weights=w, minlength=spec.cells(p))
        else:
            at = [_place(spec, p, r, cell) for r in range(spec.depth)]
            out[p] = np.bincount(np.concatenate([s for s, _ in at]), weights=np.concatenate([w * g for _, g in at]), minlength=spec.cells(p))
        out[p] = np.rint(out[p]).astype("int64")
    return out


def _starts(cols: list[pa.Array], rows: int) -> np.ndarray:
    """Whether each row begins a group: it differs from the row before in some column."""
    new = np.zeros(rows, bool)
    new[:1] = True
    for c in cols:
        at = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= at[1:] != at[:-1]
    return new


def _one(rows: int) -> pa.Table:
    """The keys of groups without any."""
    return pa.table({"__one": np.ones(rows, "int8")})


class _Groups:
    """Added-up groups: their keys, the codes of some and the counters of the others."""

    def __init__(self, spec: SketchSpec, keys: pa.Table, group: np.ndarray, code: np.ndarray, n: np.ndarray, dense: dict[int, dict[int, np.ndarray]]):
        order = np.lexsort((code, group))
        group, code, n = group[order], code[order], n[order]
        if len(code):
            at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (code[1:] != code[:-1])))
            group, code, n = group[at], code[at], np.add.reduceat(n, at)
            left = n != 0
            group, code, n = group[left], code[left], n[left]
        size = np.bincount(group, minlength=keys.num_rows)
        for g in {*dense, *np.flatnonzero(size > spec.sparse_limit).tolist()}:
            lo, hi = np.searchsorted(group, (g, g + 1))
            have = dense.setdefault(g, {})
            if hi > lo:
                for p, c in counters(spec, code[lo:hi], n[lo:hi]).items():
                    have[p] = have[p] + c if p in have else c
        if dense:
            left = ~np.isin(group, list(dense))
            group, code, n = group[left], code[left], n[left]
        self.spec, self.keys, self.group, self.code, self.n, self.dense = spec, keys, group, code, n, dense

    @classmethod
    def of_rows(cls, spec: SketchSpec, rows: pa.Table, by: Sequence[str]) -> _Groups:
        """Groups of sketch rows that are sorted by ``by``."""
        rows = rows.combine_chunks()
        new = _starts([rows.column(c).combine_chunks() for c in by], rows.num_rows)
        group = np.cumsum(new) - 1
        part = rows.column("part").to_numpy()
        data = rows.column("data").combine_chunks()
        codes = data.filter(pa.array(part >= 0))
        flat, sizes = _flat(codes)
        dense: dict[int, dict[int, np.ndarray]] = {}
        for i in np.flatnonzero(part < 0):
            have, level = dense.setdefault(int(group[i]), {}), -1 - int(part[i])
            c = np.frombuffer(zlib.decompress(data[i].as_buffer()), "<i8")
            have[level] = have[level] + c if level in have else c
        first = np.flatnonzero(new)
        keys = rows.select([c for c in rows.column_names if c not in ("part", "data")]).take(pa.array(first)) if rows.num_columns > 2 else _one(len(first))
        return cls(spec, keys, np.repeat(group[part >= 0], sizes), flat["code"].astype("int64"), flat["n"].astype("int64"), dense)

    def rows(self) -> pa.Table:
        """The groups as sketch rows."""
        size = np.bincount(self.group, minlength=self.keys.num_rows)
        parts = -(-size // PART_CODES)
        part = self.code % np.maximum(parts[self.group], 1)
        order = np.lexsort((part, self.group))
        group, part = self.group[order], part[order]
        flat = np.empty(len(order), _REC)
        flat["code"], flat["n"] = self.code[order], self.n[order]
        at = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1]))) if len(order) else np.zeros(0, "int64")
        offs = np.append(at, len(order)) * _REC.itemsize
        owner, number = [group[at]], [part[at]]
        blobs = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offs.astype("int32").tobytes()), pa.py_buffer(flat.tobytes())])]
        for g, levels in self.dense.items():
            owner.append(np.full(len(levels), g))
            number.append(-1 - np.array(list(levels)))
            blobs.append(pa.array([zlib.compress(c.astype("<i8").tobytes(), 1) for c in levels.values()], pa.binary()))
        keys = self.keys.take(pa.array(np.concatenate(owner).astype("int64")))
        return keys.append_column("part", pa.array(np.concatenate(number).astype("int32"))).append_column("data", pa.chunked_array(blobs, pa.binary()))


def _flat(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The records of binary rows, one after the other, and how many each row has."""
    if not len(codes):
        return np.zeros(0, _REC), np.zeros(0, "int64")
    offs = np.frombuffer(codes.buffers()[1], "int32", len(codes) + 1, codes.offset * 4)
    size = np.diff(offs) // _REC.itemsize
    data = codes.buffers()[2]
    return (np.frombuffer(data, _REC, int(size.sum()), int(offs[0])) if data is not None and size.sum() else np.zeros(0, _REC)), size


def _added(batches: Iterator[pa.RecordBatch], by: Sequence[str], spec: SketchSpec) -> Iterator[_Groups]:
    """Groups of sorted sketch rows, each in one piece however many batches it comes in."""
    open_: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if open_ is None else pa.concat_tables([open_, rows.cast(open_.schema)])
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        starts = np.flatnonzero(_starts([rows.column(c).combine_chunks() for c in by], rows.num_rows))
        room = np.where(rows.column("part").to_numpy() < 0, 1 / DENSE_ROWS, pc.binary_length(rows.column("data")).to_numpy() / CODE_BYTES)
        piece = np.floor(np.cumsum(room))[starts]
        cuts = starts[np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))]
        last = int(starts[-1])
        for lo, hi in zip(cuts, np.append(cuts[1:], last)):
            if lo < min(hi, last):
                yield _Groups.of_rows(spec, rows.slice(lo, min(hi, last) - lo), by)
        open_ = rows.slice(last)
        if open_.nbytes > OPEN_BYTES:
            open_ = _Groups.of_rows(spec, open_, by).rows().select(open_.column_names).cast(open_.schema)
    if open_ is not None and open_.num_rows:
        yield _Groups.of_rows(spec, open_, by)


def _batches(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from table.select(schema.names).cast(schema).combine_chunks().to_batches(max_chunksize=4096)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _finite(df: DataFrame, keys: Sequence[str], value: str, *more: Column) -> DataFrame:
    """Keys and the finite values, as ``__v``."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))).select(*keys, v.alias("__v"), *more)


def sketch(df: DataFrame, keys: Sequence[str], value: str, spec: SketchSpec = SketchSpec(), weight: str | None = None, scopes: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Sketch rows ``(keys..., part, data)`` per group of ``keys``.

    Every partition sketches its own rows; only sketches are shuffled.  Null, NaN and
    infinite values are left out; null keys form a group.  ``weight`` is 1 or, to delete,
    -1.  ``scopes`` names subsets of ``keys``: each row counts in its group of every scope,
    and the rows have a column ``scope``; the other keys are null in it.
    """
    keys = list(keys)
    rows = _finite(df, keys, value, (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("__w"))
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    if scopes:
        fields.insert(0, T.StructField("scope", T.StringType()))
    schema = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("data", T.BinaryType())])
    arrow = _arrow(schema)
    each = scopes or {"": keys}

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        code, n = spec.encode(table.column("__v").to_numpy()).astype("int64"), table.column("__w").to_numpy().astype("int64")
        index = {k: table.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64") for k in keys}
        for name, of in each.items():
            group = np.zeros(len(code), "int64")
            for k in of:
                group = np.unique(group * (index[k].max(initial=0) + 2) + index[k] + 1, return_inverse=True)[1]
            first = np.full(int(group.max(initial=-1)) + 1, len(code))
            np.minimum.at(first, group, np.arange(len(code)))
            mine = table.select(keys).take(pa.array(first)) if keys else _one(len(first))
            for i, k in enumerate(keys):
                if k not in of:
                    mine = mine.set_column(i, k, pa.nulls(len(first), arrow.field(k).type))
            if scopes:
                mine = mine.add_column(0, "scope", pa.array([name] * len(first), pa.string()))
            yield from _batches(_Groups(spec, mine, group, code, n, {}).rows(), arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_ = [], 0
        for b in batches:
            held.append(b)
            rows_ += b.num_rows
            if rows_ >= CHUNK_ROWS:
                yield from made(pa.Table.from_batches(held))
                held, rows_ = [], 0
        if rows_:
            yield from made(pa.Table.from_batches(held))

    return merge(rows.mapInArrow(run, schema), [f.name for f in fields], spec)


def merge(rows: DataFrame, keys: Sequence[str], spec: SketchSpec = SketchSpec()) -> DataFrame:
    """Add up sketches over the groups of ``keys`` (a subset of their key columns).

    The parts of a group are added in different tasks, so that none gets the whole of a
    group that most rows belong to.
    """
    keys = list(keys)
    used = rows.select(*keys, "part", "data")
    schema = used.schema
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _added(batches, [*keys, "part"], spec):
            yield from _batches(g.rows(), arrow)

    return used.repartition(*keys, "part").sortWithinPartitions(*keys, "part").mapInArrow(run, schema)


def _invert(spec: SketchSpec, table: dict[int, np.ndarray], probs: Sequence[float]) -> tuple[int, np.ndarray, float]:
    """Rows, quantile codes and the rank error of one group in counters."""
    total = float(table[0].sum())
    if total <= 0:
        return 0, np.zeros(len(probs), "int64"), 0.0

    def count(p: int, cell: np.ndarray) -> np.ndarray:
        if p <= spec.exact_bits:
            return table[p][cell].astype("float64")
        at = [_place(spec, p, r, cell) for r in range(spec.depth)]
        return np.median([g * table[p][s] for s, g in at], axis=0)

    # the k-th smallest with k = ceil(q n): the smallest value whose rank reaches it
    want = np.maximum(np.ceil(np.asarray(probs) * total - 1e-9), 1.0)
    node = np.zeros(len(want), "int64")
    have = np.full(len(want), total)
    for p in range(1, spec.bits + 1):
        left = np.clip(count(p, node * 2), 0, have)
        if p > spec.exact_bits:
            right = np.clip(count(p, node * 2 + 1), 0, have)
            both = left + right
            left = np.where(both > 0, have * left / np.where(both > 0, both, 1), have / 2)  # children add up to their parent
        go = want > left
        want = np.where(go, want - left, want)
        have = np.maximum(np.where(go, have - left, left), 0)
        node = node * 2 + go
    rest = spec.width - spec.width // 16
    f2 = [np.median(np.sort(table[p].reshape(spec.depth, spec.width).astype("float64") ** 2, axis=1)[:, :rest].sum(axis=1)) for p in range(spec.exact_bits + 1, spec.bits + 1)]
    return int(total), node, min(3 * float(np.sqrt(sum(f2) / spec.width)) / total, 1.0)


def quantiles(rows: DataFrame, keys: Sequence[str], probs: Sequence[float], spec: SketchSpec = SketchSpec(), names: Sequence[str] | None = None) -> DataFrame:
    """Per group ``n``, one column per probability, ``rank_error`` and ``value_error``.

    The quantile q is the middle of the smallest cell whose rank reaches ceil(q n).  What
    a group's sketch holds is bounded whatever it summarises.  Groups of codes are
    inverted together, a batch at a time, those of counters by descent.  Groups whose
    weights add up to nothing are left out.
    """
    keys = list(keys)
    names = list(names) if names else [f"q{p:g}" for p in probs]
    used = rows.select(*keys, "part", "data")
    used = used.repartition(*keys).sortWithinPartitions(*keys) if keys else used.repartition(1)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names], T.StructField("rank_error", T.DoubleType()), T.StructField("value_error", T.DoubleType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _added(batches, keys, spec):
            count = max(g.keys.num_rows, 1)
            total, error = np.zeros(count, "int64"), np.zeros(count)
            found = np.zeros((count, len(probs)), "int64")
            for i, table in g.dense.items():
                total[i], found[i], error[i] = _invert(spec, table, probs)
            if len(g.code):
                run_ = np.cumsum(g.n)
                at = np.flatnonzero(np.append(True, g.group[1:] != g.group[:-1]))
                ends = np.append(at[1:], len(g.code)) - 1
                base = np.concatenate([[0], run_[ends[:-1]]])
                mine = g.group[at]
                total[mine] = run_[ends] - base
                for j, p in enumerate(probs):
                    want = base + np.maximum(np.ceil(p * total[mine] - 1e-9), 1).astype("int64")
                    # runs only rise inside a group; deletions leave no negative count in a sound sketch
                    found[mine, j] = g.code[np.minimum(np.searchsorted(np.maximum.accumulate(run_), want), ends)]
            value, off = spec.decode(found)
            out = pa.table({**{k: g.keys.column(k) for k in keys}, "n": total, **{c: value[:, j] for j, c in enumerate(names)}, "rank_error": error, "value_error": off.max(axis=1, initial=0.0)})
            yield from _batches(out.filter(pc.greater(out.column("n"), 0)), arrow)

    return used.mapInArrow(run, schema)


def _alike(cols: Sequence[str]) -> Column:
    """Columns of ``a`` and ``b`` are equal, or null in both."""
    alike = F.lit(True)
    for c in cols:
        alike = alike & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return alike


def of_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys, of which some may be null, are among ``groups``."""
    return df.alias("a").join(groups.alias("b"), _alike(keys), "left_semi")


def exact(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], spec: SketchSpec = SketchSpec(), names: Sequence[str] | None = None) -> DataFrame:
    """Per group ``n``, one column per probability and ``value_error``, without rank error.

    The rows are counted by the upper half of their code, then those of the cells that hold
    a wanted rank by the lower half.  Counts are made inside partitions first, so that no
    task gets the rows of a large group.
    """
    keys = list(keys)
    names = list(names) if names else [f"q{p:g}" for p in probs]
    rows = _finite(df, keys, value)
    half = spec.bits // 2
    coded = T.StructType([*[rows.schema[k] for k in keys], T.StructField("high", T.IntegerType()), T.StructField("low", T.IntegerType())])
    arrow = _arrow(coded)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            code = spec.encode(table.column("__v").to_numpy()).astype("int64")
            yield from _batches(table.append_column("high", pa.array((code >> half).astype("int32"))).append_column("low", pa.array((code & ((1 << half) - 1)).astype("int32"))), arrow)

    def counted(df: DataFrame, by: list[str], digit: str) -> DataFrame:
        """Rows of each digit and of all up to it."""
        return df.groupBy(*by, digit).agg(F.count(F.lit(1)).alias("here")).withColumn("upto", F.sum("here").over(Window.partitionBy(*by).orderBy(digit)))

    codes = rows.mapInArrow(encode, coded)
    holds = (F.col("k") > F.col("upto") - F.col("here")) & (F.col("k") <= F.col("upto"))
    wants = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), F.greatest(F.ceil(F.lit(float(p)) * F.col("n") - 1e-9).cast("bigint"), F.lit(1)).alias("k")) for i, p in enumerate(probs)]))
    first = counted(codes, keys, "high").withColumn("n", F.sum("here").over(Window.partitionBy(*keys))).withColumn("w", wants)
    first = written(first.select("*", "w.*").where(holds).select(*keys, "high", "n", "q", (F.col("k") - F.col("upto") + F.col("here")).alias("k")))
    cell = [*keys, "high"]
    second = counted(of_groups(codes, first.select(*cell).distinct(), cell), cell, "low")
    found = second.alias("a").join(first.alias("b"), _alike(cell)).where(holds).select(*[f"a.{c}" for c in cell], "low", "n", "q")
    code = F.col("high").cast("bigint") * (1 << half) + F.col("low")
    found = found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("q") == i, code)).alias(f"__{i}") for i in range(len(names))])
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names], T.StructField("value_error", T.DoubleType())])
    out = _arrow(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            table = pa.Table.from_batches([b])
            value, off = spec.decode(np.stack([table.column(f"__{i}").to_numpy() for i in range(len(names))], axis=1))
            yield from _batches(pa.table({**{k: table.column(k) for k in keys}, "n": table.column("n"), **{c: value[:, j] for j, c in enumerate(names)}, "value_error": off.max(axis=1, initial=0.0)}), out)

    return found.where("n is not null").mapInArrow(decode, schema)
