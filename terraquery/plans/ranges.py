"""Driver-side coverings of a box by code ranges, for row-group skipping and compatibility."""

from __future__ import annotations

from terraquery.functions.codes import BITS, CURVE_ORDER, WORLD, axis_index_py, morton_py


def _octant_code(octant: int, curve: bool) -> int:
    """Digit of an octant given as x + 2y + 4z."""
    if not curve:
        return octant
    x, y, z = octant & 1, octant >> 1 & 1, octant >> 2 & 1
    return CURVE_ORDER[x * 4 + y * 2 + z]


def code_ranges(lo: tuple[int, int, int], hi: tuple[int, int, int], most: int = 64, curve: bool = False) -> list[tuple[int, int]]:
    """Sorted, merged closed ranges of codes that cover the closed index box.

    Octants are refined breadth first, so that with ``most`` reached the remaining ones
    are emitted whole: the cover may then be too large but never misses a cell.
    """
    done, level, front = [], BITS, [((0, 0, 0), 0)]
    while front:
        size = 1 << level
        inner, edge = [], []
        for (x, y, z), code in front:
            c = (x, y, z)
            if any(c[i] + size - 1 < lo[i] or c[i] > hi[i] for i in range(3)):
                continue
            whole = all(c[i] >= lo[i] and c[i] + size - 1 <= hi[i] for i in range(3))
            (inner if whole or level == 0 else edge).append((c, code))
        span = 8 ** level
        done += [(code * span, code * span + span - 1) for _, code in inner]
        if len(done) + len(edge) * 8 > most and level < BITS:
            done += [(code * span, code * span + span - 1) for _, code in edge]
            break
        half = size >> 1
        front = [((c[0] + (o & 1) * half, c[1] + (o >> 1 & 1) * half, c[2] + (o >> 2 & 1) * half), code * 8 + _octant_code(o, curve)) for c, code in edge for o in range(8)]
        level -= 1
    merged: list[list[int]] = []
    for a, b in sorted(done):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def world_box(lo: tuple[float, float, float], hi: tuple[float, float, float]) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """Index box of a world box, with swapped bounds set right."""
    at = lambda p: tuple(axis_index_py(v, *WORLD[a]) for v, a in zip(p, "xyz"))
    a, b = at(lo), at(hi)
    return tuple(map(min, a, b)), tuple(map(max, a, b))


def cell_count(lo: tuple[int, int, int], hi: tuple[int, int, int], level: int) -> int:
    """Cells of a level that touch the index box, by arithmetic."""
    n = 1
    for a, b in zip(lo, hi):
        n *= (b >> BITS - level) - (a >> BITS - level) + 1
    return n


def cells(lo: tuple[int, int, int], hi: tuple[int, int, int], level: int, most: int | None = None) -> list[int]:
    """Sorted block codes of the cells of a level that touch the index box; of the first ``most`` (x slowest), if given.

    A list is for boxes of few cells; queries use the ranges of ``within_blocks``.
    """
    s = BITS - level
    first = [v >> s for v in lo]
    n = [(b >> s) - a + 1 for a, b in zip(first, hi)]
    count = n[0] * n[1] * n[2] if most is None else min(most, n[0] * n[1] * n[2])
    at = ((i // (n[1] * n[2]), i // n[2] % n[1], i % n[2]) for i in range(count))
    return sorted(morton_py(*((f + d) << s for f, d in zip(first, place))) for place in at)
