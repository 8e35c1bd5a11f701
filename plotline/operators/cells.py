"""A layout by place: positions as numbers along a space-filling curve, boxes as ranges of them.

``cell`` interleaves the bits of longitude and latitude on a grid of ``2 ** BITS`` by ``2 ** BITS`` over the globe, so the
cells of a square block are one range of numbers.  ``tile`` is the number of the block of ``2 ** TILE_BITS`` a side that
holds the cell; it is the folder of a stored row.  A box becomes the few ranges that cover it: tiles choose folders, ranges
skip the row groups of files that are sorted by cell, and the exact comparison decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plotline.operators import filters as P

BITS = 20
TILE_BITS = 10
CELL, TILE = "cell", "tile"
# Ranges of a box: more of them follow its edge more closely.
RANGES = 32

Box = tuple[float, float, float, float]  # south, north, west, east


def _grid(value: float, low: float, width: float) -> int:
    return min(max(int((value - low) / width * 2**BITS), 0), 2**BITS - 1)


def _grid_column(value: Column, low: float, width: float) -> Column:
    at = F.floor((value - low) / width * 2**BITS)
    return F.least(F.greatest(at, F.lit(0)), F.lit(2**BITS - 1)).cast("long")


# Moves the lower 32 bits of a number apart: (shift, mask) of each doubling.
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _apart_column(x: Column) -> Column:
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def cell_of(lat: Column, lng: Column) -> Column:
    """Number of the grid cell of a position; NULL without one."""
    x, y = _grid_column(lng, -180.0, 360.0), _grid_column(lat, -90.0, 180.0)
    return F.when(lat.isNotNull() & lng.isNotNull(), _apart_column(x).bitwiseOR(F.shiftleft(_apart_column(y), 1)))


def tile_of(cell: Column) -> Column:
    """Number of the block of a cell, its folder; -1 without a position."""
    return F.coalesce(F.shiftright(cell, 2 * TILE_BITS).cast("int"), F.lit(-1))


def box_ranges(box: Box, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of cells, ends included, that cover a box; empty for an empty box.

    Blocks are split into quarters, always the largest one that lies on the edge, as long as the ranges are few enough.
    """
    south, north, west, east = box
    if south > north or west > east:
        return []
    lo = _grid(west, -180.0, 360.0), _grid(south, -90.0, 180.0)
    hi = _grid(east, -180.0, 360.0), _grid(north, -90.0, 180.0)
    inside: list[tuple[int, int]] = []
    edge = [(BITS, 0, 0, 0)]  # (side in bits, first cell, x, y)
    while edge:
        edge.sort()
        bits, first, x, y = edge.pop()
        quarters = []
        for k in range(4):
            side = 1 << (bits - 1)
            qx, qy = x + (k & 1) * side, y + (k >> 1) * side
            if qx > hi[0] or qy > hi[1] or qx + side - 1 < lo[0] or qy + side - 1 < lo[1]:
                continue
            start = first + (k << 2 * (bits - 1))
            whole = lo[0] <= qx and qx + side - 1 <= hi[0] and lo[1] <= qy and qy + side - 1 <= hi[1]
            quarters.append((whole or bits == 1, (bits - 1, start, qx, qy)))
        if len(_joined(inside, edge + [q for _, q in quarters])) > most:
            return _joined(inside, [*edge, (bits, first, x, y)])
        inside += [_range(q) for done, q in quarters if done]
        edge += [q for done, q in quarters if not done]
    return _joined(inside, [])


def _range(block: tuple[int, int, int, int]) -> tuple[int, int]:
    bits, first, _, _ = block
    return first, first + (1 << 2 * bits) - 1


def _joined(ranges: list[tuple[int, int]], blocks: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Ranges and blocks in order, neighbours as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges + [_range(x) for x in blocks]):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def in_box(df: DataFrame, box: Box) -> DataFrame:
    """Rows inside a box; of a table with ``cell`` and ``tile``, only the folders and row groups that can hold some are read."""
    exact = P.in_box(*box)
    if CELL not in df.columns or TILE not in df.columns:
        return df.where(exact)
    ranges = box_ranges(box)
    if not ranges:
        return df.where(F.lit(False))
    either = lambda parts: reduce(lambda a, b: a | b, parts)
    tiles = _joined([(a >> 2 * TILE_BITS, b >> 2 * TILE_BITS) for a, b in ranges], [])
    return df.where(either([F.col(TILE).between(a, b) for a, b in tiles])).where(either([F.col(CELL).between(a, b) for a, b in ranges])).where(exact)


def write_by_place(df: DataFrame, path: str) -> None:
    """A table laid out for boxes: a folder per tile, rows in the order of the curve; rows without a position in one folder.

    The rebalance splits tiles with many rows over files and puts small ones together.
    """
    cell = cell_of(F.col("lat").cast("double"), F.col("lng").cast("double"))
    rows = df.withColumn(CELL, cell).withColumn(TILE, tile_of(F.col(CELL)))
    rows.hint("rebalance", TILE).sortWithinPartitions(TILE, CELL).write.mode("overwrite").partitionBy(TILE).parquet(path)
