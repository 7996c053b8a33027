"""Grid, distance and direction functions for positions in New York."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The box, the grid and the length of a degree in km.
LON_EAST, LON_WEST, LAT_NORTH, LAT_SOUTH = -73.7, -74.05, 41.0, 40.5
DELTA_LON, DELTA_LAT, GRID_X, DEG_LEN = 0.0014, 0.00125, 250, 110.25


def in_nyc(lon: Column, lat: Column) -> Column:
    return lon.between(LON_WEST, LON_EAST) & lat.between(LAT_SOUTH, LAT_NORTH)


def _x(lon: Column) -> Column:
    return F.floor((abs(LON_WEST) - F.abs(lon)) / DELTA_LON)


def _y(lat: Column) -> Column:
    return F.floor((LAT_NORTH - lat) / DELTA_LAT)


def grid_cell(lon: Column, lat: Column) -> Column:
    return (_x(lon) + _y(lat) * GRID_X).cast("int")


def cell_center_lon(cell: Column) -> Column:
    return (-(abs(LON_WEST) - (cell % GRID_X) * DELTA_LON - DELTA_LON / 2)).cast("float")


def cell_center_lat(cell: Column) -> Column:
    return (LAT_NORTH - F.floor(cell / GRID_X) * DELTA_LAT - DELTA_LAT / 2).cast("float")


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Kilometres; the cosine takes the second latitude's degrees as they are."""
    x, y = lat1 - lat2, (lon1 - lon2) * F.cos(lat2)
    return DEG_LEN * F.sqrt(x * x + y * y)


def direction(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Whole degrees from the start to the destination."""
    x, y = lat2 - lat1, (lon2 - lon1) * F.cos(lat1)
    return F.degrees(F.atan2(x, y)).cast("int") + 179


def random_lon(seed: int) -> Column:
    return (LON_EAST - (LON_EAST - LON_WEST) * F.rand(seed)).cast("float")


def random_lat(seed: int) -> Column:
    return (LAT_SOUTH + (LAT_NORTH - LAT_SOUTH) * F.rand(seed)).cast("float")


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, not wherever ``f`` uses it: nothing within a lambda is shared otherwise."""
    return F.transform(F.array(value), f)[0]


def cells_on_way(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Cells that the line between the middles of two cells passes, as an array from its western end (the first position,
    if both lie in one column); null where a coordinate is null.

    The line leaves the i-th column of cells at i + 1/2 columns from its start, so the rows passed in each column follow
    from the slope alone, in whole numbers. Where it leaves within a twentieth of a cell's height from a corner, it goes on
    in the cell beyond that corner, on rising and falling lines alike.
    """
    ends = F.struct(*(c.cast("long").alias(n) for n, c in (("x1", _x(lon1)), ("y1", _y(lat1)), ("x2", _x(lon2)), ("y2", _y(lat2)))))

    def way(e: Column) -> Column:
        east = e["x1"] <= e["x2"]
        x, y, y_end = F.when(east, e["x1"]).otherwise(e["x2"]), F.when(east, e["y1"]).otherwise(e["y2"]), F.when(east, e["y2"]).otherwise(e["y1"])
        wide, high = F.abs(e["x2"] - e["x1"]), F.abs(y_end - y)
        step = F.when(y_end < y, -GRID_X).otherwise(GRID_X)
        # heights in fortieths of a row, times the width; 18 of them are a half less a twentieth
        parts = {"cell": (x + y * GRID_X).cast("int"), "step": step, "wide": wide.cast("int"), "high": high, "rise": 40 * high, "leave": 20 * high + 18 * wide, "row": F.greatest(40 * wide, F.lit(1))}
        return F.struct(*(c.alias(n) for n, c in parts.items()))

    def cells(w: Column) -> Column:
        def column(i: Column) -> Column:
            first = F.greatest(F.ceil(((i * w["rise"]) - w["leave"]) / w["row"]), F.lit(0)).cast("int")
            last = F.least(F.floor(((i * w["rise"]) + w["leave"]) / w["row"]), w["high"]).cast("int")
            start = w["cell"] + i
            # a flat line passes a corner for several columns
            return _bound(first, lambda f: F.sequence(start + w["step"] * f, start + w["step"] * F.greatest(f, last), w["step"]))

        return F.flatten(F.transform(F.sequence(F.lit(0), w["wide"]), column))

    known = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    return F.when(known, _bound(_bound(ends, way), cells))
