"""Row conditions on scenes, pixels, features and files, and the two change rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from graupel.functions.bands import all_of


def meets_bounds(area: tuple[float, float, float, float], w="w", s="s", e="e", n="n") -> Column:
    """Footprint columns meet the rectangle (west, south, east, north)."""
    return all_of(F.col(w) <= area[2], F.col(e) >= area[0], F.col(s) <= area[3], F.col(n) >= area[1])


def in_window(column: Column, window: tuple[str, str]) -> Column:
    """[start, end)."""
    return (column >= F.lit(window[0]).cast("date")) & (column < F.lit(window[1]).cast("date"))


def radar_scene(area, window, orbit: str | None = None, mode: str = "IW", pols: tuple[str, ...] = ("VV", "VH")) -> Column:
    own = [meets_bounds(area), in_window(F.col("acq_date"), window), F.col("mode") == mode, *[F.array_contains("pols", p) for p in pols]]
    return all_of(*own, *([F.col("orbit") == orbit] if orbit else []))


def few_clouds(most: float = 25.0) -> Column:
    return F.col("cloud_pct") < most


def detector(dvv="dvv", dvh="dvh", angle="angle", slope="slope", threshold: float = 2.0, angles=(20.0, 45.0), slopes=(10.0, 60.0)) -> Column:
    """Backscatter increase on usable ground; all bounds are strict."""
    a, s = F.col(angle), F.col(slope)
    return all_of(F.col(dvv) > threshold, F.col(dvh) > threshold - 1.0, a > angles[0], a < angles[1], s > slopes[0], s < slopes[1])


def label_map(dvv="dvv", dvh="dvh", slope="slope", slopes=(25.0, 55.0)) -> Column:
    """The rule of the labelling map: polarisations trade places, slope bounds belong to it."""
    return all_of(F.col(dvh) > 2.0, F.col(dvv) > 1.0, F.col(slope).between(*slopes))


def release_slope(slope="slope", slopes=(30.0, 50.0)) -> Column:
    return F.col(slope).between(*slopes)


def snow_day(ndsi: Column) -> Column:
    """1 for 40 to 100, 0 for other values (flags above 100 too), NULL for NULL."""
    return ndsi.between(40, 100).cast("int")


def line_feature(kind="geom_type") -> Column:
    return F.col(kind).isin("LineString", "MultiLineString")


def file_in_window(name: Column, first: int | None, last: int | None, prefix: str = "snd_", suffix: str = ".nc") -> Column:
    """Date of the name within both bounds; None or 0 leaves a side open, a name without a date passes."""
    day = F.replace(F.replace(name, F.lit(prefix), F.lit("")), F.lit(suffix), F.lit("")).try_cast("int")
    ok = F.lit(True)
    if first:
        ok = ok & (day >= first)
    if last:
        ok = ok & (day <= last)
    return day.isNull() | ok
