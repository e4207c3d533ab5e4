"""Radar change detection: candidates of one scan, components, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graupel.functions import predicates as P
from graupel.operators import components as C, stencil, temporal


def change_candidates(scenes: DataFrame, pixels: DataFrame, dem: DataFrame, area, reference, activity, px: float, smooth_cells: float = 0.0) -> DataFrame:
    """orbit, row, col, dvv, dvh, angle, slope of the cells that pass the detector rule.

    Orbits are a group key and both windows come from one scan.  With ``smooth_cells`` both
    composites are smoothed before they are compared.
    """
    series = temporal.scenes_with_pixels(scenes.where(P.radar_scene(area, (min(reference[0], activity[0]), max(reference[1], activity[1])))), pixels)
    both = temporal.composite_change(series, reference, activity)
    if smooth_cells:
        bands = ["vv_ref", "vv_act", "vh_ref", "vh_act"]
        smooth = stencil.focal(both, bands, smooth_cells, keys=("orbit",))
        both = both.drop(*bands).join(smooth, ["orbit", "row", "col"])
    slope = stencil.slope_four(dem, "elev", px).select("row", "col", "slope")
    joined = temporal.difference(both).join(slope, ["row", "col"])
    return joined.where(P.detector()).select("orbit", "row", "col", "dvv", "dvh", "angle", "slope")


def event_candidates(candidates: DataFrame, px: float, event: str, min_area_m2: float = 1500.0, both_orbits: bool = False) -> DataFrame:
    """Components of the candidates by orbit with area, tagged; ``both_orbits`` keeps cells seen from both."""
    if both_orbits:
        twice = candidates.groupBy("row", "col").agg(F.countDistinct("orbit").alias("n")).where("n = 2").select("row", "col")
        candidates = candidates.join(twice, ["row", "col"], "left_semi")
    labels = C.label_cells(candidates, ("orbit",))
    return C.at_least(C.component_stats(labels, px, ("orbit",)), min_area_m2).withColumn("event", F.lit(event))


def hotspots(scenes: DataFrame, pixels: DataFrame, dem: DataFrame, area, reference, activity, px: float, orbit: str, median_cells: float = 50 / 30) -> DataFrame:
    """row, col, dvv, dvh, slope by the label-map rule: median composites, median of the differences in a disk."""
    span = (min(reference[0], activity[0]), max(reference[1], activity[1]))
    series = temporal.scenes_with_pixels(scenes.where(P.radar_scene(area, span, orbit, pols=("VH",))), pixels)
    change = temporal.difference(temporal.composite_change(series, reference, activity, median=True, keys=("row", "col"))).select("row", "col", "dvv", "dvh")
    change = stencil.focal(change, ["dvv", "dvh"], median_cells, "median")
    slope = stencil.slope_four(dem, "elev", px).select("row", "col", "slope")
    return change.join(slope, ["row", "col"]).where(P.label_map())


def hotspot_layer(mask: DataFrame, least: int = 10, most: int = 50) -> DataFrame:
    """The mask without small components."""
    return C.pixel_count_mask(C.label_cells(mask), least, most).select("row", "col")
