"""Temporal reducers over image time series: one scan each, conditional aggregates for two windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graupel.functions.bands import to_db, to_linear
from graupel.functions.lineage import of_event, passed_on
from graupel.functions.predicates import in_window, snow_day


def scenes_with_pixels(scenes: DataFrame, pixels: DataFrame, most_scenes: int = 200_000) -> DataFrame:
    """Pixels of the given scenes.

    Scene rows are short metadata: up to ``most_scenes`` of them (checked) are broadcast; beyond that
    the join shuffles both sides.
    """
    keep = scenes.select("scene_id", "acq_date", "orbit")
    small = keep.limit(most_scenes + 1).count() <= most_scenes
    return pixels.join(F.broadcast(keep) if small else keep, "scene_id")


def composite_change(series: DataFrame, reference, activity, median: bool = False, keys=("orbit", "row", "col"), accuracy: int | None = None) -> DataFrame:
    """Composites of both windows in dB and the mean angle of the activity window.

    Means are taken in linear power, medians in dB; ``accuracy`` asks for medians by a sketch of bounded size, a known value of
    rank within n / accuracy of the middle, instead of exact ones.  Columns: keys, vv_ref, vh_ref, vv_act, vh_act, angle.
    """
    ref, act = in_window(F.col("acq_date"), reference), in_window(F.col("acq_date"), activity)

    def reduced(band, window):
        if median and accuracy:
            return F.percentile_approx(F.when(window, F.col(band)), 0.5, accuracy)
        if median:
            return F.median(F.when(window, F.col(band)))
        return to_db(F.avg(F.when(window, to_linear(F.col(band)))))

    bands = [reduced(b, ref).alias(f"{b}_ref") for b in ("vv", "vh")] + [of_event(reduced(b, act), f"{b}_act") for b in ("vv", "vh")]
    return series.groupBy(*keys).agg(*bands, F.avg(F.when(act, F.col("angle"))).alias("angle"))


def difference(composites: DataFrame) -> DataFrame:
    """Adds dvv, dvh (NULL where a window has no value) and drops cells without both."""
    out = composites.withColumns({"dvv": F.col("vv_act") - F.col("vv_ref"), "dvh": F.col("vh_act") - F.col("vh_ref")}).where("dvv is not null and dvh is not null")
    return passed_on(out, composites, {"dvv": ["vv_act", "vv_ref"], "dvh": ["vh_act", "vh_ref"]})


def season_climate(monthly: DataFrame, months: list[int]) -> DataFrame:
    """row, col, temp_winter (from tenths of a degree), precip_winter over the months."""
    own = monthly.where(F.col("month").isin(months))
    return own.groupBy("row", "col").agg((F.avg("tavg") * 0.1).alias("temp_winter"), F.sum("prec").alias("precip_winter"))


def first_version(layers: DataFrame, order: str = "version") -> DataFrame:
    """Cells of the first image of a collection."""
    first = layers.agg(F.min(order).alias(order))
    return layers.join(F.broadcast(first), order).drop(order)  # one row


def snow_duration(daily: DataFrame, years: list[int], first_month: int = 1, last_month: int = 5) -> DataFrame:
    """Mean over the years of the season's snow days; a year without any observation drops out."""
    season = daily.where(F.year("obs_date").isin(years) & F.month("obs_date").between(first_month, last_month))
    yearly = season.groupBy("row", "col", F.year("obs_date").alias("year")).agg(F.sum(snow_day(F.col("ndsi"))).alias("days"))
    return yearly.groupBy("row", "col").agg(F.avg("days").alias("scd"))


def optical_median(series: DataFrame, bands: list[str], keys=("row", "col")) -> DataFrame:
    return series.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands])
