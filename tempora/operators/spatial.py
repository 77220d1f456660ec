"""Spatial joins on a one-degree cell grid: radius, box and nearest, each exact and none all-pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import asin, degrees, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import geo
from tempora.functions.values import ratio
from tempora.operators.joins import with_every
from tempora.session import stage

#: Sides of the cells of a pyramid in degrees, coarse to fine; each is a multiple of the next, and the last is 1.
LEVELS = (16, 4, 1)


def _cell(x: Column) -> Column:
    return F.floor(x)


def _wrap(cell: Column) -> Column:
    return F.pmod(cell + 180, F.lit(360)) - 180


def turn(degrees_apart: Column) -> Column:
    """A difference of longitudes the short way round."""
    return F.pmod(degrees_apart + 180, F.lit(360.0)) - 180


def with_cell(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumns({"_clat": _cell(F.col(lat)), "_clon": _wrap(_cell(F.col(lon)))})


def cover(anchors: DataFrame, reach_lat: Column, reach_lon: Column) -> DataFrame:
    """Anchor rows repeated for every cell that their box touches."""
    lat, lon = F.col("latitude"), F.col("longitude")
    rows = F.sequence(_cell(lat - reach_lat), _cell(lat + reach_lat))
    cols = F.array_distinct(F.transform(F.sequence(_cell(lon - reach_lon), _cell(lon + reach_lon)), _wrap))
    return anchors.withColumn("_clat", F.explode(rows)).withColumn("_clon", F.explode(cols))


def distance(lat: str = "lat", lon: str = "lon") -> Column:
    return geo.haversine_km(F.col("latitude"), F.col("longitude"), F.col(lat), F.col(lon))


def points_within(points: DataFrame, anchors: DataFrame, radius_km: float) -> DataFrame:
    """Points within the radius of an anchor, with ``distance_km``."""
    reach = degrees(radius_km / geo.EARTH_KM) * 1.0001
    # a circle that holds a pole meets every meridian
    latitude = F.abs(F.col("latitude"))
    side = F.degrees(F.asin(F.sin(F.radians(F.lit(reach))) / F.cos(F.radians(latitude)))) * 1.0001
    wide = F.when(latitude + reach >= 90, F.lit(180.0)).otherwise(side)
    near = with_cell(points).join(cover(anchors, F.lit(reach), wide), ["_clat", "_clon"])
    return near.withColumn("distance_km", distance()).filter(F.col("distance_km") <= radius_km).drop("_clat", "_clon")


def radius_counts(points: DataFrame, anchors: DataFrame, radii: Sequence[int], kinds: Sequence[str]) -> DataFrame:
    """Records and distinct granules per anchor, kind and radius; combinations without a point keep a zero row."""
    near = points_within(points, anchors.select("station_id", "latitude", "longitude"), float(max(radii)))
    rings = F.filter(F.array(*[F.lit(r) for r in radii]), lambda r: F.col("distance_km") <= r)
    # one row per granule first, so that neither count gathers a hot station in one task
    per_granule = (
        near.withColumn("radius_km", F.explode(rings))
        .groupBy("station_id", "lightning_type", "radius_km", "granule")
        .agg(F.count("*").alias("k"))
    )
    facts = per_granule.groupBy("station_id", "lightning_type", "radius_km").agg(
        F.sum("k").alias("records"), F.count("*").alias("granules")
    )
    dim = anchors.select("station_id").withColumn("lightning_type", F.explode(F.array(*[F.lit(k) for k in kinds])))
    dim = dim.withColumn("radius_km", F.explode(F.array(*[F.lit(r) for r in radii])))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("records", "granules")}
    return dim.join(facts, ["station_id", "lightning_type", "radius_km"], "left").withColumns(zero)


def cell_reach_km(side: int) -> float:
    """No place of a cell of that side in degrees is farther than this from the middle of the cell."""
    return 2 * geo.EARTH_KM * asin(2**0.5 * sin(radians(side / 4))) * 1.001


def pyramid(points: DataFrame, group: Sequence[str], valid: Column | None = None) -> DataFrame:
    """One row per group with its occupied cells as nested lists, coarse cells outside; groups without valid points keep a row.

    The globe bounds every list: a cell holds 16 finer ones, and a group at most 64,800 cells of a degree however many
    points it has. Points combine to cells where they are read, so a group with most of all points is no single task.
    """
    here = F.lit(True) if valid is None else valid
    keys = [f"_{axis}{side}" for side in LEVELS for axis in ("lat", "lon")]
    cells = with_cell(points).select(
        *group,
        *[F.when(here, F.floor(F.col(c) / side)).alias(f"_{axis}{side}") for side in LEVELS for axis, c in (("lat", "_clat"), ("lon", "_clon"))],
    )
    rows = cells.groupBy(*group, *keys).agg(F.lit(1).alias("_one"))
    inner: Column | None = None
    for depth in range(len(LEVELS) - 1, -1, -1):
        side = LEVELS[depth]
        place = [F.col(f"_lat{side}").alias("lat"), F.col(f"_lon{side}").alias("lon")]
        item = F.struct(*place) if inner is None else F.struct(*place, inner.alias("inner"))
        # a list leaves nulls out, so a group's invalid points add no cell
        listed = F.collect_list(F.when(F.col(f"_lat{side}").isNotNull(), item))
        rows = rows.groupBy(*group, *keys[: 2 * depth]).agg(listed.alias("_cells"))
        inner = F.col("_cells")
    return rows


def nearest_cells(cells: Column) -> Column:
    """The one-degree cells of a pyramid that can hold the point nearest to ``latitude``, ``longitude``.

    Level by level, a cell goes whose middle is farther than the best middle by more than twice the reach of a cell, as
    the best cell holds a nearer point; only the finer cells of those that stay are looked at.
    """
    for depth, side in enumerate(LEVELS):
        far = F.transform(cells, lambda c: F.struct(_middle_km(c, side).alias("km"), c.alias("cell")))
        kept = _bound(far, lambda seen: _bound(_least(seen), lambda best: F.filter(seen, lambda c: c["km"] - best <= 2 * cell_reach_km(side))))
        if depth + 1 < len(LEVELS):
            cells = F.flatten(F.transform(kept, lambda c: c["cell"]["inner"]))
        else:
            cells = F.transform(kept, lambda c: F.struct(c["cell"]["lat"].alias("_clat"), c["cell"]["lon"].alias("_clon")))
    return cells


def _middle_km(cell: Column, side: int) -> Column:
    return geo.haversine_km(F.col("latitude"), F.col("longitude"), (cell["lat"] + 0.5) * side, (cell["lon"] + 0.5) * side)


def _least(far: Column) -> Column:
    return F.array_min(F.transform(far, lambda c: c["km"]))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body or its own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def nearest(points: DataFrame, anchors: DataFrame, group: Sequence[str], payload: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Nearest point of each anchor within each group, ties by ``order``.

    Anchors descend the pyramid of their group's cells, and only the points of the few remaining cells are compared.
    Anchors must carry the group columns; an anchor whose group has no point has no row.
    """
    ids = [*group, "station_id"]
    tops = pyramid(points, group)
    # without groups there is one world of at most 64,800 cells, which travels as one value
    placed = anchors.join(tops, list(group)) if group else anchors.withColumn("_cells", tops.scalar())
    wanted = placed.select(*anchors.columns, F.explode(nearest_cells(F.col("_cells"))).alias("_c")).select(*anchors.columns, "_c.*")
    near = with_cell(points).join(wanted, [*group, "_clat", "_clon"]).withColumn("distance_km", distance())
    pick = F.struct(F.col("distance_km"), *[F.col(c) for c in order])
    return near.groupBy(*ids).agg(F.min_by(F.struct("distance_km", *payload), pick).alias("_n")).select(*ids, "_n.*")


def scan_features(pixels: DataFrame, anchors: DataFrame, radius_km: float = 25.0, box_deg: float = 1.0) -> DataFrame:
    """Per scan and station: nearest valid pixel in the box (any distance when the box is empty) and
    the valid, cloudy and clear share within the radius; shares are unknown when no pixel is near."""
    ok = geo.valid_position(F.col("lat"), F.col("lon")) & geo.is_valid_class(F.col("cls"))
    valid = pixels.filter(ok).select("scan_id", "row", "col", "lat", "lon", "cls")
    where = anchors.select("station_id", "latitude", "longitude")
    boxed = (
        with_cell(valid)
        .join(cover(where, F.lit(box_deg), F.lit(box_deg)), ["_clat", "_clon"])
        .filter((F.abs(F.col("lat") - F.col("latitude")) <= box_deg) & (F.abs(turn(F.col("lon") - F.col("longitude"))) <= box_deg))
        .withColumn("distance_km", distance())
    )
    in_reach = F.col("distance_km") <= radius_km
    ids = ["scan_id", "station_id"]
    payload = F.struct("distance_km", "row", "col", "cls")
    local = boxed.groupBy(*ids).agg(
        F.min_by(payload, F.struct("distance_km", "row", "col")).alias("_n"),
        F.count_if(in_reach).alias("valid_pixels"),
        F.count_if(in_reach & geo.is_cloudy(F.col("cls"))).alias("_cloudy"),
        F.count_if(in_reach & geo.is_clear(F.col("cls"))).alias("_clear"),
    )
    local = local.select(*ids, "_n.*", "valid_pixels", "_cloudy", "_clear")
    # every scan has its pyramid, and only where a station's box is empty is it descended
    tops = pyramid(pixels.select("scan_id", "lat", "lon", "cls"), ["scan_id"], ok)
    grid = with_every(tops, where, where.columns).join(local, ids, "left")
    sought = F.when(F.col("valid_pixels").isNull(), nearest_cells(F.col("_cells")))
    grid = stage(grid.withColumn("_near", sought).drop("_cells"), "scan_grid")
    wanted = grid.select(*ids, "latitude", "longitude", F.explode("_near").alias("_c")).select(*ids, "latitude", "longitude", "_c.*")
    far = with_cell(valid).join(wanted, ["scan_id", "_clat", "_clon"]).withColumn("distance_km", distance())
    far = far.groupBy(*ids).agg(F.min_by(payload, F.struct("distance_km", "row", "col")).alias("_f"))
    out = grid.join(far, ids, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col("_f")[c]) for c in ("distance_km", "row", "col", "cls")})
    return out.select(
        *ids,
        F.col("cls").alias("cloud_mask"),
        geo.class_name(F.col("cls")).alias("cloud_class"),
        F.round("distance_km", 6).alias("distance_km"),
        "row",
        "col",
        F.coalesce("valid_pixels", F.lit(0)).alias("valid_pixels"),
        ratio(F.col("_cloudy"), F.col("valid_pixels")).alias("cloudy_fraction"),
        ratio(F.col("_clear"), F.col("valid_pixels")).alias("clear_fraction"),
        F.col("cls").isNotNull().cast("int").alias("available"),
    )
