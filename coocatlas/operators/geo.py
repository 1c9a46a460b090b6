"""The map: projection, joint scaling, density bins, GeoJSON, tiles and picking."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coocatlas.functions.hashing import uniform
from coocatlas.functions.numeric import scale_axis, tms_flip
from coocatlas.operators.ids import take_first
from coocatlas.schema import BY_NAME, ENTITIES, entity
from coocatlas.sources.staging import checkpoint

# Per layer, the factor by which points thin out per zoom level below the base zoom.
DROP_RATES = {"track": 1.8, "label": 2.05, "album": 2.27, "artist": 2.36}
MIN_ZOOM = 5
TILE_PIXELS = 512
# Cells per radius in picking: the diagonal of a cell is then shorter than half a radius.
CELLS_PER_WIDTH = 3
PICK_CELL = ["class", "cx", "cy"]


def union_projections(projections: dict[str, DataFrame]) -> DataFrame:
    """The four projections as (entity, rowid, umap_x, umap_y)."""
    parts = [
        projections[e.name].select(
            F.lit(e.name).alias("entity"), F.col(e.key).cast("bigint").alias("rowid"), "umap_x", "umap_y"
        )
        for e in ENTITIES
    ]
    return reduce(DataFrame.unionByName, parts)


def bounding_box(points: DataFrame, padding: float) -> DataFrame:
    """One row: the box around all points of all entities, widened by ``padding``."""
    return points.agg(
        (F.min("umap_x").cast("double") - padding).alias("x_min"),
        (F.max("umap_x").cast("double") + padding).alias("x_max"),
        (F.min("umap_y").cast("double") - padding).alias("y_min"),
        (F.max("umap_y").cast("double") + padding).alias("y_max"),
    )


def to_lonlat(points: DataFrame, half_lon: float = 22.5, half_lat: float = 22.5, padding: float = 1.0) -> DataFrame:
    """Scale all entities with one box to [-half_lon, half_lon] x [-half_lat, half_lat].

    A negative half width mirrors that axis.
    """
    boxed = points.crossJoin(F.broadcast(bounding_box(points, padding)))
    return boxed.select(
        "entity",
        "rowid",
        scale_axis(F.col("umap_x"), F.col("x_min"), F.col("x_max"), half_lon).alias("lon"),
        scale_axis(F.col("umap_y"), F.col("y_min"), F.col("y_max"), half_lat).alias("lat"),
    )


def entity_geo(lonlat: DataFrame, name: str) -> DataFrame:
    """(key, lon, lat) of one entity."""
    return lonlat.where(F.col("entity") == name).select(F.col("rowid").alias(entity(name).key), "lon", "lat")


def coordinate_summary(points: DataFrame) -> DataFrame:
    """Per axis: min, max, range, centre and population deviation, plus the point count."""
    axes = F.inline(
        F.array(
            F.struct(F.lit("x").alias("axis"), F.col("umap_x").cast("double").alias("v")),
            F.struct(F.lit("y").alias("axis"), F.col("umap_y").cast("double").alias("v")),
        )
    )
    return (
        points.select(axes)
        .groupBy("axis")
        .agg(
            F.min("v").alias("low"),
            F.max("v").alias("high"),
            (F.max("v") - F.min("v")).alias("extent"),
            ((F.max("v") + F.min("v")) / 2).alias("center"),
            F.stddev_pop("v").alias("std"),
            F.count("*").alias("points"),
        )
    )


def density_bins(points: DataFrame, bins: int = 1000) -> DataFrame:
    """(xi, yi, n) for the occupied cells of a bins x bins grid over the points' own box."""
    box = bounding_box(points, 0.0)

    def cell(v: str, low: str, high: str) -> Column:
        at = F.floor((F.col(v).cast("double") - F.col(low)) / (F.col(high) - F.col(low)) * bins)
        return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")

    return (
        points.crossJoin(F.broadcast(box))
        .groupBy(cell("umap_x", "x_min", "x_max").alias("xi"), cell("umap_y", "y_min", "y_max").alias("yi"))
        .agg(F.count("*").alias("n"))
    )


def project_2d(
    vectors: dict[str, DataFrame], popularity: DataFrame | None = None, sample: int | None = None, dims: int | None = None
) -> dict[str, DataFrame]:
    """Two principal axes fitted on all tracks, applied to every entity, the tracks' mean at the origin.

    One fitted model serves all entities, which keeps them on one map. The fit is one pass
    that sums a matrix of dimensions squared; no row reaches the driver. ``sample`` fits on
    the most popular tracks only; ``dims`` reduces the vectors first, as a separate model.
    """
    frames = {n: v.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>"))) for n, v in vectors.items()}
    fit_on = frames["track"]
    if sample is not None:
        chosen = take_first(popularity.select("track_rowid", "logcount"), sample, F.desc("logcount"), "track_rowid")
        fit_on = fit_on.join(chosen.select("track_rowid"), "track_rowid", "left_semi")
    source = "v"
    if dims is not None:
        reducer = PCA(k=dims, inputCol="v", outputCol="r").fit(fit_on)
        frames = {n: reducer.transform(f) for n, f in frames.items()}
        fit_on, source = reducer.transform(fit_on), "r"
    model = PCA(k=2, inputCol=source, outputCol="xy").fit(fit_on)
    xy = vector_to_array(F.col("xy"))
    centre = model.transform(frames["track"]).agg(F.avg(xy[0]).alias("_mx"), F.avg(xy[1]).alias("_my"))

    def project(name: str, frame: DataFrame) -> DataFrame:
        return model.transform(frame).crossJoin(F.broadcast(centre)).select(
            BY_NAME[name].key, (xy[0] - F.col("_mx")).cast("float").alias("umap_x"), (xy[1] - F.col("_my")).cast("float").alias("umap_y")
        )

    return {name: project(name, frame) for name, frame in frames.items()}


def named_points(points: DataFrame, popularity: DataFrame, names: DataFrame) -> DataFrame:
    """Projected tracks with popularity and names where known."""
    known = names.select("track_rowid", "artist_name", "track_name")
    return points.join(popularity.select("track_rowid", "logcount"), "track_rowid", "left").join(
        known, "track_rowid", "left"
    )


def highlights(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Most popular point per wanted (artist, track), compared case-insensitively; unmatched ones stay."""
    asked = wanted.select("artist", "track", F.lower("artist").alias("_a"), F.lower("track").alias("_t"))
    candidates = points.select(
        F.lower("artist_name").alias("_a"), F.lower("track_name").alias("_t"),
        F.struct("logcount", (-F.col("track_rowid")).alias("tie"), "track_rowid", "umap_x", "umap_y").alias("p"),
    )
    best = candidates.groupBy("_a", "_t").agg(F.max("p").alias("p"))
    return asked.join(best, ["_a", "_t"], "left").select(
        "artist", "track", F.col("p").isNotNull().alias("found"), "p.track_rowid", "p.logcount", "p.umap_x", "p.umap_y"
    )


def feature_json(table: DataFrame, name: str) -> DataFrame:
    """(rowid, line): one GeoJSON point feature per row of an entity table."""
    key = entity(name).key
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("Point").alias("type"),
            F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("coordinates"),
        ).alias("geometry"),
        F.struct(F.col(key).alias(key), F.col("logcount").cast("double").alias("logcount")).alias("properties"),
    )
    return table.select(F.col(key).cast("bigint").alias("rowid"), F.to_json(feature).alias("line"))


def sorted_lines(features: DataFrame) -> DataFrame:
    """The feature lines in key order across and within the partitions."""
    return features.repartitionByRange("rowid").sortWithinPartitions("rowid").select("line")


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features in key order across and within the part files."""
    sorted_lines(features).write.mode("overwrite").text(path)


def _world(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web-mercator position in [0, 1) x [0, 1), y downwards."""
    sin = F.sin(F.radians(lat.cast("double")))
    x = (lon.cast("double") + 180.0) / 360.0
    y = F.lit(0.5) - F.log((1 + sin) / (1 - sin)) / (4 * math.pi)
    return x, y


def tile_points(
    points: DataFrame, base_zooms: dict[str, int], max_zoom: int, seed: int = 0, portable: bool = False
) -> DataFrame:
    """(layer, z, x, y, rowid) for every zoom level a point shows at.

    Below a layer's base zoom a point stays with probability rate^-(base - z). One
    draw per point decides all levels, so a point shown at z is shown at z + 1 too.
    """
    pick = lambda values: F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[F.col("entity")]
    world_x, world_y = _world(F.col("lon"), F.col("lat"))
    draw = uniform(seed, "entity", "rowid", portable=portable)
    placed = points.select(
        F.col("entity").alias("layer"), "rowid", world_x.alias("wx"), world_y.alias("wy"), draw.alias("u"),
        pick(base_zooms).cast("int").alias("base"), pick(DROP_RATES).alias("rate"),
    )
    # u < rate^-(base - z)  <=>  z > base + log(u) / log(rate)
    levels = placed.withColumn("z", F.explode(F.sequence(F.lit(MIN_ZOOM), F.lit(max_zoom)))).where(
        (F.col("z") >= F.col("base")) | (F.col("u") < F.pow(F.col("rate"), F.col("z") - F.col("base")))
    )
    scale = F.pow(F.lit(2.0), F.col("z"))

    def tile(v: str) -> Column:
        return F.least(F.greatest(F.floor(F.col(v) * scale), F.lit(0)), scale - 1).cast("int")

    return levels.select("layer", "z", tile("wx").alias("x"), tile("wy").alias("y"), "rowid")


def tile_sizes(tiles: DataFrame) -> DataFrame:
    """Merged archive view: (zoom_level, tile_column, tile_row, size), rows counted bottom-up, size in points."""
    return (
        tiles.groupBy("z", "x", "y")
        .agg(F.count("*").alias("size"))
        .select(
            F.col("z").alias("zoom_level"), F.col("x").alias("tile_column"),
            tms_flip(F.col("z"), F.col("y")).cast("int").alias("tile_row"), "size",
        )
    )


def tile_size_stats(archive: DataFrame) -> DataFrame:
    """Tile count, total, mean and maximum size, and the largest tile in top-down coordinates."""
    order = F.struct("size", "zoom_level", "tile_column", "tile_row")
    return archive.agg(
        F.count("*").alias("tiles"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_size"),
        F.max(order).alias("m"),
    ).select(
        "tiles", "total_size", "mean_size", "max_size", F.col("m.zoom_level").alias("max_zoom"),
        F.col("m.tile_column").alias("max_x"), tms_flip(F.col("m.zoom_level"), F.col("m.tile_row")).alias("max_y"),
    )


def shown_at(features: DataFrame, tiles: DataFrame, zoom: int) -> DataFrame:
    """The features that the tiles of a zoom level hold, after thinning."""
    kept = tiles.where(F.col("z") == zoom).select(F.col("layer").alias("entity"), "rowid")
    return features.join(kept, ["entity", "rowid"], "left_semi")


def _pick_order() -> Column:
    return F.struct(-F.col("logcount"), F.col("entity"), F.col("rowid"))


def pick_features(clicks: DataFrame, features: DataFrame, zoom: int, radius: float = 8.0) -> DataFrame:
    """Most popular feature whose disc holds the click at a zoom level.

    ``clicks`` has (click_id, lon, lat), ``features`` (entity, rowid, lon, lat, logcount). A
    feature's disc has a radius of ``logcount`` pixels, at least ``radius``. Features are
    classed by powers of two of their radius; within a class both sides are keyed by cells so
    small that a disc centred in a cell holds it whole. The best feature that holds a whole
    cell is a floor for the clicks in it: only features before it in order can be picked
    there, and only those are met with the clicks, so that the pairs made grow with the clicks
    and not with their product with the features around. Cells within a disc's reach of no
    click are left out. Of features at the very same place only the first can be picked, so
    the others are left out before. Ties in popularity go to the lowest entity name and id.
    """
    asked, rivals = pick_sides(clicks, features, zoom, radius)
    squared = F.pow(F.col("px_c") - F.col("px_f"), F.lit(2)) + F.pow(F.col("py_c") - F.col("py_f"), F.lit(2))
    hits = asked.join(rivals, PICK_CELL).where(squared <= F.col("size") * F.col("size"))
    return (
        hits.groupBy("click_id")
        .agg(F.min_by(F.struct("entity", "rowid", "logcount"), _pick_order()).alias("best"))
        .select("click_id", "best.entity", "best.rowid", "best.logcount")
    )


def pick_sides(clicks: DataFrame, features: DataFrame, zoom: int, radius: float) -> tuple[DataFrame, DataFrame]:
    """Clicks by cell, and by cell the features that can be picked there."""
    pixels = float(TILE_PIXELS * (1 << zoom))

    def placed(df: DataFrame, suffix: str) -> DataFrame:
        x, y = _world(F.col("lon"), F.col("lat"))
        return df.withColumn(f"px{suffix}", x * pixels).withColumn(f"py{suffix}", y * pixels)

    order = _pick_order()
    popularity = F.col("logcount").cast("double")
    first = (
        placed(features.withColumn("logcount", popularity), "_f")
        .groupBy("px_f", "py_f")
        .agg(F.min_by(F.struct("entity", "rowid", "logcount"), order).alias("f"))
        .select("px_f", "py_f", "f.*")
    )
    size = F.greatest(F.lit(float(radius)), F.coalesce("logcount", F.lit(0.0)))
    discs = first.withColumn("size", size).withColumn("class", F.ceil(F.log2(size / F.lit(float(radius)))).cast("int"))
    # radii of a class lie between half its width and its width; the diagonal of a cell is less than half the width
    side = F.lit(float(radius)) * F.pow(F.lit(2.0), F.col("class")) / CELLS_PER_WIDTH
    near = F.sequence(F.lit(-CELLS_PER_WIDTH), F.lit(CELLS_PER_WIDTH))

    def celled(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumn("cx", F.floor(F.col(f"px{suffix}") / side)).withColumn("cy", F.floor(F.col(f"py{suffix}") / side))

    def around(df: DataFrame) -> DataFrame:
        """Each row once per cell within reach, the row's own cell becoming (ox, oy)."""
        return (
            df.withColumnsRenamed({"cx": "ox", "cy": "oy"})
            .withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
            .withColumn("cx", F.col("ox") + F.col("dx")).withColumn("cy", F.col("oy") + F.col("dy"))
            .drop("dx", "dy")
        )

    def gap(p: str, c: str, far: bool) -> Column:
        """Distance along one axis from a place to the farthest or nearest point of a cell."""
        low, high = F.col(c) * side - F.col(p), F.col(p) - (F.col(c) + 1) * side
        return F.greatest(-low, -high) if far else F.greatest(low, high, F.lit(0.0))

    def reach(far: bool) -> Column:
        return F.pow(gap("px_f", "cx", far), F.lit(2)) + F.pow(gap("py_f", "cy", far), F.lit(2))

    cell = PICK_CELL
    offered = checkpoint(celled(discs, "_f").withColumn("o", order))
    # at most one row per power of two that a radius has
    classes = F.broadcast(offered.select("class").distinct())
    asked = celled(placed(clicks, "_c").select("click_id", "px_c", "py_c").crossJoin(classes), "_c")
    clicked = asked.select(*cell).distinct()
    slack = F.lit(1e-9) * pixels
    # the best feature of each cell, offered to the cells that its disc holds whole
    tops = offered.groupBy(*cell).agg(F.min_by(F.struct("px_f", "py_f", "size", "o"), "o").alias("t")).select(*cell, "t.*")
    holds = F.sqrt(reach(True)) + slack <= F.col("size")
    floors = clicked.join(
        around(tops).where(holds).groupBy(*cell).agg(F.min("o").alias("floor")), cell, "left")
    floors = checkpoint(floors)
    # features that come after the floors of all clicked cells around can go at once
    weakest = around(floors).groupBy("class", F.col("cx"), F.col("cy")).agg(
        F.max("floor").alias("weakest"), F.bool_or(F.col("floor").isNull()).alias("open"))
    live = offered.join(weakest, cell).where(F.col("open") | (F.col("o") <= F.col("weakest"))).drop("weakest", "open")
    touches = F.sqrt(reach(False)) - slack <= F.col("size")
    rivals = around(live).where(touches).join(floors, cell).where(F.col("floor").isNull() | (F.col("o") <= F.col("floor")))
    return asked, rivals
