"""Looking up stops: search, distance, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, cell, haversine, planar, rounded, walk_seconds
from ..storage import counted, materialize


def search(stops: DataFrame, text: str, how: str = "contains") -> DataFrame:
    """Root stops whose name matches, upper or lower case alike.

    how is contains, starts, ends or exact. An empty text matches nothing.
    """
    name, wanted = F.lower("stop_name"), F.lit(text.lower())
    matches = {
        "contains": name.contains(wanted),
        "starts": name.startswith(wanted),
        "ends": name.endswith(wanted),
        "exact": name == wanted,
    }
    if how not in matches:
        raise ValueError(f"no such search: {how}")
    roots = stops.where(F.col("parent_station").isNull())
    return roots.where(matches[how] if text else F.lit(False))


def alphabetical() -> list[Column]:
    return [F.col("stop_name"), F.col("stop_id")]


def by_relevance(text: str) -> list[Column]:
    """Exact names first, then names that start so, then others; shorter ones first."""
    name, wanted = F.lower("stop_name"), F.lit(text.lower())
    score = F.when(name == wanted, 0).when(name.startswith(wanted), 1).otherwise(2)
    return [score, F.length("stop_name"), *alphabetical()]


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Every left point with the right points at most radius metres away, and distance.

    left has left_id, left_lat, left_lon; right has right_id, right_lat,
    right_lon. Points meet by grid cells about as wide as the radius: a left
    point looks into the cells around its own, so the join is on equal cells.
    Rows and columns near the poles or the date line are looked at by exact
    bounds of the search circle.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    size = radius / METRES_PER_DEGREE
    shrink = F.greatest(F.cos(F.radians(F.least(F.abs("left_lat") + size, F.lit(89.9)))), F.lit(1e-3))
    reach = F.least(size / shrink, F.lit(180.0))
    rows = F.sequence(cell(F.col("left_lat") - size, size), cell(F.col("left_lat") + size, size))
    around_globe = max(1, int(360 / size))
    width = 360 / around_globe
    columns = F.sequence(cell(F.col("left_lon") - reach, width), cell(F.col("left_lon") + reach, width))
    columns = F.array_distinct(F.transform(columns, lambda c: F.pmod(c, F.lit(around_globe))))
    around = left.withColumn("row", F.explode(rows)).withColumn("column", F.explode(columns))
    placed = right.withColumns(
        {
            "row": cell(F.col("right_lat"), size),
            "column": F.pmod(cell(F.col("right_lon"), width), F.lit(around_globe)),
        }
    )
    distance = haversine(F.col("left_lat"), F.col("left_lon"), F.col("right_lat"), F.col("right_lon"))
    met = around.join(placed, ["row", "column"]).drop("row", "column")
    return met.withColumn("distance", distance).where(F.col("distance") <= radius)


def planar_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Every left point of a plane with the right points at most radius away, and distance.

    left has left_id, left_x, left_y; right has right_id, right_x, right_y.
    Points meet by square cells as wide as the radius, a left point looking
    into its own and the eight around it; the plane has no edges to wrap.
    Points without both coordinates, or with one that isn't finite, meet none.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")

    def finite(side: str) -> Column:
        inside = [F.abs(F.col(f"{side}_{c}")) < float("inf") for c in "xy"]  # false for what isn't a number
        return F.coalesce(inside[0] & inside[1], F.lit(False))

    around = left.where(finite("left"))
    for name, axis in (("column", "left_x"), ("row", "left_y")):
        around = around.withColumn(name, F.explode(F.sequence(cell(F.col(axis), radius) - 1, cell(F.col(axis), radius) + 1)))
    placed = right.where(finite("right")).withColumns({"column": cell(F.col("right_x"), radius), "row": cell(F.col("right_y"), radius)})
    distance = planar(F.col("left_x"), F.col("left_y"), F.col("right_x"), F.col("right_y"))
    met = around.join(placed, ["column", "row"]).drop("column", "row")
    return met.withColumn("distance", distance).where(F.col("distance") <= radius)


#: Degrees by which coordinates may differ and still count as equal, and the width of cells in which they are put in order.
TOLERANCE, BAND_CELL = 1e-5, 0.01


def banded_order(places: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """places with lat_band and lon_band, an order of coordinates in which nearly equal ones tie.

    places has lat and lon. Comparing within a tolerance is no order, as it
    isn't transitive: of three points in a row the outer two may differ though
    each equals the middle one. So equal latitudes are chained: sorted, a band
    goes on while the next latitude is at most the tolerance greater, and
    within a band longitudes are chained likewise. Bands are numbered from 0,
    lon_band anew in each lat_band. Sorting by both gives the order; what
    shares both is equal. Null coordinates have a null band, and so do those
    that aren't numbers.

    Chains are found in cells of BAND_CELL degrees and linked where the last
    value of one cell and the first of the next lie together, so a task has a
    cell's different values, and the list of cells (18,000 latitudes at most;
    36,000 longitudes for a band) is numbered on its own.
    """
    usable = F.coalesce(~F.isnan("lat") & ~F.isnan("lon"), F.lit(False))
    known = places.select("lat", "lon").where(usable).distinct()
    lats = _chained(known.select("lat").distinct(), [], "lat", "lat_band", tolerance)
    banded = known.join(lats, "lat")
    lons = _chained(banded.select("lat_band", "lon").distinct(), ["lat_band"], "lon", "lon_band", tolerance)
    every = banded.join(lons, ["lat_band", "lon"])
    return places.join(every, ["lat", "lon"], "left").select(*places.columns, "lat_band", "lon_band")


def _chained(values: DataFrame, keys: list[str], column: str, band: str, tolerance: float) -> DataFrame:
    """values (keys and column, distinct) with the number of the chain within keys."""
    placed = values.withColumn("cell", F.floor(F.col(column) / BAND_CELL))
    inside = Window.partitionBy(*keys, "cell").orderBy(column)
    starts = (F.col(column) - F.lag(column).over(inside) > tolerance).cast("long")
    marked = placed.withColumn("starts", F.coalesce(starts, F.lit(0)))
    nth = marked.withColumn("nth", F.sum("starts").over(inside))
    cells = marked.groupBy(*keys, "cell").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.sum("starts").alias("n"))
    before = Window.partitionBy(*keys).orderBy("cell")
    apart = (F.col("lo") - F.lag("hi").over(before) > tolerance).cast("long")
    shifted = cells.withColumn("apart", F.coalesce(apart, F.lit(0)))
    summed = shifted.withColumn("more", F.col("apart") + F.coalesce(F.lag("n").over(before), F.lit(0)))
    bases = summed.withColumn("base", F.sum("more").over(before)).select(*keys, "cell", "base")
    return nth.join(bases, [*keys, "cell"]).select(*keys, column, (F.col("base") + F.col("nth")).alias(band))


def points(df: DataFrame, side: str, id_col: str = "stop_id", lat: str = "stop_lat", lon: str = "stop_lon") -> DataFrame:
    return df.select(F.col(id_col).alias(f"{side}_id"), F.col(lat).alias(f"{side}_lat"), F.col(lon).alias(f"{side}_lon"))


def nearby(locations: DataFrame, stops: DataFrame, radius: float) -> DataFrame:
    """(location_id, stop_id, distance) within radius. locations has location_id, lat, lon."""
    pairs = near_pairs(points(locations, "left", "location_id", "lat", "lon"), points(stops, "right"), radius)
    return pairs.select(F.col("left_id").alias("location_id"), F.col("right_id").alias("stop_id"), "distance")


def nearest(locations: DataFrame, stops: DataFrame, radius: float = 500.0, widest: float = 21_000_000.0) -> DataFrame:
    """(location_id, stop_id, distance) of the one nearest stop, ties to the smaller id.

    Looks within radius and then ever wider circles for the locations that
    found none, so that dense areas don't compare all stops.
    """
    left, found = locations.select("location_id", "lat", "lon"), []
    reach = radius
    while True:
        hits = nearby(left, stops, reach)
        best = hits.groupBy("location_id").agg(F.min(F.struct("distance", "stop_id")).alias("best"))
        found.append(materialize(best.select("location_id", "best.stop_id", "best.distance"), "nearest"))
        left = materialize(left.join(found[-1], "location_id", "left_anti"), "nearest-left")
        if reach >= widest or left.isEmpty() or stops.isEmpty():
            break
        reach = min(16 * reach, widest)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def nearest_roots(locations: DataFrame, stops: DataFrame, radius: float, limit: int = 10) -> DataFrame:
    """The stops within radius, children as their station, nearest first, at most limit per location."""
    hits = nearby(locations, stops, radius).join(stops.select("stop_id", "parent_station"), "stop_id")
    roots = hits.groupBy("location_id", F.coalesce("parent_station", "stop_id").alias("stop_id")).agg(
        F.min("distance").alias("distance")
    )
    order = Window.partitionBy("location_id").orderBy("distance", "stop_id")
    return roots.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def access_stops(locations: DataFrame, stops: DataFrame, radius: float = 500.0, max_walk: int | None = None) -> DataFrame:
    """Stops to start from or end at, with walk seconds: within radius, else the nearest one."""
    near = materialize(nearby(locations, stops, radius), "access")
    far = locations.join(near.select("location_id").distinct(), "location_id", "left_anti")
    all_ = near.unionByName(nearest(far, stops, radius)).withColumn("walk", walk_seconds(F.col("distance")))
    return all_ if max_walk is None else all_.where(F.col("walk") <= max_walk)


def walk_transfers(
    stops: DataFrame, radius: float = 500.0, speed: float = 1.4, minimum: int = 120, access: int = 15
) -> DataFrame:
    """(from_stop, to_stop, distance, duration) between different stops within radius.

    A walk takes its time plus access and egress, minimum seconds at least.
    """
    pairs = near_pairs(points(stops, "left"), points(stops, "right"), radius).where("left_id <> right_id")
    duration = F.greatest(walk_seconds(F.col("distance"), speed) + 2 * access, F.lit(minimum).cast("long"))
    return pairs.select(
        F.col("left_id").alias("from_stop"),
        F.col("right_id").alias("to_stop"),
        rounded(F.col("distance")).alias("distance"),
        duration.alias("duration"),
    )


def ancestors(stops: DataFrame) -> DataFrame:
    """(stop_id, ancestor, depth): each stop with itself (depth 0) and all it lies below.

    A cycle of parents ends where it would repeat; chains of any depth are followed.
    """
    parents = stops.select(F.col("stop_id").alias("child"), F.col("parent_station").alias("parent")).where(
        "parent_station is not null"
    )
    level = stops.select("stop_id", F.col("stop_id").alias("ancestor"), F.array("stop_id").alias("path"))
    levels = [level]
    while True:
        up = level.join(parents, level["ancestor"] == parents["child"])
        up = up.where(~F.array_contains("path", F.col("parent")))
        level, n = counted(
            up.select("stop_id", F.col("parent").alias("ancestor"), F.array_append("path", F.col("parent")).alias("path")),
            "ancestors",
        )
        if not n:
            break
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.select("stop_id", "ancestor", (F.size("path") - 1).alias("depth"))


def scope(asked: DataFrame, stops: DataFrame, kind: str, radius: float = 500.0) -> DataFrame:
    """(asked_id, stop_id): the stops that a question about asked stops covers.

    asked has asked_id. strict: the stop itself; children: with all below it;
    related: all below its topmost parent; nearby: with those within radius.
    """
    if kind == "strict":
        return asked.select("asked_id", F.col("asked_id").alias("stop_id"))
    if kind == "nearby":
        here = asked.join(stops, F.col("asked_id") == F.col("stop_id")).select(
            F.col("asked_id").alias("location_id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")
        )
        return nearby(here, stops, radius).select(F.col("location_id").alias("asked_id"), "stop_id")
    above = ancestors(stops)
    if kind == "children":
        return asked.join(above.select(F.col("ancestor").alias("asked_id"), "stop_id"), "asked_id")
    if kind == "related":
        top = above.groupBy("stop_id").agg(F.max(F.struct("depth", F.col("ancestor"))).alias("t"))
        top = materialize(top.select("stop_id", F.col("t.ancestor").alias("top")), "tops")
        mine = top.select(F.col("stop_id").alias("asked_id"), "top")
        return asked.join(mine, "asked_id").join(top, "top").select("asked_id", "stop_id")
    raise ValueError(f"no such scope: {kind}")


def inherited_access(stops: DataFrame) -> DataFrame:
    """(stop_id, wheelchair_boarding): 0 (unknown) is taken from the nearest parent that knows."""
    codes = stops.select(F.col("stop_id").alias("ancestor"), "wheelchair_boarding")
    known = ancestors(stops).join(codes, "ancestor").where("wheelchair_boarding <> 0")
    best = known.groupBy("stop_id").agg(F.min(F.struct("depth", "wheelchair_boarding")).alias("b"))
    return stops.select("stop_id").join(best, "stop_id", "left").select(
        "stop_id", F.coalesce("b.wheelchair_boarding", F.lit(0)).alias("wheelchair_boarding")
    )
